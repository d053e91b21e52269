"""Linear-chain conditional random field over word shapes, in numpy.

A token's shape keeps digits and punctuation and folds runs of letters. The
score of a label at a token is a weight of its shape and of the shapes one and
two places before and after; moves between labels have weights too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from moltables.llm.viterbi import decode

PLACES = (-2, -1, 0, 1, 2)
_BASE = 0x9FB21C651E98DF25
_PIECE = 1 << 18
_SPACES = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_PIECE, _BASE, np.uint64)]), dtype=np.uint64)
_INVERSES = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_PIECE, pow(_BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
_CODES = np.random.default_rng(3).integers(0, 1 << 64, 256, np.uint64, endpoint=False)


def _folding() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[ord("0"):ord("9") + 1] = ord("d")
    fold[ord("A"):ord("Z") + 1] = ord("X")
    fold[ord("a"):ord("z") + 1] = ord("x")
    fold[128:] = ord("x")
    fold[[9, 10, 11, 12, 13]] = 32
    return fold


_FOLD = _folding()


def shapes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, shape hash) of each token between ASCII white space; places are in bytes."""
    parts, lo = [], 0
    while len(text) - lo > _PIECE:
        cut = max(text.rfind(c, lo + 1, lo + _PIECE) for c in _SPACES)
        if cut < 0:  # one token longer than a piece, perhaps after a space: it stays whole, and the text goes on after it
            ends = [at for c in _SPACES if (at := text.find(c, lo + 1)) >= 0]
            cut = min(ends, default=len(text))
            first = lo + (text[lo:lo + 1] in _SPACES)
            parts.append((np.array([first]), np.array([cut]), np.array([_long_shape(text[first:cut])])))
        else:
            s, e, h = _shapes(text[lo:cut])
            parts.append((s + lo, e + lo, h))
        lo = cut
    s, e, h = _shapes(text[lo:])
    parts.append((s + lo, e + lo, h))
    return tuple(np.concatenate([x[i] for x in parts]) for i in range(3))


def _folded(kind: np.ndarray) -> np.ndarray:
    """Which bytes are kept: runs of equal letter kinds are folded to one."""
    letter = (kind == ord("x")) | (kind == ord("X"))
    keep = np.ones(len(kind), bool)
    keep[1:] = ~(letter[1:] & (kind[1:] == kind[:-1]))
    return keep


def _long_shape(token: bytes) -> np.uint64:
    """Shape hash of one token of any length, equal to that of ``_shapes``."""
    kind = _FOLD[np.frombuffer(token, np.uint8)]
    kept = kind[_folded(kind)]
    h = 0
    for i in range(0, len(kept), _PIECE):
        own = _CODES[kept[i:i + _PIECE]]
        h += int((own * _POWERS[:len(own)]).sum(dtype=np.uint64)) * pow(_BASE, i, 1 << 64)
    h &= (1 << 64) - 1
    return np.uint64(h ^ (h >> 29))


def _shapes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = _FOLD[np.frombuffer(text, np.uint8)]
    solid = np.concatenate([[False], kind != 32, [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    keep = _folded(kind)
    place = np.cumsum(keep)  # place of each kept byte, from 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_CODES[kind[keep]] * _POWERS[:int(place[-1])], dtype=np.uint64)])
    lo, hi = place[start] - 1, place[end - 1]
    h = (sums[hi] - sums[lo]) * _INVERSES[lo]
    return start, end, h ^ (h >> np.uint64(29))


@dataclass
class Model:
    labels: list[str]
    known: np.ndarray  # sorted shape hashes
    weights: np.ndarray  # (places, shapes + 2, labels); the last two rows: a shape not seen, and beyond the text
    moves: np.ndarray
    first: np.ndarray


def _ids(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, len(known))


def _scores(m: Model, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Label scores of all tokens of sequences that lie one after the other."""
    out = m.weights[PLACES.index(0)][ids]
    own = np.repeat(np.arange(len(lengths)), lengths)
    edge = m.weights.shape[1] - 1
    for p, w in zip(PLACES, m.weights):
        if not p:
            continue
        near = np.full(len(ids), edge)
        if p < 0:
            same = own[-p:] == own[:p]
            near[-p:][same] = ids[:p][same]
        else:
            same = own[:-p] == own[p:]
            near[:-p][same] = ids[p:][same]
        out = out + w[near]
    return out


def tag(m: Model, hashes: list[np.ndarray]) -> np.ndarray:
    """Best labels of all tokens of several texts, one after the other."""
    lengths = np.array([len(h) for h in hashes], np.int64)
    if not lengths.sum():
        return np.zeros(0, np.int8)
    return decode(_scores(m, _ids(m.known, np.concatenate(hashes)), lengths), lengths, m.moves, m.first)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(sequences: list[tuple[list[str], list[str]]], labels: list[str], rounds: int = 80, rate: float = 0.2, decay: float = 1e-3) -> Model:
    """Fit by the gradient of the log-likelihood (forward-backward over padded sequences) with Adam. The labels' first is the one outside.

    Moves from anything but B-k or I-k to I-k, and starts with I-k, are ruled out.
    """
    k = len(labels)
    sequences = [s for s in sequences if s[0]]
    hashes = [np.concatenate([shapes(t.encode())[2][:1] for t in tokens]) for tokens, _ in sequences]
    known = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    m = Model(labels, known, np.zeros((len(PLACES), len(known) + 2, k), np.float32), np.zeros((k, k)), np.zeros(k))
    m.weights[PLACES.index(0), len(known), 0] = 4.0  # a shape never seen is outside
    banned = np.array([[b.startswith("I-") and a[2:] != b[2:] for b in labels] for a in labels])
    m.moves[banned] = -1e4
    m.first[[x.startswith("I-") for x in labels]] = -1e4
    if not sequences:
        return m
    lengths = np.array([len(h) for h in hashes])
    n, width = len(hashes), int(lengths.max())
    ids = np.full((n, width), len(known) + 1)
    gold = np.zeros((n, width), np.int64)
    for i, (h, (_, own)) in enumerate(zip(hashes, sequences)):
        ids[i, :len(h)] = _ids(known, h)
        gold[i, :len(h)] = [labels.index(x) for x in own]
    real = np.arange(width) < lengths[:, None]
    near = {p: np.full_like(ids, len(known) + 1) for p in PLACES}
    for p in PLACES:
        if p < 0:
            near[p][:, -p:] = ids[:, :p]
        elif p > 0:
            near[p][:, :-p] = ids[:, p:]
        else:
            near[p] = ids
    moments = {x: [0.0, 0.0] for x in ("w", "m", "f")}
    w, moves, first = m.weights.astype(np.float64), m.moves, m.first
    one = np.eye(k)[gold] * real[:, :, None]
    for step in range(1, rounds + 1):
        s = sum(w[i][near[p]] for i, p in enumerate(PLACES))
        alpha, beta = np.empty((n, width, k)), np.zeros((n, width, k))
        alpha[:, 0] = s[:, 0] + first
        for t in range(1, width):
            alpha[:, t] = np.where(real[:, t, None], _logsum(alpha[:, t - 1, :, None] + moves, 1) + s[:, t], alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            beta[:, t] = np.where(real[:, t + 1, None], _logsum(moves + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2), beta[:, t + 1])
        z = _logsum(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * real[:, :, None]
        diff = one - node
        gm = np.zeros((k, k))
        for t in range(1, width):
            pair = alpha[:, t - 1, :, None] + moves + (s[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
            gm -= (np.exp(pair) * real[:, t, None, None]).sum(0)
            np.add.at(gm, (gold[real[:, t], t - 1], gold[real[:, t], t]), 1)
        gw = np.zeros_like(w)
        for i, p in enumerate(PLACES):
            np.add.at(gw[i], near[p][real], diff[real])
        grads = {"w": gw / n - decay * w, "m": gm / n - decay * np.where(banned, 0, moves), "f": diff[:, 0].sum(0) / n}
        for name, value in (("w", w), ("m", moves), ("f", first)):
            g = grads[name]
            a = moments[name]
            a[0] = 0.9 * a[0] + 0.1 * g
            a[1] = 0.99 * a[1] + 0.01 * g * g
            value += rate * (a[0] / (1 - 0.9 ** step)) / (np.sqrt(a[1] / (1 - 0.99 ** step)) + 1e-8)
        w[:, len(known)] = m.weights[:, len(known)]
        moves[banned] = -1e4
        first[[x.startswith("I-") for x in labels]] = -1e4
    return Model(labels, known, w.astype(np.float32), moves, first)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

