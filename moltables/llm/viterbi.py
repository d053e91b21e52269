"""Viterbi decoding of many sequences at once in numpy."""

from __future__ import annotations

import numpy as np


def decode(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Best label of each item of sequences that lie one after the other in ``scores`` (items, labels).

    ``moves[i, j]`` is added for going from label i to j, ``first`` at the first
    item. Sequences of length zero are allowed. Of equal paths the one with
    the smaller labels, seen from the end, is taken. Memory: one number of the
    smallest type that holds the labels for each item and label.
    """
    lengths = np.asarray(lengths, np.int64)
    total, k = scores.shape
    kind = np.int8 if k <= 1 << 7 else np.int16 if k <= 1 << 15 else np.int32
    out = np.zeros(total, kind)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return out
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    steps = int(sizes[0])
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")  # sequences longer than t
    back = np.zeros((total, k), kind)
    last = np.zeros((len(order), k), np.float32)
    v = scores[starts] + (0 if first is None else first.astype(np.float32))
    turned = np.ascontiguousarray(moves.T.astype(np.float32))  # [to, from]
    for t in range(1, steps):
        n = live[t]
        if n < len(v):
            last[n:len(v)] = v[n:]
            v = v[:n]
        at = starts[:n] + t
        ways = v[:, None, :] + turned
        best = ways.argmax(2)
        back[at] = best
        v = np.take_along_axis(ways, best[:, :, None], 2)[:, :, 0] + scores[at]
    last[:len(v)] = v
    label = last.argmax(1)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        at = starts[:n] + t
        out[at] = label[:n]
        if t:
            label[:n] = back[at, label[:n]]
    return out
