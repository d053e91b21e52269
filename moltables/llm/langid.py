"""Language of whole texts: script ranges, per-word scores, and a Viterbi path with a penalty for switching.

Training counts letters by script and hashed letter n-grams by language over
all training rows. A word may only be of languages that use its script; it is
scored by its n-grams; the best path over a text's words, where each change of
language costs a penalty, labels spans of one language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltables.llm.common import documents, id_crc, query, slices
from moltables.llm.viterbi import decode

#: First code points of script ranges, in order (fixed values of the Unicode blocks); a range ends where the next begins.
SCRIPT_STARTS = {
    0x0000: "Latin", 0x0370: "Greek", 0x0400: "Cyrillic", 0x0530: "Armenian", 0x0590: "Hebrew", 0x0600: "Arabic", 0x0900: "Devanagari",
    0x0980: "Bengali", 0x0A00: "Gurmukhi", 0x0A80: "Gujarati", 0x0B00: "Oriya", 0x0B80: "Tamil", 0x0C00: "Telugu", 0x0C80: "Kannada",
    0x0D00: "Malayalam", 0x0D80: "Sinhala", 0x0E00: "Thai", 0x0E80: "Lao", 0x0F00: "Tibetan", 0x1000: "Myanmar", 0x10A0: "Georgian",
    0x1100: "Hangul", 0x1200: "Ethiopic", 0x13A0: "Other", 0x1780: "Khmer", 0x1800: "Mongolian", 0x1900: "Other", 0x1E00: "Latin",
    0x1F00: "Greek", 0x2000: "Other", 0x2C60: "Latin", 0x2C80: "Other", 0x3040: "Kana", 0x3100: "Other", 0x3130: "Hangul", 0x3190: "Other",
    0x31F0: "Kana", 0x3200: "Other", 0x3400: "Han", 0xA000: "Other", 0xA720: "Latin", 0xA800: "Other", 0xAC00: "Hangul", 0xD7B0: "Other",
    0xF900: "Han", 0xFB00: "Latin", 0xFB1D: "Hebrew", 0xFB50: "Arabic", 0xFE00: "Other", 0xFF21: "Latin", 0xFF66: "Kana", 0xFFA0: "Hangul",
    0xFFE0: "Other", 0x20000: "Han", 0x32000: "Other",
}
SCRIPTS = sorted(set(SCRIPT_STARTS.values()))
BUCKETS = 1 << 16
SIZES = (2, 3, 4)
#: A language uses a script that has at least this share of its letters.
SCRIPT_SHARE = 0.01
PENALTY = 6.0
#: N-grams of a word overlap, so their log-likelihoods are scaled down.
SCALE = 0.5
_FAR = -30.0


class _Tables:
    """Per code point: is it a letter, and its script; made once in a worker."""

    letter = script = None

    @classmethod
    def get(cls):
        if cls.letter is None:
            cls.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
            starts = np.array(list(SCRIPT_STARTS))
            names = np.array([SCRIPTS.index(s) for s in SCRIPT_STARTS.values()], np.int8)
            cls.script = names[np.searchsorted(starts, np.arange(0x110000), side="right") - 1]
        return cls.letter, cls.script


@dataclass
class Words:
    """Words of a text with letters: [start, end) in code points, letters, script, and the n-gram buckets of all in a row."""

    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    grams: np.ndarray
    first: np.ndarray  # where each word's n-grams begin in ``grams``


def cut(text: str | None) -> Words:
    """Runs of letters, lower-cased one code point at a time, with the n-grams of the run and one boundary on each side."""
    letter, script = _Tables.get()
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], is_letter, [False]]).astype(np.int8)))
    start, end = edges[::2], edges[1::2]
    if not len(start):
        e = np.zeros(0, np.int64)
        return Words(e, e, e, e, e, e)
    low = raw
    lowered = (text or "").lower()
    if len(lowered) == len(raw):  # a few letters grow when lower-cased; then case is left as it is
        low = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = end - start
    # Every run with a boundary before and after it, one after the other.
    offs = np.concatenate([[0], np.cumsum(size + 2)])
    line = np.zeros(offs[-1], np.uint32)
    own = np.repeat(np.arange(len(start)), size)
    line[np.arange(len(own)) + 2 * own + 1] = low[is_letter]
    run = np.repeat(np.arange(len(start)), size + 2)
    parts, owner = [], []
    for n in SIZES:
        m = len(line) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for i in range(n):
            h = (h ^ line[i:i + m]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        inside = run[n - 1:] == run[:m]
        parts.append(h[inside] & np.uint32(BUCKETS - 1))
        owner.append(run[:m][inside])
    grams, owner = np.concatenate(parts), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(start))
    return Words(start, end, size, script[raw[start]].astype(np.int64), grams[order].astype(np.int64), np.cumsum(counts) - counts)


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language: n-gram buckets, then letters by script. A task sends at most one row for each language and cell."""
    held: dict[str, np.ndarray] = {}
    def out():
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "cell", "n"])
        held.clear()
    for b in slices(batches):
        for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            w = cut(t.decode("utf-8", "replace"))
            if lang not in held:
                if len(held) >= 64:
                    yield from out()
                held[lang] = np.zeros(BUCKETS + len(SCRIPTS), np.int64)
            held[lang] += np.concatenate([np.bincount(w.grams, minlength=BUCKETS), np.bincount(w.script, w.letters, len(SCRIPTS)).astype(np.int64)])
    yield from out()


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray  # (buckets, languages), scaled log-likelihoods less their mean
    scripts: np.ndarray  # (scripts, languages), 0 or far below


def train(labelled: DataFrame) -> Model:
    """Model from (lang, text) rows; rows with a null in either are left out. Its size: languages times (65,536 + scripts)."""
    texts = labelled.select("lang", F.col("text").cast("binary").alias("text")).filter("lang is not null and text is not null")
    got = texts.mapInArrow(_train_task, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    n = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    if langs:
        n[got["cell"].to_numpy(np.int64), np.searchsorted(langs, got["lang"].to_numpy(str))] = got["n"]
    grams, scripts = n[:BUCKETS], n[BUCKETS:]
    like = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS))
    if langs:
        like -= like.mean(1, keepdims=True)
    share = scripts / np.maximum(scripts.sum(0), 1)
    return Model(langs, (SCALE * like).astype(np.float32), np.where(share >= SCRIPT_SHARE, 0, _FAR).astype(np.float32))


def _scores(m: Model, w: Words) -> np.ndarray:
    if not len(w.start):
        return np.zeros((0, len(m.langs)), np.float32)
    s = np.add.reduceat(m.grams[w.grams], w.first, axis=0)
    narrow = m.scripts[w.script]
    return s + np.where((narrow == 0).any(1, keepdims=True), narrow, 0)  # a script that no language has narrows nothing


def _predict_task(model, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        k = len(m.langs)
        moves = np.where(np.eye(k, dtype=bool), 0, -penalty)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for b in slices(batches, most=8 << 20):
            cuts, scores = [], []
            for t in b.column("text").to_pylist():
                w = cut(t.decode("utf-8", "replace") if t else "")
                scores.append(_scores(m, w) if k else None)
                cuts.append((w.start, w.end, w.letters))
            lengths = np.array([len(c[0]) for c in cuts], np.int64)
            path = decode(np.concatenate(scores), lengths, moves) if k and lengths.sum() else np.zeros(int(lengths.sum()), np.int8)
            langs, shares, spans, at = [], [], [], 0
            for (start, end, letters), n in zip(cuts, lengths):
                own = path[at:at + n]
                at += n
                if not n or not k:
                    langs.append("und")
                    shares.append(0.0)
                    spans.append([])
                    continue
                by = np.bincount(own, letters, k)
                best = int(by.argmax())
                langs.append(m.langs[best])
                shares.append(float(by[best] / by.sum()))
                turn = np.flatnonzero(np.diff(own)) + 1
                lo, hi = np.concatenate([[0], turn]), np.concatenate([turn, [n]]) - 1
                spans.append([{"start": int(start[i]), "end": int(end[j]), "lang": m.langs[own[i]]} for i, j in zip(lo, hi)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, kind)],
                                             ["doc_id", "held_out", "lang_pred", "score", "spans"])
    return run


def languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY, folds: int = 3) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans) for every row.

    lang_pred is the language with the most letters on the best path, the
    first by name among equals, and score its share of the letters. Spans are
    (start, end, lang) in code points from the first letter of a span to its
    last. Null text, text without a letter and a model without languages give
    ``und``, score 0 and no span. Equal texts get equal results. Other columns
    are not read.
    """
    held = F.pmod(id_crc(F.col(id_col)), F.lit(folds)) == 1
    texts = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>"
    return texts.mapInArrow(_predict_task(shared, penalty), kind)


@query()
def op1_language_id(spark, sf_dir):
    """Language of every document, learned from the rows outside the fold."""
    docs = documents(spark, sf_dir)
    model = train(docs.filter(F.pmod(id_crc(F.col("doc_id")), F.lit(3)) != 1).select("lang", "text"))
    d = languages(docs.select("doc_id", "text"), model)
    return d.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))
