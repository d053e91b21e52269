"""SentencePiece models encoded and decoded by the tokenizers library.

The model file (a protobuf) is parsed here: pieces with scores and types, the
kind of model and the normaliser's settings. From them a Tokenizer is built:
a Unigram model from the scores, or for a BPE model the merges in the order
of the scores, both with byte fallback. White space becomes the metaspace mark.

A text is cut before each run of marks. That loses nothing if no piece has a
mark after another character, which is checked when the model is read. Words
that a worker has not met are encoded in multithreaded batches, compared with
the sentencepiece library one by one, and remembered up to a bound.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from moltables.llm.common import documents, query, slices, with_bytes

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
REMEMBERED = 300_000
MODEL = "piece_bpe_32k.model"


@dataclass
class Parsed:
    """What the model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    normalizer: str = ""
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message; nested messages stay bytes."""
    at = 0
    def varint():
        nonlocal at
        n = shift = 0
        while True:
            c = data[at]
            at += 1
            n |= (c & 127) << shift
            shift += 7
            if c < 128:
                return n
    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        elif wire == 2:
            n = varint()
            yield key >> 3, data[at:at + n]
            at += n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            yield key >> 3, data[at:at + n]
            at += n
        else:
            raise ValueError(f"wire type {wire} at byte {at}")


def parse(data: bytes) -> Parsed:
    """Read a model file. Field numbers: 1 pieces (1 text, 2 score, 3 type), 2 trainer (3 kind, 35 byte fallback), 3 normaliser (1 name, 2 map, 3 prefix, 4 extra, 5 escape)."""
    m = Parsed()
    for n, v in _fields(data):
        if n == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, x in _fields(v):
                if k == 1:
                    piece = x.decode()
                elif k == 2:
                    score = float(np.frombuffer(x, "<f4")[0])
                elif k == 3:
                    kind = x
            m.pieces.append((piece, score, kind))
        elif n == 2:
            for k, x in _fields(v):
                if k == 3:
                    m.kind = x
                elif k == 35:
                    m.byte_fallback = bool(x)
        elif n == 3:
            for k, x in _fields(v):
                if k == 1:
                    m.normalizer = x.decode()
                elif k == 2:
                    m.charsmap = x
                elif k == 3:
                    m.dummy_prefix = bool(x)
                elif k == 4:
                    m.remove_extra = bool(x)
                elif k == 5:
                    m.escape = bool(x)
    return m


def merges(m: Parsed) -> list[tuple[str, str]]:
    """Pairs of pieces in the order in which a BPE model joins them: by the score of what they make."""
    vocab = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, i in vocab.items():
        for k in range(1, len(piece)):
            a, b = piece[:k], piece[k:]
            if a in vocab and b in vocab:
                found.append((-m.pieces[i][1], i, vocab[a], vocab[b], a, b))
    return [x[4:] for x in sorted(found)]


def build(m: Parsed):
    """The model as a Tokenizer that gets words with their marks."""
    from tokenizers import Regex, Tokenizer, models, normalizers
    if m.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unknown, m.byte_fallback)
    elif m.kind == BPE:
        unk = m.pieces[m.unknown][0]
        model = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges(m), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model kind {m.kind} is not supported")
    t = Tokenizer(model)
    if m.charsmap:
        t.normalizer = normalizers.Sequence([normalizers.Precompiled(m.charsmap), normalizers.Replace(Regex(" {2,}"), " ")] if m.remove_extra else [normalizers.Precompiled(m.charsmap)])
    return t


class Codec:
    """Encoder and decoder of one model file; remembers words."""

    def __init__(self, path: str):
        import sentencepiece
        with open(path, "rb") as f:
            data = f.read()
        self.model = parse(data)
        self.tokenizer = build(self.model)
        self.judge = sentencepiece.SentencePieceProcessor(model_proto=data)
        odd = [p for p, _, kind in self.model.pieces if kind in (NORMAL, USER) and re.search(f"[^{MARK}]{MARK}", p)]
        self.cuts = not odd and not self.model.charsmap and self.model.escape
        self.words: dict[str, bytes] = {}
        self.differ: set[str] = set()

    def marked(self, text: str) -> str:
        """The text as the model sees it: spaces as marks, one in front."""
        if self.model.remove_extra:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return ((" " if self.model.dummy_prefix else "") + text).replace(" ", MARK)

    def parts(self, text: str) -> list[str]:
        """Words with their marks; each is encoded on its own."""
        if not self.cuts:
            return [self.marked(text)] if text else []
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", self.marked(text))

    def learn(self, parts: set[str]) -> None:
        """Encode words in multithreaded batches and compare each with the other library, which is right where they differ."""
        every = sorted(parts - self.words.keys())
        for k in range(0, len(every), 20_000):
            self._learn(every[k:k + 20_000])

    def _learn(self, new: list[str]) -> None:
        got = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        # The judge puts a mark in front by itself, so it gets the word without its first one.
        prefix = self.model.dummy_prefix
        plain = [i for i, w in enumerate(new) if not prefix or w.startswith(MARK) and len(w) > 1]
        right = dict(zip(plain, self.judge.encode([new[i].replace(MARK, " ")[1 if prefix else 0:] for i in plain], num_threads=1)))
        for i, w in enumerate(new):
            ids = got[i].ids
            if i in right and right[i] != ids:
                self.differ.add(w)
                ids = right[i]
            self.words[w] = np.asarray(ids, "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.parts(t) for t in texts]
        seen = set().union(*cut)
        if len(self.words) > REMEMBERED:
            self.words = {w: v for w in seen if (v := self.words.get(w)) is not None}
        self.learn(seen)
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), "<i4") for p in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces joined, runs of byte pieces as UTF-8 (a broken run gives one replacement mark a byte), marks as spaces, the first one dropped."""
        if not hasattr(self, "table"):
            self.table = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.encode() for p, _, kind in self.model.pieces]
        text = b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each file and worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _encode_task(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches, most=2 << 20):
            raw = b.column("text").to_pylist()
            texts = [(t or b"").decode("utf-8", "replace") for t in raw]
            ids = c.encode(texts)
            same = [not c.differ or not c.differ.intersection(c.parts(t)) for t in texts]
            back = [c.decode(i) for i in ids]
            out = [b.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()), pa.array(same), pa.array([x == t for x, t in zip(back, texts)])]
            names = ["doc_id", "n_pieces", "ids_crc32", "parity", "round_trip"]
            if with_ids:
                out += [pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)
    return run


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, parity, round_trip[, ids, decoded]) for every row.

    ids_crc32 is over the ids as little-endian 32-bit integers. parity: no word
    of the text came out different from the sentencepiece library (whose ids
    are taken where it did). round_trip: decoding gives the text back. Null
    is encoded like the empty text, with no pieces. Equal texts get equal
    rows. Other columns are not read. The model file must be at ``path`` on
    every worker.
    """
    kind = "doc_id long, n_pieces long, ids_crc32 long, parity boolean, round_trip boolean" + (", ids array<int>, decoded string" if with_ids else "")
    return with_bytes(docs, id_col, text_col).mapInArrow(_encode_task(path, with_ids), kind)


@query()
def op9_sentencepiece(spark, sf_dir):
    """Pieces of every document and whether they decode to it."""
    return encoded(documents(spark, sf_dir), model_path(), with_ids=False)
