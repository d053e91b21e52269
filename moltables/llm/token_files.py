"""Token ids in length-delimited binary record files with a separate offset index.

A data file is a 16-byte head (magic, width of an id, zeros) and frames: length
(8 bytes), masked checksum of the length (4), record, masked checksum of
the record (4). A record is the document id (8 bytes), a byte that is 1 for a
null id, and the ids, 2 or 4 bytes each, all little-endian. The checksum is
crc32, rotated and shifted by a constant so that a file of checksums does not
check itself. Beside each data file lies an index with one 24-byte row for
each record: document id, offset of the frame, number of ids. A reader can so
take records in any order.

Tasks write to new names and report them; only files reported by a task that
succeeded are listed in the manifest, so a lost executor leaves at worst a
file that nobody reads.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moltables.llm.common import documents, query, slices, with_bytes
from moltables.session import shared_folder, stable

MAGIC = b"IDRECS01"
ROLL_BYTES = 32 << 20
REMEMBERED = 1_000_000
#: Between new words that are encoded together; words that hold it are encoded alone.
MARK = b"\x01"
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: What a tokenizer does to a text before its merges, where that is known to be nothing for the pieces below but mapping bytes.
KNOWN_STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
#: Lower-case letters of Latin-1 (as UTF-8), single digits, and runs of ASCII marks other than the apostrophe.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])++")
_PLAIN = re.compile(rb"(?:[a-z0-9!-&(-/:-@\[-`{-~]|\xc3[\x9f-\xb6\xb8-\xbf])++")
_PIECES = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])++|[0-9]|[!-&(-/:-@\[-`{-~]++|\n")
_LETTER_AND_MARK = r"([a-z\x{df}-\x{f6}\x{f8}-\x{ff}])([!-&(-/:-@\[-`{-~])"


def mask(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(record: bytes) -> bytes:
    n = struct.pack("<Q", len(record))
    return b"".join([n, struct.pack("<I", mask(zlib.crc32(n))), record, struct.pack("<I", mask(zlib.crc32(record)))])


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """(record, offset after its frame); raises ValueError on a broken frame."""
    head = data[at:at + 12]
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != mask(zlib.crc32(head[:8])):
        raise ValueError(f"broken length at byte {at}")
    n = struct.unpack("<Q", head[:8])[0]
    record, check = data[at + 12:at + 12 + n], data[at + 12 + n:at + 16 + n]
    if len(check) < 4 or struct.unpack("<I", check)[0] != mask(zlib.crc32(record)):
        raise ValueError(f"broken record at byte {at}")
    return record, at + 16 + n


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder if re.match("^[a-z0-9+.-]+:/", folder) else f"file://{os.path.abspath(folder)}"))


class _Encoder:
    """Encodes words between ASCII white space, which the tokenizer drops, and remembers them up to a bound.

    New words go through the tokenizer a thousand at a time, with a mark between them that is one id of its own.
    Words of plain letters, digits and marks, which ``KNOWN_STEPS`` do not change, are cut where these steps cut them;
    their pieces, which words share, go through the same merges without these steps.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.words: dict[bytes, bytes] = {}
        mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        # No plain word holds a special token: they look like <|name|>, and words with <| are not cut.
        suffix = d["model"].get("end_of_word_suffix")
        known = suffix and (d.get("normalizer"), d.get("pre_tokenizer")) == KNOWN_STEPS and all(t["content"].startswith("<|") for t in d.get("added_tokens") or [])
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a piece
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if known and t.endswith(suffix)]] = True
        self.merges = Tokenizer.from_str(json.dumps(d | {"normalizer": None, "pre_tokenizer": d["pre_tokenizer"]["pretokenizers"][-1]})) if known else None

    def _learn_plain(self, words: list[bytes]) -> list[bytes]:
        """Learn the plain ones of new words; returns the others."""
        new = [w for w in words if _LETTERS.fullmatch(w) and w not in self.words]  # pieces already
        rest = [w for w in words if not _LETTERS.fullmatch(w)]
        plain = [w for w in rest if _PLAIN.fullmatch(w) and b"<|" not in w]
        flat = _PIECES.findall(b"\n".join([*plain, b""]))  # each word ends with a line break
        new += {p for p in flat if p not in self.words}.difference(new, [b"\n"])
        for i in range(0, len(new), 1000):
            some = new[i:i + 1000]
            ids = np.array(self.merges.encode_batch_fast([b"\n".join(some).decode().split("\n")], is_pretokenized=True, add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            raw, n, lo = ids.tobytes(), self.width, 0
            for p, hi in zip(some, ends.tolist(), strict=True):
                self.words[p] = raw[lo * n:hi * n]
                lo = hi
        ends = [i for i, p in enumerate(flat) if p == b"\n"]
        get = self.words.__getitem__
        for w, lo, hi in zip(plain, [0, *[i + 1 for i in ends]], ends):
            if hi - lo > 1:
                self.words[w] = b"".join(map(get, flat[lo:hi]))
        return [w for w in rest if w not in self.words]

    def _one_by_one(self, words: list[bytes]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)):
            self.words[w] = np.array(e.ids, self.kind).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        if self.merges is not None:
            words = self._learn_plain(words)
        for i in range(0, len(words), 1000):
            some = words[i:i + 1000]
            alone = [w for w in some if MARK in w] if self.mark is not None else some
            if alone:
                self._one_by_one(alone)
                some = [w for w in some if w not in self.words]
            if not some:
                continue
            line = (b" " + MARK + b" ").join(some).decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, self.kind)
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            if len(ends) != len(some):  # a word gave the mark's id by itself
                self._one_by_one(some)
                continue
            raw, n, lo = ids.tobytes(), self.width, 0
            for w, hi in zip(some, ends.tolist()):
                self.words[w] = raw[lo * n:hi * n]
                lo = hi + 1

    def _lowered(self, text: bytes) -> bytes:
        """A text of the same ids; ASCII letters lose their case in the tokenizer anyway, so words that differ in it only are learned once.

        The names of special tokens must not be made by it. The tokenizer composes
        before it lowers, so a letter that a combining mark may follow keeps its
        case: only marks of U+0300 to U+036F (first byte CC or CD) compose with ASCII letters.
        """
        if b"<|" in text or not self.lower:
            return text
        if b"\xcc" in text or b"\xcd" in text:
            return b" ".join([w.lower() if w.isascii() else w for w in text.split()])
        return text.lower()

    def encode(self, texts: list[bytes], end_id: int) -> list[bytes]:
        """Ids of each text with the end id, ``width`` bytes each."""
        lowered = pa.array([self._lowered(t) for t in texts], pa.binary())
        lowered = pa.Array.from_buffers(pa.string(), len(lowered), lowered.buffers())
        if self.merges is not None:  # a mark after a letter starts a piece: words that differ in their last marks are one
            lowered = pc.if_else(pc.match_substring(lowered, "<|"), lowered, pc.replace_substring_regex(lowered, _LETTER_AND_MARK, r"\1 \2"))
        cut = pc.ascii_split_whitespace(lowered)
        coded = cut.values.dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.words) > REMEMBERED:
            self.words = {w: v for w in words if (v := self.words.get(w)) is not None}
        ids = list(map(self.words.get, words))
        new = [i for i, v in enumerate(ids) if v is None]
        self._learn([words[i] for i in new])
        for i in new:
            ids[i] = self.words[words[i]]
        # The ids of each word in its turn, gathered from those of the distinct words.
        held, codes = np.frombuffer(b"".join(ids), self.kind), coded.indices.to_numpy()
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        sizes = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        all_ids = held[np.repeat((np.cumsum(lengths) - lengths)[codes] - ends[:-1], sizes) + np.arange(ends[-1])]
        end = np.array([end_id], self.kind).tobytes()
        bounds = ends[cut.offsets.to_numpy()].tolist()
        return [all_ids[lo:hi].tobytes() + end for lo, hi in zip(bounds, bounds[1:])]

    @property
    def lower(self) -> bool:
        if not hasattr(self, "_lower"):
            both = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "The End", "the end")]
            self._lower = both[0] == both[1] and both[2] == both[3]
        return self._lower


_ENCODERS: dict[str, _Encoder] = {}


class _Writer:
    """Writes records to a new data file and its index."""

    def __init__(self, folder: str, part: int, seq: int, width: int):
        self.store, base = _store(folder)
        self.name = f"part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}"
        self.path = f"{base}/{self.name}"
        self.out = self.store.open_output_stream(f"{self.path}.ids")
        self.out.write(MAGIC + bytes([width]) + bytes(7))
        self.at, self.tokens, self.index = 16, 0, []

    def add(self, doc_id: int | None, ids: bytes, width: int) -> None:
        f = frame(struct.pack("<qB", doc_id or 0, doc_id is None) + ids)
        self.out.write(f)
        self.index.append((doc_id or 0, self.at, len(ids) // width))
        self.at += len(f)
        self.tokens += len(ids) // width

    def close(self) -> dict:
        self.out.close()
        with self.store.open_output_stream(f"{self.path}.index") as out:
            out.write(np.array(self.index, "<i8").tobytes())
        return {"file": self.name, "docs": len(self.index), "tokens": self.tokens, "bytes": self.at}


def _write_task(folder: str, tokenizer: str, end_id: int, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = _Encoder(tokenizer)
        enc = _ENCODERS[tokenizer]
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        writer, seq, done = None, 0, []
        for b in slices(batches, most=8 << 20):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode([t or b"" for t in b.column("text").to_pylist()], end_id)):
                writer = writer or _Writer(folder, part, seq, enc.width)
                writer.add(doc_id, ids, enc.width)
                if writer.at >= roll:
                    done.append({"part": part, "seq": seq, **writer.close()})
                    writer, seq = None, seq + 1
        if writer:
            done.append({"part": part, "seq": seq, **writer.close()})
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))
    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, roll: int = ROLL_BYTES) -> DataFrame:
    """Encode all rows, write them in ascending id order, and return the manifest: (part, seq, file, docs, tokens, bytes, start).

    ``start`` is the number of ids in all files before. Files are closed at
    ``roll`` bytes. Null ids come first, rows of one id in the order of a hash of
    their text. Null text is empty: its record holds the end id only. An empty
    table gives an empty manifest.
    """
    texts = with_bytes(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    dealt = texts.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    files = stable(dealt.mapInArrow(_write_task(folder, tokenizer, end_id, roll), "part long, seq long, file string, docs long, tokens long, bytes long"))
    # One row for each file: the only thing that is put in one order.
    before = Window.partitionBy().orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return stable(files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))))


def read_index(folder: str, name: str) -> np.ndarray:
    """Rows (doc id, offset, number of ids) of a data file."""
    store, base = _store(folder)
    with store.open_input_stream(f"{base}/{name}.index") as f:
        return np.frombuffer(f.read(), "<i8").reshape(-1, 3)


def read_record(folder: str, name: str, offset: int) -> tuple[int | None, np.ndarray]:
    """One record by its offset, for reads in shuffled order."""
    store, base = _store(folder)
    with store.open_input_file(f"{base}/{name}.ids") as f:
        width = f.read(16)[8]
        f.seek(offset)
        head = f.read(12)
        return _ids(unframe(head + f.read(struct.unpack("<Q", head[:8])[0] + 4), 0)[0], width)


def _ids(record: bytes, width: int) -> tuple[int | None, np.ndarray]:
    doc_id, null = struct.unpack("<qB", record[:9])
    return None if null else doc_id, np.frombuffer(record, f"<u{width}", offset=9)


def _read_task(folder: str, with_ids: bool):
    kind = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for b in batches:
            for name, start, docs in zip(*(b.column(c).to_pylist() for c in ("file", "start", "docs"))):
                with store.open_input_stream(f"{base}/{name}.ids") as f:
                    data = f.read()
                if data[:8] != MAGIC:
                    raise ValueError(f"{name}: not a file of this format")
                index = read_index(folder, name)
                if len(index) != docs:
                    raise ValueError(f"{name}: {len(index)} index rows for {docs} records")
                rows, lists, at = [], [], 16
                for _, offset, n in index.tolist():
                    if offset != at:
                        raise ValueError(f"{name}: index and frames differ at byte {at}")
                    record, at = unframe(data, at)
                    doc_id, ids = _ids(record, data[8])
                    if len(ids) != n:
                        raise ValueError(f"{name}: index and record differ at byte {offset}")
                    rows.append((doc_id, start, n, zlib.crc32(ids.astype("<u4").tobytes())))
                    start += n
                    if with_ids:
                        lists.append(ids.astype(np.int64))
                cols = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kind)]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(lists, pa.list_(pa.int64()))] if with_ids else []), [n for n, _ in kind] + (["ids"] if with_ids else []))
    return run


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every record, checked against checksums and index.

    Files are dealt out by their place, about one to a task; a number of
    partitions that is asked for is not cut down by adaptive execution.
    """
    files = max(1, manifest.count())
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return manifest.select("file", "start", "docs").repartitionByRange(files, "start", "file").mapInArrow(_read_task(folder, with_ids), kind)


def token_folder(spark: SparkSession) -> str:
    folder = shared_folder(spark, "ids")
    store, base = _store(folder)
    store.create_dir(base)
    return folder


@query()
def op6_token_files(spark, sf_dir):
    """Documents as token ids, written as record files and read back."""
    import public_tokenizers
    folder = token_folder(spark)
    manifest = write_token_files(documents(spark, sf_dir), folder, public_tokenizers.path(TOKENIZER))
    return read_token_files(manifest, folder)
