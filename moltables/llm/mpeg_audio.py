"""MPEG audio in a binary column: find frames, read tags and variable-bitrate tables, verify checksums.

``read_track`` takes any stream of MPEG 1, 2 or 2.5 audio, layers I to III: it
skips tags, looks for a frame head whose successor fits it, walks from head
to head, and where that breaks looks for the next such head. Its durations
are exact sample counts, and the offset of every frame is known for seeking.

``write_track`` makes valid silent frames (layer III, mono, 48 kHz, 224 kbit/s,
with checksums) that carry 576 payload bytes each in their ancillary
data, behind an info frame and a tag, so that bytes can be stored without loss.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltables.llm.common import documents, query, slices, with_bytes
from moltables.session import shared_folder

UNIT = 576
# Fixed values of the format: kbit/s by (MPEG 1?, layer), sample rates by version bits, side information bytes.
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, (t << 1) ^ 0x8005, t << 1) & 0xFFFF
    return t


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """Checksum of each row of bytes, as frames carry it."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for c in rows.T:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ c]
    return crc


@dataclass(frozen=True)
class Head:
    version: int
    layer: int
    checked: bool
    kbits: int
    rate: int
    padded: bool
    mono: bool

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 3 else 576

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12000 * self.kbits // self.rate + self.padded) * 4
        return self.samples // 8 * 1000 * self.kbits // self.rate + self.padded

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    def fits(self, other: "Head") -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


_HEADS: dict[bytes, Head | None] = {}


def head(data: bytes, at: int) -> Head | None:
    """Frame head at an offset, None if there is none. Free bitrates are not taken for heads."""
    raw = data[at:at + 4]
    if raw in _HEADS:
        return _HEADS[raw]
    h = None
    if len(raw) == 4 and raw[0] == 255 and raw[1] >= 0xE0:
        version, layer, bits, rate = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), raw[2] >> 4, raw[2] >> 2 & 3
        if version != 1 and layer != 4 and 0 < bits < 15 and rate != 3:
            h = Head(version, layer, not raw[1] & 1, KBITS[version == 3, layer][bits], RATES[version][rate], bool(raw[2] & 2), raw[3] >> 6 == 3)
    if len(_HEADS) > 10_000:
        _HEADS.clear()
    _HEADS[raw] = h
    return h


@dataclass
class Track:
    heads: list[Head] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    checked: int = 0
    bad: int = 0
    skipped: int = 0
    truncated: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.heads)

    @property
    def rate(self) -> int:
        return self.heads[0].rate if self.heads else 0


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """(text frames, first byte after the tags in front, first byte of the tag behind)."""
    found, at, to = {}, 0, len(data)
    while data[at:at + 3] == b"ID3" and at + 10 <= len(data) and max(data[at + 6:at + 10]) < 128:
        size, pos = _syncsafe(data[at + 6:at + 10]), at + 10
        end = min(pos + size, len(data))
        while pos + 10 <= end and data[pos:pos + 4].isalnum():
            n = _syncsafe(data[pos + 4:pos + 8]) if data[at + 3] == 4 else struct.unpack(">I", data[pos + 4:pos + 8])[0]
            body = data[pos + 10:min(pos + 10 + n, end)]
            if data[pos:pos + 1] == b"T" and body:
                code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                found[data[pos:pos + 4].decode()] = body[1:].decode(code, "replace").rstrip("\0")
            pos += 10 + n
        at += 10 + size + (10 if data[at + 5] & 16 else 0)
    if to - at >= 128 and data[to - 128:to - 125] == b"TAG":
        to -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            text = data[to + a:to + b].split(b"\0")[0].decode("latin-1").strip()
            if text:
                found[name] = text
    return found, min(at, to), to


def _rate_table(data: bytes, at: int, h: Head) -> dict:
    """Xing, Info or VBRI table of a first frame: frames, bytes and seek points as far as it has them, none if it does not fit in the frame."""
    p, end = at + 4 + h.side, at + h.size
    name = data[p:p + 4]
    if h.layer == 3 and name in (b"Xing", b"Info"):
        need = 8 + (4 * (data[p + 7] & 3).bit_count() + 100 * (data[p + 7] >> 2 & 1) if p + 8 <= end else 0)
        if p + need > end:
            return {}
        out, flags, p = {"kind": name.decode()}, struct.unpack(">I", data[p + 4:p + 8])[0], p + 8
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[key] = struct.unpack(">I", data[p:p + 4])[0]
                p += 4
        if flags & 4:
            out["points"] = list(data[p:p + 100])
        return out
    if data[at + 36:at + 40] == b"VBRI" and at + 54 <= end:
        n, frames = struct.unpack(">II", data[at + 46:at + 54])
        return {"kind": "VBRI", "bytes": n, "frames": frames}
    return {}


def _find(data: bytes, at: int, to: int, like: Head | None) -> int:
    """Next offset with a head that the head after it (or the end of the data) confirms; ``to`` if there is none."""
    while True:
        at = data.find(b"\xff", at, to)
        if at < 0:
            return to
        h = head(data, at)
        if h and (like is None or h.fits(like)):
            after = at + h.size
            if after == to or after < to and (n := head(data, after)) and n.fits(h):
                return at
        at += 1


def read_track(data: bytes) -> Track:
    """Everything about a stream that its heads, tags and checksums tell. Bytes in no frame and no tag are counted as skipped."""
    t = Track()
    t.tags, at, to = _tags(data)
    first = True
    while at < to:
        h = head(data, at)
        if not h or t.heads and not h.fits(t.heads[0]):
            found = _find(data, at, to, t.heads[0] if t.heads else None)
            t.skipped += found - at
            at = found
            continue
        if at + h.size > to:
            t.truncated += 1
            t.skipped += to - at
            break
        if first and (table := _rate_table(data, at, h)):
            t.table = table
        else:
            t.heads.append(h)
            t.offsets.append(at)
        first = False
        at += h.size
    guarded = [(o, h) for o, h in zip(t.offsets, t.heads) if h.checked and h.layer == 3]
    raw = np.frombuffer(data, np.uint8)
    for side in {h.side for _, h in guarded}:
        own = np.array([o for o, h in guarded if h.side == side])
        span = np.concatenate([[2, 3], np.arange(6, 6 + side)])
        want = raw[own + 4].astype(np.uint32) << 8 | raw[own + 5]
        good = int((crc16(raw[own[:, None] + span].astype(np.uint32)) == want).sum())
        t.checked += len(own)
        t.bad += len(own) - good
    return t


_HEAD = bytes([0xFF, 0xFA, 12 << 4 | 1 << 2, 0xC0])
_SIZE = head(_HEAD, 0).size
_BODY = 4 + 2 + 17


def write_track(payload: bytes) -> bytes:
    """A track whose frames carry the payload, whose length is a multiple of ``UNIT``."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    frames = np.zeros((len(units), _SIZE), np.uint8)
    frames[:, :4] = np.frombuffer(_HEAD, np.uint8)
    crc = crc16(np.concatenate([frames[:1, 2:4], frames[:1, 6:_BODY]], 1).astype(np.uint32))[0]
    frames[:, 4], frames[:, 5] = crc >> 8, crc & 255
    frames[:, _BODY:_BODY + UNIT] = units
    n = len(units)
    info = bytearray(_SIZE)
    info[:4] = bytes([0xFF, 0xFB, *_HEAD[2:]])
    points = bytes(min(255, 256 * k // 100) for k in range(100))
    table = b"Info" + struct.pack(">III", 7, n, (n + 1) * _SIZE) + points
    info[4 + 17:4 + 17 + len(table)] = table
    length = str(n * 1152 * 1000 // 48000).encode()
    tag = b"TLEN" + struct.pack(">I", len(length) + 1) + b"\0\0\0" + length
    size = bytes([len(tag) >> 21 & 127, len(tag) >> 14 & 127, len(tag) >> 7 & 127, len(tag) & 127])
    return b"".join([b"ID3\3\0\0", size, tag, bytes(info), frames.tobytes()])


def payload_of(data: bytes, t: Track) -> bytes:
    """The bytes that ``write_track`` has put into a track's frames."""
    if not t.offsets:
        return b""
    raw = np.frombuffer(data, np.uint8)
    return raw[np.array(t.offsets)[:, None] + np.arange(_BODY, _BODY + UNIT)].tobytes()


def feature(t: Track) -> str:
    """Format, exact length, checksums, table and seek offsets of a track in one line."""
    h = t.heads[0] if t.heads else None
    form = f"mpeg{VERSIONS[h.version]}-{h.layer} {h.rate}Hz {'mono' if h.mono else 'stereo'}" if h else "none"
    kbits = sorted({h.kbits for h in t.heads})
    ms = t.samples * 1000 // t.rate if t.rate else 0
    seek = zlib.crc32(np.array(t.offsets, "<i8").tobytes())
    return (f"{form} kbits={'-'.join(map(str, kbits[:1] + kbits[1:][-1:]))} frames={len(t.heads)} samples={t.samples} ms={ms} crc={t.checked - t.bad}/{t.checked} "
            f"skipped={t.skipped} table={t.table.get('kind', 'none')}:{t.table.get('frames', 0)} tags={len(t.tags)} seek={seek:08x}")


def _store_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = [t or b"" for t in b.column("text").to_pylist()]
        media = [write_track(t + b"\xff" * (UNIT - len(t) if not t else -len(t) % UNIT)) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _feature_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "media"):
        rows = []
        for m in b.column("media").to_pylist():
            t = read_track(m)
            p = payload_of(m, t)
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(t), t.samples, t.rate, t.offsets))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]],
                                         ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "rate", "seek"])


def stored_tracks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): texts as tracks, written to the shared folder and read back from there.

    Null and empty texts are one unit of padding. Repeated rows are stored one
    by one. Other columns are not read.
    """
    spark = docs.sparkSession
    path = shared_folder(spark, "media")
    kind = "doc_id long, n_bytes long, media binary"
    with_bytes(docs, id_col, text_col).mapInArrow(_store_task, kind).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(kind).parquet(path)


def track_features(media: DataFrame) -> DataFrame:
    """Features of a (doc_id, n_bytes, media) table: exact samples and rate, seek offsets of frames, and a digest of the payload. Null media is an empty stream."""
    kind = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
            "samples long, rate long, seek array<long>")
    return media.withColumn("media", F.coalesce("media", F.lit(b""))).mapInArrow(_feature_task, kind)


@query()
def op8_mpeg_audio(spark, sf_dir):
    """Every text stored in MPEG audio frames, read back and described."""
    d = track_features(stored_tracks(documents(spark, sf_dir)))
    return d.drop("samples", "rate", "seek")
