"""Token files, media, pieces: exact round trips."""

import random
import struct
import sys
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from moltables.llm import mpeg_audio as M
from moltables.llm import spm
from moltables.llm import token_files as T

WORDS = public_tokenizers.path(T.TOKENIZER)


def test_token_files_hold_what_the_tokenizer_gives(spark, awkward_docs):
    folder = T.token_folder(spark)
    manifest = T.write_token_files(awkward_docs.repartition(4), folder, WORDS, roll=20_000)
    got = T.read_token_files(manifest, folder, with_ids=True).orderBy("start").collect()
    tok = Tokenizer.from_file(WORDS)
    want = {}
    for r in awkward_docs.collect():
        want.setdefault(r["doc_id"], []).append(tok.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    at = 0
    assert len(got) == awkward_docs.count() and manifest.count() > 1
    assert [r["doc_id"] is not None for r in got] == sorted(r["doc_id"] is not None for r in got)
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert ids == sorted(ids)
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"] in want[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    name = manifest.orderBy("part", "seq").first()["file"]
    index = T.read_index(folder, name)
    for doc_id, offset, n in index[::-1].tolist():  # any order
        got_id, some = T.read_record(folder, name, offset)
        assert (got_id or 0) == doc_id and len(some) == n


def test_words_of_the_mark_and_special_names_are_encoded_as_in_the_whole_text():
    e = T._Encoder(WORDS)
    texts = ["a\x01b \x01 <|endoftext|> <|ENDOFTEXT|> Don't 'LL é, x̲, É ß   \x85y", "", "THE the"]
    got = e.encode([t.encode() for t in texts], 1)
    for t, raw in zip(texts, got):
        assert np.frombuffer(raw, e.kind).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_capitals_before_combining_marks_are_encoded_as_in_the_whole_text():
    e = T._Encoder(WORDS)
    pairs = ["H\u0331", "T\u0308", "W\u030a", "Y\u030a", "J\u030c"]
    texts = [*pairs, *[f"The {p}amad SAYS {p.lower()} \u00c9T\u00c9" for p in pairs], *["".join(f"{chr(a)}{chr(m)} x{chr(a)}{chr(m)}y " for a in range(65, 91)) for m in range(0x300, 0x370)]]
    for t, raw in zip(texts, e.encode([t.encode() for t in texts], 1)):
        assert np.frombuffer(raw, e.kind).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_only_marks_of_one_block_compose_with_ascii_letters():
    joins = {c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.normalize("NFD", c)[0] < "\x80" for c in unicodedata.normalize("NFD", c)[1:]}
    assert joins and all(c.encode()[0] in (0xCC, 0xCD) for c in joins)


def test_plain_words_are_learned_by_their_pieces_only(monkeypatch):
    e = T._Encoder(WORDS)
    assert e.lower
    texts = ["Threshst. threshst, threshst!! (threshst) ñasarñ&&& ñasarñ 1999 x2y a_b-c ... &&", "été.é, -- 10%"]
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    sent = []
    class Seen:
        def encode_batch_fast(self, lines, **how):
            sent.extend(lines[0])
            return merges.encode_batch_fast(lines, **how)
    merges = e.merges
    monkeypatch.setattr(e, "merges", Seen())
    monkeypatch.setattr(e, "tokenizer", None)  # the whole way through the tokenizer is not gone
    assert [np.frombuffer(raw, e.kind).tolist() for raw in e.encode([t.encode() for t in texts], 1)] == want
    assert len(sent) == len(set(sent)) and sent.count("threshst") == 1


def test_odd_words_are_encoded_as_in_the_whole_text():
    e = T._Encoder(WORDS)
    r = random.Random(5)
    some = [*map(chr, range(1, 0x180)), *"'’`´́̈İıſKÅ٣½²ªµ·中文日本каЙй\u2028\u3000", *["<|endoftext|>", "<|", "|>", "'s", "'ll", "the", "É"] * 4, *" " * 60]
    texts = ["".join(r.choices(some, k=r.randint(0, 14))) for _ in range(4000)] + ["abc<|endoftext|>. x<| y|>. <|startoftext|>!", "a" * 5000 + "中", "é" * 3000 + "!" * 3000 + "'", "½. ·. ²!. ª."]
    for t, raw in zip(texts, e.encode([t.encode() for t in texts], 1)):
        assert np.frombuffer(raw, e.kind).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids + [1], t


def test_another_tokenizer_goes_the_whole_way(tmp_path):
    import json
    with open(WORDS, encoding="utf-8") as f:
        d = json.load(f)
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(d | {"normalizer": {"type": "Lowercase"}}, f)
    e = T._Encoder(path)
    t = "Other words, their ends. ñ!! 12"
    assert e.merges is None and np.frombuffer(e.encode([t.encode()], 1)[0], e.kind).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_broken_frames_are_found():
    f = T.frame(b"some record")
    assert T.unframe(b"xx" + f, 2) == (b"some record", 2 + len(f))
    for i in range(len(f)):
        bad = bytearray(f)
        bad[i] ^= 4
        with pytest.raises(ValueError):
            T.unframe(bytes(bad), 0)


def test_empty_table_has_an_empty_manifest(spark, empty_docs):
    folder = T.token_folder(spark)
    m = T.write_token_files(empty_docs, folder, WORDS)
    assert m.count() == 0 and T.read_token_files(m, folder).count() == 0


def test_tracks_carry_texts(spark, awkward_docs, empty_docs):
    got = M.track_features(M.stored_tracks(awkward_docs)).collect()
    texts = {}
    for r in awkward_docs.collect():
        texts.setdefault(r["doc_id"], []).append((r["text"] or "").encode())
    assert len(got) == awkward_docs.count()
    import hashlib
    for r in got:
        payloads = [t + b"\xff" * ((-len(t)) % 576 if t else 576) for t in texts[r["doc_id"]]]
        assert r["payload_sha256"] in [hashlib.sha256(p).hexdigest() for p in payloads] and r["payload_bytes"] % 576 == 0
        assert r["samples"] == 1152 * len(r["seek"]) and " skipped=0 " in r["feature"] and r["rate"] == 48000
    same = [r for r in got if r["doc_id"] in (1, 2)]
    assert same[0]["feature"] == same[1]["feature"] and same[0]["media_sha256"] == same[1]["media_sha256"]
    assert M.track_features(M.stored_tracks(empty_docs)).count() == 0


def test_reader_resynchronises_and_checks():
    payload = bytes(range(256)) * 9
    track = M.write_track(payload + b"\xff" * (-len(payload) % 576))
    t = M.read_track(track)
    assert (t.checked, t.bad, t.skipped, t.table["frames"], t.tags["TLEN"]) == (4, 0, 0, 4, "96") and len(t.table["points"]) == 100
    assert M.payload_of(track, t)[:len(payload)] == payload
    cut = t.offsets[2]
    noisy = track[:cut] + b"\xff\xfb junk \xff\xff\xff" + track[cut:]
    n = M.read_track(noisy)
    assert len(n.heads) == 4 and n.skipped == 11 and n.samples == t.samples
    bad = bytearray(track)
    bad[t.offsets[1] + 8] ^= 1
    assert M.read_track(bytes(bad)).bad == 1
    assert M.read_track(track[:-100]).truncated == 1 and M.read_track(b"").heads == [] and M.read_track(b"\xff" * 999).heads == []
    tagged = M.read_track(track + b"TAG" + b"A title".ljust(30, b"\0") + b"\0" * 95)
    assert tagged.tags["title"] == "A title" and tagged.skipped == 0


def test_heads_of_all_versions_and_layers():
    seen = set()
    for second in range(0xE0, 0x100):
        for third in range(0, 256, 4):
            h = M.head(bytes([0xFF, second, third, 0]), 0)
            if h:
                seen.add((h.version, h.layer))
                assert h.size > 20 and h.samples in (384, 576, 1152)
    assert len(seen) == 9
    vbri = bytearray(bytes([0xFF, 0xFB, 0xC4, 0xC0]) + bytes(668))
    vbri[36:54] = b"VBRI" + b"\0" * 6 + struct.pack(">II", 1344, 1)
    assert M.read_track(bytes(vbri) * 1 + bytes([0xFF, 0xFB, 0xC4, 0xC0]) + bytes(668)).table == {"kind": "VBRI", "bytes": 1344, "frames": 1}


def test_pieces_equal_the_other_library(spark, awkward_docs, empty_docs):
    judge = sentencepiece.SentencePieceProcessor(model_file=spm.model_path())
    texts = {}
    for r in awkward_docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    got = spm.encoded(awkward_docs, spm.model_path()).collect()
    assert len(got) == awkward_docs.count()
    for r in got:
        assert r["ids"] in judge.encode(texts[r["doc_id"]]) and r["parity"] and r["n_pieces"] == len(r["ids"])
        assert r["decoded"] in texts[r["doc_id"]] and r["round_trip"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<i4").tobytes())
    assert spm.encoded(empty_docs, spm.model_path()).count() == 0
    c = spm.codec(spm.model_path())
    for t in ["  two  spaces ", "▁mark▁ in text", "<s> </s> <unk> <0x0A>", "tab\tnew\n\nline", "日本語🙂\x00\x01"]:
        assert c.encode([t])[0].tolist() == judge.encode(t)


def _message(*fields):
    out = b""
    for n, v in fields:
        if isinstance(v, bytes):
            out += bytes([n << 3 | 2]) + (bytes([len(v)]) if len(v) < 128 else bytes([len(v) & 127 | 128, len(v) >> 7])) + v
        elif isinstance(v, float):
            out += bytes([n << 3 | 5]) + struct.pack("<f", v)
        else:
            out += bytes([n << 3]) + bytes([v]) if n < 16 else bytes([(n << 3) & 127 | 128, n >> 4]) + bytes([v])
    return out


def test_a_unigram_model_with_byte_fallback(tmp_path):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", -20.0, 6) for i in range(256)],
              ("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.1, 1), ("ab", -5.0, 1), ("▁ab", -4.5, 1), ("▁a", -3.9, 1), ("ba", -5.2, 1)]
    data = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    data += _message((2, _message((3, 1), (35, 1)))) + _message((3, _message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    m = spm.parse(data)
    assert m.kind == spm.UNIGRAM and m.byte_fallback and len(m.pieces) == len(pieces)
    c = spm.Codec(str(path))
    judge = sentencepiece.SentencePieceProcessor(model_file=str(path))
    for t in ["ab abba ba", "a b  ab", "abé ba"]:
        assert c.encode([t])[0].tolist() == judge.encode(t) and c.decode(c.encode([t])[0]) == t
    assert not c.differ


def test_null_media_is_an_empty_stream(spark):
    d = spark.createDataFrame([(1, 0)], "doc_id long, n_bytes long").withColumn("media", F.lit(None).cast("binary"))
    r = M.track_features(d).first()
    assert r["payload_bytes"] == 0 and r["feature"].startswith("none ")
