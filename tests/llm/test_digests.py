"""Digest columns of the queries against plain Python on the smallest table."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from moltables.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_shards(spark, texts):
    rows = QUERIES["op4_virtual_slot_shards"](spark, SF).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(texts.keys())
    places, load = defaultdict(list), Counter()
    for r in rows:
        t = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 8, zlib.crc32(t), "bytes", None)
        places[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert set(places) <= set(range(24)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)


def test_payloads(spark, texts):
    rows = QUERIES["op8_mpeg_audio"](spark, SF).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(texts.keys())
    stored = defaultdict(set)
    for r in rows:
        t = texts[r["doc_id"]].encode()
        padded = t + b"\xff" * (max(1, -(-len(t) // 576)) * 576 - len(t))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(t), len(padded))
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert r["media_bytes"] >= len(padded)
        stored[t].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in stored.values()) and len({m for v in stored.values() for _, m, _ in v}) == len(stored)


def test_main_texts_and_manifest_have_a_row_each(spark, texts):
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    out = QUERIES["op11_html_main_text"](spark, SF).collect()
    assert len(out) == pages and all(r["n_chars"] == len(r["text"]) and "<" not in r["text"] for r in out)
    rows = QUERIES["op12_merkle_manifest"](spark, SF).collect()
    assert len({r["root"] for r in rows}) == 1
    for r in rows:
        hit = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in texts[r["doc_id"]])
        assert r["verified"] == (not hit) == (r["folded_root"] == r["root"])
