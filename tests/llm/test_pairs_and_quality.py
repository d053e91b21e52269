"""Near duplicates and quality rules against plain versions."""

import itertools
import os
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from moltables import session
from moltables.llm import ngram_join as N
from moltables.llm import quality as Q
from moltables.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """(n, component) by id for rows of distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = sorted((root(a), root(b)))
            up[q] = p
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(r.choice(words) for _ in range(25))
    originals = [" ".join(r.choice(words) for _ in range(r.choice([3, 8, 40, 120]))) for _ in range(n // 6)]
    out = []
    for i in range(n):
        t = r.choice(originals).split()
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            t[r.randrange(len(t))] = r.choice(words)
        text = " ".join(t)
        if r.random() < 0.3:
            text = f"{passage} {text}"
        out.append((i, text if r.random() < 0.97 else None))
    return out


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "ROW_BLOCK", 4)  # many blocks
    monkeypatch.setattr(N, "CENTRES", 1)
    rows = corpus(5, 240)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_awkward_rows(spark, awkward_docs, empty_docs):
    got = N.near_duplicate_components(awkward_docs).collect()
    assert len(got) == awkward_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and by[3]["component_id"] == 1 and by[11]["component_id"] == 10
    assert by[7]["n_shingles"] == by[8]["n_shingles"] == by[9]["n_shingles"] == 0 and by[8]["component_id"] == 8
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None) and by[12]["n_shingles"] > 10_000
    comp = N.near_duplicate_components(awkward_docs)
    kept = N.one_of_each(awkward_docs, comp)
    assert kept.columns == awkward_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(13) == 1 and ids.count(None) == 2 and 2 not in ids and {7, 8, 9, 12} <= set(ids)
    assert N.near_duplicate_components(empty_docs).count() == 0


def test_equal_entries_and_columns_of_one_row_are_dropped_across_batches():
    rows = sorted([(1, 7, 3, 0)] * 3 + [(2, 7, 3, 1), (2, 8, 4, 0), (2, 8, 4, 0), (3, 9, 5, 2)] + [(4, d, 6, 1) for d in (1, 1, 2, 3, 3)] + [(5, 1, 2, 2), (5, 1, 3, 0)])
    table = pa.table({"h": [r[0] for r in rows], "doc": [r[1] for r in rows], "at": [r[2] << 32 | r[3] for r in rows]})
    for size in (1, 2, 3, 100):
        got = [tuple(r.values()) for b in N._drop_single(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert got == [(2, 7, 3, 1), (2, 8, 4, 0), (4, 1, 6, 1), (4, 2, 6, 1), (4, 3, 6, 1), (5, 1, 2, 2), (5, 1, 3, 0)]


def test_prefixes_are_deleted_once_they_are_dealt(spark):
    session.shared_folder(spark, "any")  # the checkpoint folder is set
    at = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before, rows = set(os.listdir(at)), corpus(6, 120)
    rows += rows[:30] + [(i, t) for (i, _), (_, t) in zip(rows[30:40], rows[40:50])]  # repeated rows, and ids of two texts
    got = N.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    left = [spark.read.parquet(f"{at}/{f}").columns for f in set(os.listdir(at)) - before]
    assert left and not any("prefix" in c for c in left)


def test_signature_bounds_the_symmetric_difference():
    r = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 1 << 62, 200)) for _ in range(2))
        a = np.unique(np.concatenate([a, b[:150]]))
        bits = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(N.signature(a), N.signature(b)))
        assert bits <= len(np.setxor1d(a, b))


def test_pieces_of_a_long_text_hash_like_the_whole(monkeypatch):
    text = b"ab cd\t" * 3000 + b"x" * 900 + b" end"
    whole = N.word_hashes(text)
    monkeypatch.setattr(N, "_PIECE", 1000)
    assert np.array_equal(N.word_hashes(text), whole) and len(whole) == 6002


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1200)}}


def plain_counts(text):
    words = (text or "").encode().split()
    wins = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in wins if wins.count(w) > 1} if len(wins) < 2000 else None
    covered = set()
    for i, w in enumerate(wins):
        if twice and w in twice:
            covered |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark, awkward_docs, empty_docs):
    d = Q.judged(awkward_docs).collect()
    for r in d:
        if r["doc_id"] != 12:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(r["text"])
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    by = {r["doc_id"]: r for r in d}
    assert by[1]["kept"] and by[5]["kept"] and by[17]["n_repeat_words"] == 300 and by[12]["n_words"] == 60_000
    assert by[1]["word"] == "own word"
    assert Q.judged(empty_docs).count() == 0


def test_repeated_lines_are_compared_with_their_outer_white_space(spark):
    texts = ["a\r\nb\r\na\r\n", " x\n x", " x\nx", "x\ny\nx ", "\n\tx\n\tx\n", "\r\n a\r\n a\r\n", "x\nx"]
    got = Q.with_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_dup_lines"] for r in got] == [1, 1, 0, 0, 1, 1, 1]
    assert [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got] == [plain_counts(t) for t in texts]


def test_prose_in_scripts_without_spaces_passes(spark):
    prose = ["春はあけぼの。やうやう白くなりゆく山ぎは、すこしあかりて紫だちたる雲のほそくたなびきたる", "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
             "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ", "လူတိုင်းသည်တူညီလွတ်လပ်သောဂုဏ်သိက္ခာဖြင့်လည်းကောင်း", "មនុស្សទាំងអស់កើតមកមានសេរីភាពនិងសមភាពក្នុងសេចក្ដីថ្លៃថ្នូរ"]
    text = lambda p: "\n".join(f"{p[i:]}{p[:i]}" for i in range(12))
    rows = [*map(text, prose), text("averylongrunoflatinlettersthatisnoproseatall"), text("春は" + "x" * 40)]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in Q.passing(d).collect()) == [0, 1, 2, 3, 4]
    assert not Q.judged(d).filter("kept").count()  # as in the SQL of op10


def test_order_of_rules_changes_no_verdict(spark):
    d = spark.range(200).withColumn("x", F.col("id") % 7)
    checks = {"a": F.col("x") > 2, "b": F.col("x") < 6, "c": F.col("id") > 10}
    est = Q.estimate(d, checks)
    assert {e.name: round(e.rejects, 3) for e in est} == {"a": 0.435, "b": 0.14, "c": 0.055}
    verdicts = [tuple(r[0] is None for r in d.select(Q.cascade(checks, list(o))).collect()) for o in itertools.permutations(checks)]
    assert len(set(verdicts)) == 1
    assert [r[0] for r in d.select(Q.cascade(checks, ["c", "a", "b"])).limit(3).collect()] == ["c"] * 3
