"""Each stage of the pipeline against a plain version on its own input, and the SQL of the queries that have one."""

from collections import Counter

import duckdb
import pytest
import sentencepiece

import corpus_pipeline as P
from moltables.llm import mixing, pii, quality, spm
from moltables.llm.ngram_join import _SQL as PAIRS
from moltables.llm.queries import ORACLES, QUERIES
from tools.check_oracles import canon

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(canon(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert Counter(tuple(canon(r[c]) for c in cols) for r in df.collect()) == want


def test_stages(spark, tmp_path):
    docs, paths = spark.read.parquet(f"{SF}/documents.parquet"), []
    start = docs
    for k, (_, stage) in enumerate(P.STAGES):
        paths.append(str(tmp_path / str(k)))
        stage(spark, docs, SF).write.parquet(paths[-1])
        docs = spark.read.parquet(paths[-1])
        if k < 4:
            assert sorted(docs.columns) == sorted(start.columns)

    def sql(query, path):
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{path}/*.parquet'" if path != SF else f"create view documents as select * from '{SF}/documents.parquet'")
        return con.execute(query).fetchall()
    kept = {r[0] for r in sql(f"select doc_id from ({quality._SQL}) where kept", SF)}
    assert {r["doc_id"] for r in spark.read.parquet(paths[0]).collect()} == kept and kept
    alone = {r[0] for r in sql(f"select doc_id from ({PAIRS}) where component_id = doc_id or n_shingles = 0", paths[0])}
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(paths[1]).collect()}
    assert set(before) == alone and len(alone) < len(kept)
    for r in spark.read.parquet(paths[2]).collect():
        raw = before[r["doc_id"]]
        spans = pii.base_spans(raw)
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not any(c in raw for c in "0123456789@"):
            assert r["text"] == raw
        elif spans:
            assert r["text"] != raw and raw[:spans[0][1]] == r["text"][:spans[0][1]] or spans[0][1] > 0
    plan = Counter(r[0] for r in sql(f"select doc_id from ({mixing._SQL})", paths[2]))
    assert Counter(r["doc_id"] for r in spark.read.parquet(paths[3]).collect()) == plan and min(plan.values()) == 1
    judge = sentencepiece.SentencePieceProcessor(model_file=spm.model_path())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(paths[3]).collect()}
    last = docs.collect()
    assert len(last) == sum(plan.values())
    assert all(r["ids"] == judge.encode(texts[r["doc_id"]]) and r["parity"] and r["round_trip"] for r in last)


def test_stages_on_awkward_and_empty_tables(spark, awkward_docs, empty_docs, tmp_path):
    for table in (awkward_docs, empty_docs):
        for k, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, table, SF)
            assert out.count() <= 4 * table.count()
