"""Merkle manifest against a tree built in plain lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from moltables.llm import merkle as M

VALUES = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, at):
    for nodes in tree[:-1]:
        lo = at // 16 * 16
        yield at - lo, nodes[lo:lo + 16]
        at //= 16


def lowered(text):
    return text if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """Rows of the query from dicts of the values."""
    by_source = {}
    for r in rows:
        leaf = h(*[enc(r[v]) for v in VALUES])
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        forged = h(*[enc(lowered(r[v]) if v == "text" and hit else r[v]) for v in VALUES])
        by_source.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, forged))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by_source[s])]) for s in sources}
    whole = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, (has, doc_id, leaf, forged) in enumerate(sorted(by_source[s])):
            node, others = forged, []
            for place, run in [*path(trees[s], at), *path(whole, k)]:
                others += run[:place] + run[place + 1:]
                node = h(*run[:place], node, *run[place + 1:])
            root = whole[-1][0]
            out.append((doc_id if has else None, leaf, trees[s][-1][0], root, h(*others), node, node == root))
    return sorted(out, key=str)


def proofs(docs):
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return M.manifest(docs, forged={"text": F.when(hit, low).otherwise(F.col("text"))})


def made(spark, n):
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 500 != 1, F.concat(F.lit("s"), (F.col("id") % 19).cast("string"))).alias("source"))
    return d.select("*", F.lit("en").alias("lang"), F.lit(3).cast("long").alias("n_chars"), F.concat(F.lit("Text A"), F.col("doc_id").cast("string")).alias("text"))


@pytest.mark.parametrize("n", [1, 15, 16, 17, 256, 257, 4096, 4097])
def test_append_equals_levels(n):
    nodes = [h(str(i)) for i in range(n)]
    tree, a = levels(nodes), M.Append()
    seen = [a.append(x.encode()) for x in nodes]
    root = a.finish()
    assert root.decode() == tree[-1][0]
    for i in {0, n // 2, n - 1}:
        got = a.path(seen[i])
        assert [(p, "".join(r).encode()) for p, r in path(tree, i)] == got and M.fold(nodes[i].encode(), got) == root


def test_witnesses_grow_with_later_appends():
    a = M.Append()
    run, place = a.append(h("0").encode())
    for i in range(1, 16):
        assert len(run.members) == i and run.up is None
        a.append(h(str(i)).encode())
    assert place == 0 and run.up is not None and len(run.up[0].members) == 1


def test_a_block_is_lifted_to_its_level():
    a = M.Append()
    a.append(h("x").encode())
    assert a.finish(M.LEVELS).decode() == h(h(h(h("x"))))


def test_awkward_rows(spark, awkward_docs):
    got = proofs(awkward_docs.repartition(3)).proofs()
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute([r.asDict() for r in awkward_docs.collect()])


def test_one_row_and_no_rows(spark, awkward_docs, empty_docs):
    assert proofs(empty_docs).proofs().count() == 0
    one = awkward_docs.filter("doc_id = 5")
    r = proofs(one).proofs().collect()
    assert [tuple(x) for x in r] == brute([x.asDict() for x in one.collect()])
    assert r[0]["leaf"] == r[0]["root"] and r[0]["proof_sha256"] == h("")


def test_several_blocks_and_levels(spark, monkeypatch):
    docs = made(spark, 14_000)  # the hot source has more than 4096 leaves
    m = proofs(docs)
    want = brute([r.asDict() for r in docs.collect()])
    assert sorted((tuple(r) for r in m.proofs().collect()), key=str) == want
    some = m.witnesses().join(m.leaves.select("key", "at", "node"), ["key", "at"]).filter("at % 997 = 0").collect()
    assert len(some) > 20
    for r in some:
        assert M.fold(r["node"].hex().encode(), [(x["place"], x["run"]) for x in r["runs"]]).decode() == r["root"] == want[0][3]
