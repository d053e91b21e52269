"""Merkle manifest of a table with incremental witnesses.

Each row is a leaf; the leaves of a source, by id, form a tree of runs of 16,
and the subroots of the sources form one more. ``Append`` takes nodes one
after another. A node's witness is its place in an open run; later siblings
extend that run, and with it the witnesses of all its members, and a run that
is complete is appended to the level above, so earlier witnesses grow upward
by themselves.

On a cluster the leaves are numbered within their source without one task
for a source, and aligned blocks of 4096 (three levels) are appended to
independently. The roots of the blocks are the appends of the next table, and
so on until a source has one block. On the way back the blocks' witnesses
extend those of their members.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltables.llm.common import documents, query
from moltables.operators.ordered import ordered
from moltables.session import stable

ARITY = 16
#: Levels of a block's tree, and its nodes.
LEVELS = 3
BLOCK = ARITY**LEVELS
DIGEST = 64  # characters of a digest as text


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


class Run:
    """Up to 16 sibling nodes; ``up`` is where their hash went, once they are complete."""

    __slots__ = ("members", "up")

    def __init__(self) -> None:
        self.members: list[bytes] = []
        self.up: tuple[Run, int] | None = None


class Append:
    """A growing tree: ``append`` returns a node's witness, which later appends extend."""

    def __init__(self) -> None:
        self.open = [Run()]
        self.top: Run | None = None

    def append(self, node: bytes, level: int = 0) -> tuple[Run, int]:
        if level == len(self.open):
            self.open.append(Run())
        run = self.open[level]
        run.members.append(node)
        place = len(run.members) - 1
        if place + 1 == ARITY:
            self.open[level] = Run()
            run.up = self.append(digest(b"".join(run.members)), level + 1)
        return run, place

    def finish(self, levels: int | None = None) -> bytes:
        """Complete the open runs and return the root: the node left alone, or the one ``levels`` up, however few nodes there are."""
        level = 0
        while True:
            run = self.open[level]
            alone = len(run.members) == 1 and not any(r.members for r in self.open[level + 1:])
            if level == levels or (levels is None and alone):
                self.top = run
                return run.members[0]
            if run.members:
                self.open[level] = Run()
                run.up = self.append(digest(b"".join(run.members)), level + 1)
            level += 1

    def path(self, witness: tuple[Run, int]) -> list[tuple[int, bytes]]:
        """(place, members of the run) from a node up to below the root, after ``finish``."""
        out = []
        run, place = witness
        while run is not self.top:
            out.append((place, b"".join(run.members)))
            run, place = run.up
        return out


def fold(node: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a node and its siblings give."""
    for place, run in path:
        node = digest(run[:DIGEST * place] + node + run[DIGEST * (place + 1):])
    return node


def siblings(path: list[tuple[int, bytes]]) -> bytes:
    """The other members of the runs, level by level, left to right."""
    return b"".join(run[:DIGEST * place] + run[DIGEST * (place + 1):] for place, run in path)


def encoded(value: Column) -> Column:
    """A value of a leaf: `-` for null, else its UTF-8 length, a colon and the value."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def _block(d: DataFrame) -> DataFrame:
    return d.withColumn("block", F.floor(F.col("at") / BLOCK).cast("long"))


def _appended(nodes: pa.Table, levels: int | None) -> tuple[Append, list[tuple[Run, int]], bytes]:
    tree = Append()
    witnesses = [tree.append(n.hex().encode()) for n in nodes.column("node").to_pylist()]
    return tree, witnesses, tree.finish(levels)


def _block_root(nodes: pa.Table) -> pa.Table:
    nodes = nodes.sort_by("at")
    lifted, alone = _appended(nodes, LEVELS)[2], _appended(nodes, None)[2]
    return pa.table({"key": nodes.column("key")[:1], "at": nodes.column("block")[:1], "node": pa.array([bytes.fromhex(lifted.decode())]), "single": pa.array([bytes.fromhex(alone.decode())])})


_WITNESS = "alone boolean, runs array<struct<place: int, run: binary>>, subroot string, root string"
_RUNS = pa.list_(pa.struct([("place", pa.int32()), ("run", pa.binary())]))


def _above(witness: pa.Table) -> tuple[dict, list[tuple[int, bytes]]]:
    w = witness.to_pylist()[0]
    return w, [(r["place"], r["run"]) for r in w["runs"]]


def _extend(nodes: pa.Table, witness: pa.Table) -> pa.Table:
    """Witnesses of a block's nodes: their own paths, extended by the block's."""
    nodes = nodes.sort_by("at")
    w, above = _above(witness)
    tree, found, _ = _appended(nodes, None if w["alone"] else LEVELS)
    runs = [[{"place": p, "run": r} for p, r in tree.path(f) + above] for f in found]
    n = len(runs)
    return pa.table({"key": nodes.column("key"), "at": nodes.column("at"), "alone": pa.array([False] * n), "runs": pa.array(runs, _RUNS), "subroot": pa.array([w["subroot"]] * n, pa.string()), "root": pa.array([w["root"]] * n, pa.string())})


_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(leaves: pa.Table, witness: pa.Table) -> pa.Table:
    """Each leaf's proof, and the root that its forged form folds to."""
    leaves = leaves.sort_by("at")
    w, above = _above(witness)
    tree, found, _ = _appended(leaves, None if w["alone"] else LEVELS)
    proofs, folded, shared = [], [], None
    for node, forged, (run, place) in zip(leaves.column("node").to_pylist(), leaves.column("forged").to_pylist(), found):
        if shared is None or shared[0] is not run:  # the path above a run is that of all its members
            rest = (tree.path(run.up) if run is not tree.top else []) + above
            shared = (run, rest, siblings(rest), [] if run is tree.top else [b"".join(run.members)])
        _, rest, others, own = shared
        proofs.append(hashlib.sha256(siblings([(place, r) for r in own]) + others).hexdigest())
        folded.append(fold((node if forged is None else forged).hex().encode(), [(place, r) for r in own] + rest).decode())
    n = len(proofs)
    return pa.table({
        "doc_id": leaves.column("doc_id"), "leaf": pa.array([x.hex() for x in leaves.column("node").to_pylist()]), "subroot": pa.array([w["subroot"]] * n, pa.string()),
        "root": pa.array([w["root"]] * n, pa.string()), "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded), "verified": pa.array([f == w["root"] for f in folded])})


@dataclass(frozen=True)
class Forest:
    """Trees of several keys: ``tables[0]`` holds the nodes, ``tables[k]`` the blocks of keys with several blocks of level k - 1."""

    tables: list[DataFrame]
    tops: list[DataFrame]  # (key, node) of the keys that end at each level

    def roots(self) -> DataFrame:
        out = self.tops[0]
        for t in self.tops[1:]:
            out = out.unionByName(t)
        return out

    def block_witnesses(self, of_keys: DataFrame) -> DataFrame:
        """(key, at, alone, runs, subroot, root) of each block of the nodes, from (key, runs, subroot, root) of each key."""
        out = None
        for k in range(len(self.tops) - 1, -1, -1):
            ended = self.tops[k].select("key").join(of_keys, "key").select("key", F.lit(0).cast("long").alias("at"), F.lit(True).alias("alone"), "runs", "subroot", "root")
            out = stable(ended if out is None else ended.unionByName(extended(self.tables[k + 1], out)))
        return out


def extended(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Witnesses of nodes from those of their blocks."""
    n, b = _block(nodes.select("key", "at", "node")), blocks.withColumnRenamed("at", "block")
    return n.groupBy("key", "block").cogroup(b.groupBy("key", "block")).applyInArrow(_extend, f"key string, at long, {_WITNESS}")


def forest(nodes: DataFrame) -> Forest:
    """Append the nodes (key, at, node) of each key; ``at`` counts from 0 without gaps. Each level is written once."""
    tables, tops = [nodes], []
    while True:
        roots = stable(_block(tables[-1].select("key", "at", "node")).groupBy("key", "block").applyInArrow(_block_root, "key string, at long, node binary, single binary"))
        last = roots.groupBy("key").agg(F.max("at").alias("last"), F.min_by("single", "at").alias("node"))
        tops.append(last.filter("last = 0").select("key", "node"))
        more = last.filter("last > 0").select("key")
        if more.isEmpty():
            return Forest(tables, tops)
        tables.append(stable(roots.join(more, "key", "left_semi").select("key", "at", "node")))


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``at``, the place from 0 within the keys; no task holds a whole key."""
    return stable(ordered(rows, keys, order, hot=True).row_number("at").result().withColumn("at", F.col("at") - 1))


@dataclass(frozen=True)
class Manifest:
    """leaves (key, at, doc_id, node, forged), blocks (witness of each 4096 leaves) and sources (key, node, runs, root)."""

    leaves: DataFrame
    blocks: DataFrame
    sources: DataFrame

    def proofs(self) -> DataFrame:
        """One row for each leaf, its proof hashed, and what its forged form, if any, folds to."""
        n, b = _block(self.leaves), self.blocks.withColumnRenamed("at", "block")
        return n.groupBy("key", "block").cogroup(b.groupBy("key", "block")).applyInArrow(_prove, _PROOF)

    def witnesses(self) -> DataFrame:
        """(key, at, runs, ...) of each leaf: the members of all runs on its way to the root, and its place in them."""
        return extended(self.leaves, self.blocks).drop("alone")


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", values: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), forged: dict[str, Column] | None = None) -> Manifest:
    """Manifest of all rows; ``forged`` replaces values in the form that is checked against it.

    Null values are `-`, a null source is a source of its own and the first.
    Rows without an id come first in their source; rows with one id stand by
    their digests, so repeated rows are leaves beside each other. Empty texts
    are values of length 0. An empty table has an empty manifest. Other columns
    are not read.
    """
    forged = forged or {}
    at = lambda c: F.col(f"`{c}`")
    node, seen = leaf_digest(*[at(v) for v in values]), leaf_digest(*[forged.get(v, at(v)) for v in values])
    d = docs.select(F.coalesce(F.concat(F.lit("="), at(source_col)), F.lit("-")).alias("key"), at(id_col).cast("long").alias("doc_id"), node.alias("node"), seen.alias("seen"))
    d = d.withColumn("forged", F.when(F.col("seen") != F.col("node"), F.col("seen"))).drop("seen")
    leaves = numbered(d, ["key"], ["doc_id", "node"])
    trees = forest(leaves)
    tops = numbered(stable(trees.roots()), [], ["key"])
    whole = forest(tops.select(F.lit("").alias("key"), "at", "node"))
    top = whole.roots().select("key", F.array().cast("array<struct<place: int, run: binary>>").alias("runs"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("node")).alias("root"))
    above = extended(whole.tables[0], whole.block_witnesses(top))
    sources = stable(tops.join(above.select("at", "runs", "root"), "at").select("key", "node", "runs", "root"))
    blocks = trees.block_witnesses(sources.select("key", "runs", F.lower(F.hex("node")).alias("subroot"), "root"))
    return Manifest(leaves, blocks, sources)


def _level_sql(name: str, depth: int) -> str:
    """Runs of a forest (key, pos, node) level by level; a key with one node left keeps it."""
    out = f"{name}0 as (select *, count(*) over (partition by key) n from {name})"
    for k in range(depth):
        out += f""",
{name}r{k} as (select key, pos // 16 pos, any_value(n) n, list(node order by pos) nodes from {name}{k} group by key, pos // 16),
{name}{k + 1} as (select key, pos, case when n = 1 then nodes[1] else sha256(array_to_string(nodes, '')) end node, count(*) over (partition by key) n from {name}r{k})"""
    return out


def _path_sql(name: str, source: str, depth: int, columns: str) -> str:
    """Siblings and fold of each row of ``source`` (key, pos, fold, proof), level by level."""
    out, last = "", source
    for k in range(depth):
        place = f"((p.pos // {16 ** k}) % 16)::int"
        others = f"list_concat(nodes[:{place}], nodes[{place} + 2:])"
        mended = f"list_concat(nodes[:{place}], [fold], nodes[{place} + 2:])"
        out += f""",
{source}p{k} as (select {columns}, p.key, p.pos, case when n = 1 then proof else proof || array_to_string({others}, '') end proof,
  case when n = 1 then fold else sha256(array_to_string({mended}, '')) end fold from {last} p join {name}r{k} r on r.key = p.key and r.pos = p.pos // {16 ** (k + 1)})"""
        last = f"{source}p{k}"
    return out


_E = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
_LETTERS = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF = " || ".join(_E(c) for c in ("doc_id", "source", "lang", "n_chars"))
_DEPTH = 5
_SQL = f"""
with d as (select *, sha256({_LEAF} || {_E('text')}) leaf, sha256({_LEAF} || {_E(_LETTERS)}) lowered,
  xor(list_reduce(flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: list_transform(range(8), lambda k: ((ascii(c) >> k::int) & 1)::bigint))),
    lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1)), 4294967295::bigint), 4294967295::bigint) crc from documents),
l as (select doc_id, coalesce('=' || source, '-') key, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 pos, leaf node, leaf,
  case when crc % 5 = 0 then lowered else leaf end fold, '' proof from d),
{_level_sql('l', _DEPTH)},
s as (select '' key, row_number() over (order by l.key) - 1 pos, l.key source, node, node fold, '' proof from l{_DEPTH} l),
{_level_sql('s', _DEPTH)}
{_path_sql('l', 'l', _DEPTH, 'doc_id, leaf')},
q as (select p.doc_id, p.leaf, s.key, s.pos, s.node subroot, p.fold, p.proof from lp{_DEPTH - 1} p join s on s.source = p.key)
{_path_sql('s', 'q', _DEPTH, 'doc_id, leaf, subroot')}
select doc_id, leaf, subroot, t.node root, sha256(proof) proof_sha256, fold folded_root, fold = t.node verified from qp{_DEPTH - 1}, s{_DEPTH} t
"""


@query(_SQL)
def op12_merkle_manifest(spark, sf_dir):
    """Leaf, subroot, root and proof of each document, and the root that its text folds to if capitals of some are lowered."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(documents(spark, sf_dir), forged={"text": F.when(hit, lowered).otherwise(F.col("text"))}).proofs()
