"""Near-duplicate documents: n-gram Jaccard join as a blocked sparse product of document by n-gram incidence.

A document is the set of its distinct word shingles, each as a 64-bit hash.
Rows of the incidence matrix are documents, columns are shingles; the product
of the matrix with its transpose counts shared shingles per pair. Only a
pair that can reach the threshold matters, so:

* documents of equal sets become one row (their class is one node);
* of a set of n shingles only the first n - ceil(t n) + 1 enter the product
  ("prefix"), in one order for all documents: rare before frequent, then by
  hash. Pairs at or above t share a shingle of both prefixes;
* the product runs in blocks of columns (shuffled by shingle), and a long
  column is cut into blocks of rows, so that no task holds a whole hot column;
* an entry of the product is discarded when the sizes, or what the places of
  the shared shingle leave, cannot reach the overlap that t needs.

Links are wanted as connected components, so a column is first multiplied
with its first row only (a star), the surviving pairs are verified on the
whole sets, and afterwards only rows of different components meet. A group of
thousands of near copies is joined by its star; no link between different
components is lost, because their pairs are all tried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltables.llm.common import documents, query, slices, with_bytes
from moltables.llm.components import components
from moltables.session import forget, shuffle_width, stable

WIDTH = 5
PERCENT = 75
#: Shingles in more documents than these are put later in the common order, level by level.
LEVELS = (8, 128, 2048)
#: Bits of a bitmap over hashes (4 MB each, whatever the size of the corpus).
BITS = 1 << 25
#: Rows of a column that the others are tried against first.
CENTRES = 4
#: Bits of a set's parity signature, looked at in columns of more than ``CROWD`` rows.
SIGNATURE = 512
CROWD = 8
ROW_BLOCK = 512

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


#: A word's hash is a polynomial of random byte values modulo 2**64. Texts are hashed in pieces of at most so many bytes.
_PIECE = 1 << 18
_RANDOM = np.random.default_rng(20)
_VALUES = _RANDOM.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_BASE = 0x9FB21C651E98DF25
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_PIECE, _BASE, np.uint64)]), dtype=np.uint64)
_INVERSES = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_PIECE, pow(_BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
_IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def _hashes_of_piece(data: np.ndarray) -> np.ndarray:
    space = np.concatenate([[True], _IS_SPACE[data], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUES[data] * _POWERS[:len(data)], dtype=np.uint64)])
    h = (sums[ends] - sums[starts]) * _INVERSES[starts]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of each word of a text, in order."""
    text = text.lower()  # on bytes: ASCII only, as is the white space
    if len(text) <= _PIECE:
        return _hashes_of_piece(np.frombuffer(text, np.uint8))
    out, at = [], 0
    while at < len(text):
        to = min(at + _PIECE, len(text))
        if to < len(text):  # end the piece after a white space
            cut = max(text.rfind(bytes([c]), at, to) for c in (32, 9, 10, 11, 12, 13)) + 1
            if cut <= at:  # one word longer than a piece: its parts are folded together
                end = min((i for i in (text.find(bytes([c]), to) for c in (32, 9, 10, 11, 12, 13)) if i >= 0), default=len(text))
                out.append(np.array([xxhash.xxh3_64_intdigest(text[at:end])], np.uint64))
                at = end
                continue
            to = cut
        out.append(_hashes_of_piece(np.frombuffer(text, np.uint8, to - at, at)))
        at = to
    return np.concatenate(out)


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; a text with fewer words is one shingle, one without words none.

    A shingle's hash is a sum of its words' 64-bit hashes, each times an odd
    factor of its own.
    """
    h = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(h):
        return np.zeros(0, np.int64)
    if len(h) < width:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64).view(np.int64)
    n = len(h) - width + 1
    acc = h[:n] * _FACTORS[0]
    for i in range(1, width):
        acc += h[i:i + n] * (_FACTORS[i % 5] + np.uint64(2 * i))
    acc.sort()
    keep = np.empty(n, bool)
    keep[0] = True
    np.not_equal(acc[1:], acc[:-1], out=keep[1:])
    return acc[keep].view(np.int64)


def _prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1 if n else 0


def _first_prefixes(percent: int, width: int):
    """Per document the prefix by hash order, to find frequent shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s[:_prefix_length(len(s), percent)] for s in sets] or [np.zeros(0, np.int64)]))], ["h"])
    return run


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits of all hashes in a column, modulo ``BITS``: at most ``BITS`` / 64 rows come to the driver."""
    bit = F.pmod(F.col(column), F.lit(BITS))
    got = (hashes.select(F.shiftright(bit, 6).alias("w"), F.pmod(bit, F.lit(64)).cast("int").alias("b"))
           .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).toPandas())
    out = np.zeros(BITS // 64, np.int64)
    out[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64)
    return out


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & (BITS - 1)
    return (bits[bit >> 6] >> (bit & 63)) & 1 == 1


def signature(s: np.ndarray) -> list[int]:
    """Parity of a set's hashes by bit. Each element of the symmetric difference of two sets flips one bit, so the bits that differ are no more."""
    odd = np.bincount((s >> 20) & (SIGNATURE - 1), minlength=SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _rows(percent: int, width: int, frequent):
    """Per document its set size, a 128-bit digest of the set, its signature, and the prefix in the common order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for b in slices(batches):
            sizes, keys, signs, prefixes = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t, width)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                signs.append(signature(s))
                level = sum(_has(bits, s).astype(np.int8) for bits in often)
                if level.any():
                    s = np.concatenate([s[level == k] for k in range(len(often) + 1)])
                prefixes.append(s[:_prefix_length(len(s), percent)])
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            flat = np.concatenate(prefixes or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["doc_id", "n", "key", "sig", "prefix"])
    return run


def _sets(width: int, wanted):
    """Whole sets of the documents whose ids are in a bitmap (and of a few more, whose ids share a bit)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            b = b.filter(pa.array(_has(wanted.value, b.column("hash").to_numpy())))
            sets = [shingle_set(t, width) for t in b.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "grams"])
    return run


def needed(n: Column, m: Column, percent: int) -> Column:
    """Least overlap of sets of n and m shingles whose Jaccard similarity is at least ``percent``."""
    return F.ceil((n + m) * percent / F.lit(100 + percent) - F.lit(1e-9))


def _needed_alone(n: Column, percent: int) -> Column:
    """Least overlap of a set of n shingles with any set that is similar enough."""
    return F.ceil(n * percent / F.lit(100) - F.lit(1e-9))


def _reachable(a: str, b: str, percent: int) -> Column:
    """Size-derived bounds: the sizes allow the threshold, and so does what is left from the shared shingle on."""
    n, m, i, j = (F.col(c) for c in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
    return ((100 * F.least(n, m) >= percent * F.greatest(n, m))
            & (F.least(n - i, m - j) + F.least(i, j) >= needed(n, m, percent)))


def _accumulated(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose shared prefix shingles leave the threshold within reach.

    Of two prefixes the one that ends first in the common order has met all it
    shares with the other set, so the overlap is at most the count here plus
    what follows that prefix.
    """
    d = entries.groupBy("a", "b", "n", "m").count()
    after = lambda c: _needed_alone(F.col(c), percent) - 1  # noqa: E731  set size less prefix length
    return d.filter(F.col("count") + F.greatest(after("n"), after("m")) >= needed(F.col("n"), F.col("m"), percent)).select("a", "b").distinct()


def _differing(a: Column, b: Column) -> Column:
    bits = [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SIGNATURE // 64)]
    return sum(bits[1:], bits[0])


def _signed(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures differ in no more bits than the symmetric difference may have elements."""
    side = lambda c: signs.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    n, m = F.col("na"), F.col("nb")
    d = pairs.join(side("a"), "a").join(side("b"), "b")
    return d.filter(_differing(F.col("sa"), F.col("sb")) <= n + m - 2 * needed(n, m, percent)).select("a", "b").distinct()


def _verified(pairs: DataFrame, signs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Those of the written pairs whose whole sets reach the threshold, written; ``pairs`` is deleted.

    Signatures go first. Then only the texts of the pairs left are cut into
    shingles again; a bitmap of their ids, of a fixed size, finds them where
    they are, without a shuffle.
    """
    candidates, pairs = pairs, stable(_signed(pairs, signs, percent))
    forget(candidates)
    wanted = bitmap(pairs.select(F.explode(F.array("a", "b")).alias("d")).select(F.xxhash64("d").alias("hash")), "hash")
    shared = texts.sparkSession.sparkContext.broadcast(wanted)
    sets = stable(texts.withColumn("hash", F.xxhash64("doc_id")).mapInArrow(_sets(width, shared), "doc_id long, grams array<long>"))
    d = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga")), "a")
         .join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb")), "b"))
    both = F.size(F.array_intersect("ga", "gb"))
    out = stable(d.filter(100 * both >= percent * (F.size("ga") + F.size("gb") - both)).select("a", "b").distinct())
    forget(pairs, sets)
    return out


def _with_weight(columns: DataFrame, percent: int) -> DataFrame:
    """Add weight: rows of the columns that a document's prefix is in, for each shingle of the prefix.

    The original of a group of near copies has only shingles that most of
    them share, and so the greatest weight.
    """
    rows = stable(columns.groupBy("h").agg(F.count("*").alias("rows")))
    per = columns.join(rows, "h").groupBy("doc", "n").agg((F.sum("rows") / (F.col("n") - _needed_alone(F.col("n"), percent) + 1)).alias("weight"))
    per = stable(per)
    out = stable(columns.join(per, ["doc", "n"]))
    forget(rows, per)
    return out


def _column_stars(columns: DataFrame, percent: int) -> DataFrame:
    """Each column times its few weightiest rows: pairs (centre, other document) within the bounds."""
    order = Window.partitionBy("h").orderBy(F.desc("weight"), "doc", "n")
    first = columns.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= CENTRES)
    first = stable(first.select("h", "doc", "n", "pos"))
    d = columns.alias("q").join(first.alias("p"), "h").filter(F.col("q.doc") != F.col("p.doc")).filter(_reachable("p", "q", percent))
    out = stable(_accumulated(d.select(F.col("p.doc").alias("a"), F.col("q.doc").alias("b"), F.col("p.n").alias("n"), F.col("q.n").alias("m")), percent))
    forget(first)
    return out


def _close(a: str, b: str, percent: int) -> Column:
    """The test of signatures, where both rows have one."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return F.coalesce(_differing(F.col(f"{a}.sig"), F.col(f"{b}.sig")) <= n + m - 2 * needed(n, m, percent), F.lit(True))


def _column_products(columns: DataFrame, comp: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Entries of the product between rows of different components, in blocks of rows.

    A column of one component has nothing left to find. The rows of the other
    columns are dealt by a hash into blocks of about ``ROW_BLOCK``; each pair
    of blocks is one key, so a hot column is spread over many tasks. Rows of
    the same component never meet, and in crowded columns only rows meet
    whose signatures allow the threshold.
    """
    c = columns.join(comp.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("c", F.coalesce("component", "doc"))
    c = stable(c.select("h", "doc", "n", "pos", "c"))
    open_ = stable(c.groupBy("h").agg(F.count("*").alias("rows"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("h", "rows"))
    rows = c.join(open_, "h").select("h", "doc", "n", "pos", "c", "rows")
    crowded = rows.filter(F.col("rows") > CROWD).join(signs.select(F.col("doc_id").alias("doc"), "n", "sig"), ["doc", "n"])
    rows = rows.filter(F.col("rows") <= CROWD).withColumn("sig", F.lit(None).cast("array<long>")).unionByName(crowded)
    rows = rows.withColumn("k", F.ceil(F.col("rows") / ROW_BLOCK).cast("int")).drop("rows").withColumn("r", F.pmod(F.xxhash64("doc"), "k").cast("int"))
    dealt = stable(rows)
    rows = dealt.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    names = ["h", "doc", "n", "pos", "c", "sig"]
    left = rows.select(*names, F.col("r").alias("x"), F.col("s").alias("y"))
    right = rows.select(*names, F.col("s").alias("x"), F.col("r").alias("y"))
    d = left.alias("p").join(right.alias("q"), ["h", "x", "y"]).filter((F.col("p.doc") < F.col("q.doc")) & (F.col("p.c") != F.col("q.c")))
    d = d.filter(_reachable("p", "q", percent) & _close("p", "q", percent))
    out = stable(_accumulated(d.select(F.col("p.doc").alias("a"), F.col("q.doc").alias("b"), F.col("p.n").alias("n"), F.col("q.n").alias("m")), percent))
    forget(c, open_, dealt)
    return out


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    component_id is the smallest id reachable by links (the id itself where
    there are none). Null and blank texts have an empty set and no link. Rows
    of one id are one node, whatever their texts. A row with a null id links
    with nothing and has a null component. Other columns are not read.

    Bitmaps of fixed size say how frequent a shingle's hash is. They only order
    the shingles: any bits give the same links, good ones make fewer candidates.
    """
    spark = docs.sparkSession
    texts = with_bytes(docs, id_col, text_col)
    first = texts.mapInArrow(_first_prefixes(percent, width), "h long")
    counts = stable(first.groupBy("h").count().filter(F.col("count") > LEVELS[0]))
    frequent = spark.sparkContext.broadcast([bitmap(counts.filter(F.col("count") > n), "h") for n in LEVELS])
    rows = stable(texts.mapInArrow(_rows(percent, width, frequent), "doc_id long, n long, key binary, sig array<long>, prefix array<long>"))
    known = rows.filter("n > 0 and doc_id is not null")
    classes = stable(known.groupBy("key").agg(F.min("doc_id").alias("rep")))
    # A class is one node, named by its least id. An id with several texts is in several classes and ties them together.
    member = stable(known.select("doc_id", "key").join(classes, "key").select("doc_id", "rep"))
    several = member.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi")
    ties = member.join(several, "doc_id").select(F.col("lo").alias("a"), F.col("rep").alias("b"))
    reps = known.select("doc_id", "n", "key", "prefix").join(classes.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"])
    entries = reps.select(F.col("doc_id").alias("doc"), "n", F.posexplode("prefix").alias("pos", "h"))
    # The entries are the largest table by far, so this is their only shuffle: by column, two numbers in one.
    # Entries of repeated rows and columns of one row, which have no product, go before anything else is done.
    entries = entries.select("h", "doc", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("at"))
    dealt = stable(entries.repartition(shuffle_width(spark), "h").sortWithinPartitions("h", "doc", "at").mapInArrow(_drop_single, "h long, doc long, n long, pos int"))
    # The prefixes have been dealt; what is read from now on is a table without them.
    whole, rows = rows, stable(rows.drop("prefix"))
    known = rows.filter("n > 0 and doc_id is not null")
    forget(whole)
    columns = _with_weight(dealt, percent)
    forget(dealt, counts)
    links = stable(_verified(_column_stars(columns, percent), known, texts, percent, width).union(ties))
    comp = stable(components(links, "a", "b"))
    more = _verified(_column_products(columns, comp, known, percent), known, texts, percent, width)
    forget(columns)
    chain = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
    comp = stable(components(chain.union(more), "a", "b"))
    node = member.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    found = (node.join(comp, node["rep"] == comp["node"], "left")
             .select("doc_id", F.coalesce("component", "rep").alias("component")))
    return (rows.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, comp: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that stand for their component, with all their columns.

    Kept: the row whose id is the component (if the id is repeated, the least
    of its rows), every row of an empty set, and every row of a null id.
    ``comp`` is the written result of ``near_duplicate_components``.
    """
    names = docs.columns
    gone = comp.filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    again = comp.filter("n_shingles > 0 and component_id = doc_id").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_again"))
    again = stable(again)
    kept = docs.join(gone, docs[id_col] == F.col("_gone"), "left_anti")
    if again.isEmpty():
        return kept
    rest = kept.join(again, kept[id_col] == F.col("_again"), "left_anti")
    least = kept.join(again, kept[id_col] == F.col("_again"), "left_semi").groupBy(F.col(id_col).alias("_id")).agg(F.min(F.struct(*names)).alias("_row"))
    return rest.unionByName(least.select("_row.*"))


def _drop_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by ``h``, ``doc`` and ``at`` keep one of equal ones, and those whose ``h`` occurs again; a run may go on over batches."""
    def out(cols):
        h, doc, at = cols
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array(at >> 32), pa.array((at & 0xFFFFFFFF).astype(np.int32))], ["h", "doc", "n", "pos"])
    held = None  # last row of the batch before, and whether its column is known to have more rows
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy() for c in ("h", "doc", "at")]
        if held is not None:
            cols = [np.concatenate([x, c]) for x, c in zip(held[0], cols)]
        again = np.logical_and.reduce([c[1:] == c[:-1] for c in cols])
        cols = [c[np.concatenate([[True], ~again])] for c in cols]
        h = cols[0]
        same = h[1:] == h[:-1]
        keep = np.concatenate([[held is not None and held[1]], same]) | np.concatenate([same, [False]])
        yield out([c[:-1][keep[:-1]] for c in cols])
        held = ([c[-1:] for c in cols], bool(keep[-1]))
    if held is not None and held[1]:
        yield out(held[0])


_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w
  from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end g from w),
n as (select doc_id, len(g) n from s),
e as (select doc_id, unnest(list_transform(g, lambda x: hash(x))) h from s),
p as (select a.doc_id a, b.doc_id b, count(*) o from e a join e b on a.h = b.h and a.doc_id <> b.doc_id group by all),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * o >= 75 * (x.n + y.n - o)),
r(doc_id, c) as (select doc_id, doc_id from n union select l.b, r.c from r join l on l.a = r.doc_id)
select n.doc_id, n.n::bigint n_shingles, min(r.c) component_id from n join r using (doc_id) group by n.doc_id, n.n
"""


@query(_SQL)
def op5_ngram_jaccard_join(spark, sf_dir):
    """Near-duplicate components of all documents by five-word shingles at 75 percent."""
    return near_duplicate_components(documents(spark, sf_dir))
