"""How filters interact: what each one removes in every order, and its share over all orders.

One finite-state pass over the UTF-8 bytes of a text counts words, capitals,
code points and symbols: a byte's class and the state (between words, in a
word) look up the next state and the events in two tables. The spans of words
go into a hash table that compares bytes before it calls two words equal.
Numpy takes the lookups for a batch of texts at once; as a byte's class alone
decides the state after it, the states of a batch are one lookup, shifted by
a byte.

The counts become a bit for each failed filter, rows are added up by these
bits, and the 120 orders are worked out on at most 32 sums for each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltables.llm.common import documents, query, slices
from moltables.session import stable

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 100, 80, 10
#: Longer texts are read in pieces that end after a white space.
PIECE = 4 << 20
#: Words up to this many bytes are hashed and compared eight bytes at a time, longer ones one by one.
SHORT = 64

# Classes of bytes, events of the transducer, and its two tables (state by class).
SPACE, CAPITAL, SYMBOL, OTHER, LEAD, CONTINUED = range(6)
BEGIN, END, POINT, UPPER, MARK = 1, 2, 4, 8, 16
BETWEEN, INSIDE = 0, 1


def _classes() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[[32, *range(9, 14)]] = SPACE
    kind[65:91] = CAPITAL
    kind[list(b"#$%&*|")] = SYMBOL
    kind[128:192] = CONTINUED
    kind[192:] = LEAD
    return kind


CLASS = _classes()
NEXT = np.array([BETWEEN, INSIDE, INSIDE, INSIDE, INSIDE, INSIDE], np.uint8)  # the same from both states
EVENTS = np.array([
    [POINT, BEGIN | POINT | UPPER, BEGIN | POINT | MARK, BEGIN | POINT, BEGIN | POINT, BEGIN],
    [POINT | END, POINT | UPPER, POINT | MARK, POINT, POINT, 0],
], np.uint8).ravel()
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def transduce(data: np.ndarray) -> np.ndarray:
    """Events at each byte; the pass starts between words."""
    kind = CLASS[data]
    state = np.empty(len(data), np.uint8)
    state[:1] = BETWEEN
    state[1:] = NEXT[kind[:-1]]
    return EVENTS[state * np.uint8(6) + kind]


class _Spans:
    """Words of a padded buffer by start and length, with hashes and exact comparison."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.data, self.start, self.size = data, start, size
        self.eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # eight bytes from any place
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.cut = np.array([full >> np.uint64(64 - 8 * k) if k else 0 for k in range(9)], np.uint64)

    def chunk(self, at: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 7 of the words ``at``, zeros after their ends."""
        left = np.clip(self.size[at] - 8 * k, 0, 8)
        return self.eights[self.start[at] + 8 * k] & self.cut[left]

    def hashes(self) -> np.ndarray:
        h = self.size.astype(np.uint64) * _MIX[1]
        live = np.arange(len(self.start))
        for k in range(SHORT // 8):
            live = live[self.size[live] > 8 * k] if k else live
            if not len(live):
                break
            v = (h[live] ^ self.chunk(live, k)) * _MIX[0]
            h[live] = v ^ (v >> np.uint64(29))
        for i in np.flatnonzero(self.size > SHORT).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.word(i))
        return h * _MIX[1]

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.start[i] + self.size[i]].tobytes()

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of the words ``a`` and ``b`` are equal, pair by pair."""
        same = self.size[a] == self.size[b]
        for k in range(SHORT // 8):
            live = np.flatnonzero(same & (self.size[a] > 8 * k))
            if not len(live):
                break
            same[live] = self.chunk(a[live], k) == self.chunk(b[live], k)
        for i in np.flatnonzero(same & (self.size[a] > SHORT)).tolist():
            same[i] = self.word(a[i]) == self.word(b[i])
        return same


def first_of_each(spans: _Spans, group: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions of one word for each distinct (group, bytes), by an open hash table with linear probing.

    All words probe at once. A word that finds an empty slot takes it; one that
    finds an equal word, by group and bytes, is a repeat; the others go one slot on.
    """
    bits = max(4, int(2 * len(hashes)).bit_length())
    slot = ((hashes ^ (group.astype(np.uint64) * _MIX[0])) * _MIX[1] >> np.uint64(64 - bits)).astype(np.int64)
    table = np.full(1 << bits, -1, np.int64)
    todo = np.arange(len(hashes))
    while len(todo):
        s = slot[todo]
        free = table[s] < 0
        table[s[free]] = todo[free]
        held = table[s]
        maybe = (held != todo) & (hashes[held] == hashes[todo]) & (group[held] == group[todo])
        done = held == todo
        pairs = np.flatnonzero(maybe)
        done[pairs] = spans.equal(held[pairs], todo[pairs])
        todo = todo[~done]
        slot[todo] = (slot[todo] + 1) & ((1 << bits) - 1)
    return np.sort(table[table >= 0])


def _pass(texts: list[bytes]) -> tuple[np.ndarray, _Spans, np.ndarray, np.ndarray]:
    """(counts: words, capitals, code points, symbols by text; spans; text of each span; one span of each distinct word)."""
    data = np.frombuffer(b" ".join([*texts, bytes(8)]), np.uint8)  # a space ends each text
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    events = transduce(data[:n])
    start, end = np.flatnonzero(events & BEGIN), np.flatnonzero(events & END)
    owner = np.searchsorted(first, start, "right") - 1
    count = lambda bit: np.add.reduceat((events & bit != 0).astype(np.int64), first)
    counts = np.stack([np.bincount(owner, minlength=len(texts)), count(UPPER), count(POINT) - 1, count(MARK)], 1)
    spans = _Spans(data, start, end - start)
    return counts, spans, owner, first_of_each(spans, owner, spans.hashes())


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        to = at + PIECE
        if to < len(text):
            cut = max(text.rfind(bytes([c]), at, to) for c in (32, 9, 10, 11, 12, 13)) + 1
            if cut <= at:  # a word longer than a piece ends the piece
                cut = min((i + 1 for c in (32, 9, 10, 11, 12, 13) if (i := text.find(bytes([c]), to)) >= 0), default=len(text))
            to = cut
        yield text[at:to]
        at = to


def counted(texts: list[bytes]) -> np.ndarray:
    """(words, distinct words, capitals, code points, symbols) of each whole text."""
    out = np.zeros((len(texts), 5), np.int64)
    short = [i for i, t in enumerate(texts) if len(t) <= PIECE]
    if short:
        counts, _, owner, one = _pass([texts[i] for i in short])
        out[np.ix_(short, [0, 2, 3, 4])] = counts
        out[short, 1] = np.bincount(owner[one], minlength=len(short))
    for i in set(range(len(texts))) - set(short):
        known: set[bytes] = set()
        for piece in _pieces(texts[i]):
            counts, spans, _, one = _pass([piece])
            out[i, [0, 2, 3, 4]] += counts[0]
            known.update(map(spans.word, one.tolist()))
        out[i, 1] = len(known)
    return out


_FACTS = "doc_id long, part string, digest binary, n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long, fails int"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, most=2 << 20):
        c = counted([t or b"" for t in b.column("text").to_pylist()])
        words, distinct, capitals, points, symbols = c.T
        fails = (words < MIN_WORDS) | (100 * distinct < MIN_DISTINCT_PERCENT * words) << 1 | (100 * capitals > MAX_CAPITAL_PERCENT * points) << 2 | (symbols > 0) << 3
        cols = [b.column(n) for n in ("doc_id", "part", "digest")] + [pa.array(np.ascontiguousarray(x)) for x in c.T] + [pa.array(fails.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _FACTS.split(", ")])


def text_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, digest, counts, fails) of every row; ``fails`` has bits 1, 2, 4, 8 for filters A to D.

    Null text is empty, null part the empty string. ``digest`` is the SHA-256 of the text.
    """
    t = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.unhex(F.sha2(t, 256)).alias("digest"), t.alias("text"))
    return d.mapInArrow(_facts, _FACTS)


def labelled(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, digest, fails, good, toxic, n): equal rows added up, with the labels of their id.

    An id with several label rows has quality or toxic if one of them has it.
    Rows without an id have no label; they are spread by their text, away from each other.
    """
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = facts.groupBy("doc_id", "part", "digest", "fails").agg(F.count("*").alias("n"))
    rows = rows.withColumn("_id", F.coalesce("doc_id", F.lit(0))).withColumn("_none", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(4095)) + 1).otherwise(0))
    rows = rows.join(known.withColumn("_none", F.lit(0).cast("long")), ["_id", "_none"], "left")
    return rows.select("doc_id", "part", "digest", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")


def failure_sums(rows: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic) with bit 16 for filter E: a smaller id has the same text. At most 32 rows a part.

    Copies of a text are first added up by part and labels, which map tasks do
    before the shuffle; only these sums are compared within a text. Rows
    without an id neither fail E nor make others fail.
    """
    has = F.col("doc_id").isNotNull()
    groups = rows.groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.min(F.when(has, F.struct("doc_id", "n"))).alias("least"), F.sum("n").alias("n"), F.sum(F.when(has, 0).otherwise(F.col("n"))).alias("bare"))
    least = F.min("least.doc_id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("first", F.col("bare") + F.when(F.col("least.doc_id") == least, F.col("least.n")).otherwise(0))
    both = F.explode(F.array(F.struct(F.col("fails").alias("f"), F.col("first").alias("k")), F.struct((F.col("fails") + 16).alias("f"), (F.col("n") - F.col("first")).alias("k"))))
    d = groups.select("part", "good", "toxic", both.alias("x")).filter("x.k > 0")
    only = lambda c: F.sum(F.when(F.col(c), F.col("x.k")).otherwise(0))
    return d.groupBy("part", F.col("x.f").alias("fails")).agg(F.sum("x.k").alias("n"), only("good").alias("good"), only("toxic").alias("toxic"))


def over_orders(sums: DataFrame) -> DataFrame:
    """One row for each part, order and step, from the sums of each set of failed filters.

    ``shapley`` adds up what the step's filter removes in all 120 orders: a row that
    fails k filters is removed first by each of them in 120 / k orders.
    """
    d = sums.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sums"))
    d = d.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in ORDERS]))).withColumn("step", F.explode(F.array(*[F.lit(k) for k in range(1, 6)])))
    bit = lambda k: F.expr(f"shiftleft(1, ascii(substr(filter_order, {k}, 1)) - 65)")
    d = d.withColumn("own", bit("step")).withColumn("earlier", sum((F.when(F.col("step") > k, bit(str(k))).otherwise(0) for k in range(1, 5)), F.lit(0)))
    own, earlier = (lambda s: s["fails"].bitwiseAND(F.col("own")) != 0), (lambda s: s["fails"].bitwiseAND(F.col("earlier")) != 0)

    def total(keep, value=lambda s: s["n"]) -> Column:
        return F.aggregate(F.filter("sums", keep), F.lit(0).cast("long"), lambda acc, s: acc + value(s))
    removed = lambda s: own(s) & ~earlier(s)
    return d.select(
        "part", "filter_order", "step", total(lambda s: ~own(s) & ~earlier(s)).alias("kept"), total(removed).alias("removed"),
        total(lambda s: own(s) & earlier(s)).alias("redundant"), total(lambda s: s["fails"] == F.col("own")).alias("unique_fails"),
        total(removed, lambda s: s["good"]).alias("good_lost"), total(removed, lambda s: s["toxic"]).alias("toxic_lost"),
        total(own, lambda s: s["n"] * (F.lit(120) / F.bit_count(s["fails"])).cast("long")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What filters A to E do to the rows of each part, in every order and at every step.

    Null and empty texts fail A only (and E as copies of each other). Repeated
    rows count each time; with one id and text, none is a copy of the other.
    Other columns are not read. An empty table has no parts, so no rows.
    """
    return over_orders(failure_sums(labelled(stable(text_facts(docs, id_col, text_col, part_col)), labels)))


_SQL = r"""
with t as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') w from t),
f as (select w.doc_id, part, coalesce(l.quality = 1, false) good, coalesce(l.toxic = 1, false) toxic,
  case when len(w) < 100 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 80 * len(w) then 'B' else '' end
  || case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) then 'C' else '' end || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
  || case when w.doc_id > min(w.doc_id) over (partition by t) then 'E' else '' end fails
  from w left join labels l on l.doc_id = w.doc_id),
m as (select part, fails, count(*) n, count_if(good) good, count_if(toxic) toxic from f group by part, fails),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
o as (select a.x || b.x || c.x || d.x || e.x filter_order from l a, l b, l c, l d, l e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step::int step, substr(filter_order, step, 1) own, substr(filter_order, 1, step - 1) earlier from o, range(1, 6) r(step)),
j as (select m.part, s.filter_order, s.step, own, contains(fails, own) fails_own, step > 1 and len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 gone,
  fails = own alone, n, good, toxic from m, s),
r as (select part, filter_order, step, own, sum(if(not fails_own and not gone, n, 0)) kept, sum(if(fails_own and not gone, n, 0)) removed,
  sum(if(fails_own and gone, n, 0)) redundant, sum(if(alone, n, 0)) unique_fails, sum(if(fails_own and not gone, good, 0)) good_lost,
  sum(if(fails_own and not gone, toxic, 0)) toxic_lost from j group by all)
select part, filter_order, step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails,
  good_lost::bigint good_lost, toxic_lost::bigint toxic_lost, (sum(removed) over (partition by part, own))::bigint shapley from r
"""


@query(_SQL)
def op13_filter_audit(spark, sf_dir):
    """Five filters over all documents, by language, order and step."""
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
