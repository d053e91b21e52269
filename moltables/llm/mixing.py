"""Mixing sources to target weights by a temperature.

A source's weight is its token share to a power between 0 (all equal) and 1
(as found). The power is bisected to meet a target: a largest repetition of
any source against the least repeated one, or a least entropy. The weights
become token budgets, and each source meets its budget by whole epochs of
its blocks in a permuted order and, at the end, a part of one more epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltables.llm.common import documents, query, words
from moltables.session import stable

MAX_REPETITION = 1.5
HALVINGS = 20
#: A source is cut into blocks of about so many tokens, at most ``MAX_BLOCKS``; blocks grow with larger sources.
BLOCK_TOKENS = 20_000
MAX_BLOCKS = 65_536
SEED = 11


def place(*parts: Column) -> Column:
    """A pseudo-random number from 0 to 2**60 - 1, the same in every engine: 15 hex digits of an md5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_shares(tokens: DataFrame) -> DataFrame:
    """(source, tokens, share) of sources with tokens; a null source is one of its own."""
    d = stable(tokens.groupBy("source").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"))
    total = d.agg(F.sum("tokens")).first()[0]
    return d.withColumn("share", F.col("tokens") / F.lit(total or 1).cast("double"))


def _meets(power: float, max_repetition: float | None, min_entropy: float | None) -> Column:
    w = F.pow("share", F.lit(power))
    if max_repetition is not None:
        rep = F.pow("share", F.lit(power - 1.0))
        return F.max(rep) <= F.lit(max_repetition) * F.min(rep)
    # With z = sum(w), the entropy of w / z is log z - sum(w log w) / z.
    return F.log(F.sum(w)) - F.sum(w * F.log(w)) / F.sum(w) >= F.lit(min_entropy)


def bisected_power(shares: DataFrame, max_repetition: float | None = None, min_entropy: float | None = None, halvings: int = HALVINGS) -> float:
    """The power, to 2**-halvings, that meets the target.

    A limit of the repetition asks for the least power that keeps it, an
    entropy for the greatest power that reaches it (0 if none does). A job
    tries the 15 powers of four halvings at once; only these answers come
    to the driver.
    """
    if (max_repetition is None) == (min_entropy is None):
        raise ValueError("give a limit of the repetition or an entropy")
    lo, width = 0, 1 << halvings
    ends = shares.agg(_meets(0.0, max_repetition, min_entropy), F.count("*")).first()
    if not ends[1] or (max_repetition is not None and ends[0]):
        return 0.0
    while width > 1:
        n = min(16, width)
        step = width // n
        tried = shares.agg(*[_meets((lo + k * step) / (1 << halvings), max_repetition, min_entropy).alias(f"t{k}") for k in range(1, n)]).first()
        if max_repetition is not None:  # not met up to some power, met from there on
            k = sum(not x for x in tried)
        else:
            k = sum(bool(x) for x in tried)
        lo, width = lo + k * step, step
    return (lo + 1) / (1 << halvings) if max_repetition is not None else lo / (1 << halvings)


def with_budgets(shares: DataFrame, power: float, budget_tokens: int | None = None) -> DataFrame:
    """Add weight (sums to one), budget (whole tokens) and epochs (whole passes).

    Without a total budget the least one is taken that repeats every source
    at least once, so that no document is lost.
    """
    d = shares.withColumn("w", F.pow("share", F.lit(float(power))))
    total = d.agg(F.sum("w"), F.max(F.col("tokens") / F.col("w"))).first()
    z, least = total[0] or 1.0, total[1] or 0.0
    scale = least if budget_tokens is None else budget_tokens / z  # tokens for each unit of w
    d = d.withColumn("weight", F.col("w") / F.lit(z)).withColumn("budget", F.floor(F.col("w") * F.lit(float(scale)) + 1e-6).cast("long"))
    return d.withColumn("epochs", F.floor(F.col("budget") / F.col("tokens")).cast("long")).drop("w")


def _order(seed: int, epoch: Column) -> Column:
    return place(F.lit(seed), epoch, F.col("block"))


def with_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Add _id, _source, _tokens (words) and _rest (md5 of the text, telling rows of one id apart)."""
    t = F.col(text_col)
    return docs.withColumns({"_id": F.col(id_col).cast("long"), "_source": F.col(source_col), "_tokens": F.size(words(t)).cast("long"), "_rest": F.md5(F.coalesce(t, F.lit("")))})


def with_places(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Add epochs, extra (tokens of the part of one more epoch), at (a row's place) and block, by the source of a row.

    The table of sources has one row for each source; whether it is broadcast
    is left to its size, and else the hot source is split by the skew join.
    """
    blocks = F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("long")
    own = sources.select(F.col("source").alias("_s"), "epochs", (F.col("budget") - F.col("epochs") * F.col("tokens")).alias("extra"), blocks.alias("_blocks"))
    d = rows.join(own, F.col("_source").eqNullSafe(F.col("_s")), "left").withColumn("at", place(F.lit(seed), F.col("_id"), F.col("_rest")))
    return d.withColumn("block", F.pmod("at", F.coalesce("_blocks", F.lit(1)))).drop("_s", "_blocks")


def last_epochs(placed: DataFrame, seed: int) -> DataFrame:
    """(source, block, fits, cut) of the blocks that a source's last, partial epoch takes.

    Blocks are taken in the epoch's order while they fit wholly; of the next
    one the rows up to ``cut`` (place, id, rest), in that order, while they
    fit. Only block totals are walked for each source, and the rows of one
    block.
    """
    part = placed.filter("extra > 0 and _tokens > 0")
    totals = part.groupBy("_source", "block", "epochs", "extra").agg(F.sum("_tokens").alias("n"))
    w = Window.partitionBy("_source").orderBy(_order(seed, F.col("epochs") + 1), "block").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("upto", F.sum("n").over(w)).withColumn("room", F.col("extra") - F.col("upto") + F.col("n")).filter("room > 0")
    taken = stable(totals.select(F.col("_source").alias("_s"), F.col("block").alias("_b"), (F.col("upto") <= F.col("extra")).alias("fits"), "room"))
    here = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))
    by = Window.partitionBy("_s").orderBy("at", "_id", "_rest").rowsBetween(Window.unboundedPreceding, 0)
    some = part.join(taken.filter("not fits"), here).withColumn("sum", F.sum("_tokens").over(by)).filter("sum <= room")
    cut = some.groupBy("_s").agg(F.max(F.struct("at", "_id", "_rest")).alias("cut")).withColumnRenamed("_s", "_c")
    return stable(taken.join(cut, F.col("_s").eqNullSafe(F.col("_c")) & ~F.col("fits"), "left").select("_s", "_b", "fits", "cut"))


def with_copies(placed: DataFrame, last: DataFrame) -> DataFrame:
    """Add copies: the epochs that hold a row. Rows without tokens, and of sources without any, have one."""
    here = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))
    more = F.coalesce(F.col("fits"), F.lit(False)) | F.coalesce(F.struct("at", "_id", "_rest") <= F.col("cut"), F.lit(False))
    copies = F.when((F.col("_tokens") > 0) & F.col("epochs").isNotNull(), F.col("epochs") + more.cast("long")).otherwise(1)
    return placed.join(last, here, "left").withColumn("copies", copies).drop("_s", "_b", "fits", "cut")


def mix_tables(rows: DataFrame, max_repetition: float | None, min_entropy: float | None, budget_tokens: int | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sources, last_epochs) of a written table of rows."""
    shares = source_shares(rows.select(F.col("_source").alias("source"), F.col("_tokens").alias("tokens")))
    power = bisected_power(shares, max_repetition, min_entropy)
    sources = stable(with_budgets(shares, power, budget_tokens).withColumn("power", F.lit(power)))
    return sources, last_epochs(with_places(rows, sources, seed), seed)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repetition: float | None = MAX_REPETITION,
          min_entropy: float | None = None, budget_tokens: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(plan, sources): one plan row for each copy of a row, and the table of sources with shares, weights and budgets.

    Plan columns: doc_id, source, tokens, epoch (from 1), block, copy_order
    (rank key of block and row in its epoch). Order by (epoch, copy_order) to
    get the mixed stream. Tokens are words; rows without words (null, empty,
    blank) have none and are in the first epoch only. A null source is a
    source. Rows that are equal in id and text take the same place. An empty
    table gives an empty plan.
    """
    rows = stable(with_rows(docs, id_col, text_col, source_col).select("_id", "_source", "_tokens", "_rest"))
    sources, last = mix_tables(rows, max_repetition, min_entropy, budget_tokens, seed)
    d = with_copies(with_places(rows, sources, seed), last).filter("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    padded = lambda c: F.lpad(c.cast("string"), 19, "0")
    order = F.concat_ws("-", padded(_order(seed, F.col("epoch"))), padded(F.col("at")))
    return d.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_tokens").alias("tokens"), "epoch", "block", order.alias("copy_order")), sources


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repetition: float | None = MAX_REPETITION,
                    min_entropy: float | None = None, budget_tokens: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows themselves, with all their columns, as often as the plan has them. Texts are not shuffled."""
    d = with_rows(docs, id_col, text_col, source_col)
    rows = stable(d.select("_id", "_source", "_tokens", "_rest"))
    sources, last = mix_tables(rows, max_repetition, min_entropy, budget_tokens, seed)
    own = [F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(docs.columns)]
    d = with_copies(with_places(d.select("_id", "_source", "_tokens", "_rest", *own), sources, seed), last)
    d = d.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return d.select(*[F.col(f"_own{i}").alias(c) for i, c in enumerate(docs.columns)])


_MD5 = "('0x' || substr(md5({}), 1, 15))::bigint"
_SQL = f"""
with recursive d as (
  select doc_id, source, md5(coalesce(text, '')) rest, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::bigint tokens from documents),
s as (select source, sum(tokens)::bigint tokens, sum(tokens)::double / (select sum(tokens) from d) share from d group by source having sum(tokens) > 0),
ends as (select max(share) hi, min(share) lo from s),
b(k, lo, width) as (
  select 0, 0::bigint, {1 << HALVINGS}::bigint
  union all
  select k + 1, case when pow(e.lo, (b.lo + b.width // 2) / {float(1 << HALVINGS)} - 1) <= {MAX_REPETITION} * pow(e.hi, (b.lo + b.width // 2) / {float(1 << HALVINGS)} - 1) then b.lo else b.lo + b.width // 2 end, b.width // 2
  from b, ends e where b.width > 1),
a as (select case when 1 / e.lo <= {MAX_REPETITION} * (1 / e.hi) then 0 else (b.lo + 1) / {float(1 << HALVINGS)} end power from b, ends e where b.width = 1),
w as (select s.*, pow(share, power) w from s, a),
g as (select source, tokens, floor(w * (select max(tokens / w) from w) + 1e-6)::bigint budget from w),
h as (select source, tokens, budget // tokens epochs, budget % tokens extra, least({MAX_BLOCKS}, ceil(tokens / {float(BLOCK_TOKENS)}))::bigint blocks from g),
p as (select d.*, coalesce(h.epochs, 1) epochs, coalesce(h.extra, 0) extra, {_MD5.format(f"concat_ws(':', '{SEED}', coalesce(doc_id::varchar, ''), rest)")} pl, coalesce(h.blocks, 1) blocks
  from d left join h on d.source is not distinct from h.source),
q as (select *, pl % blocks block from p),
whole as (select doc_id, source, tokens, unnest(range(1, case when tokens = 0 then 2 else epochs + 1 end)) epoch, block from q),
t as (select source, block, epochs + 1 epoch, extra, sum(tokens) n from q where extra > 0 and tokens > 0 group by all),
u as (select *, sum(n) over (partition by source order by {_MD5.format(f"concat_ws(':', '{SEED}', epoch::varchar, block::varchar)")}, block rows unbounded preceding) upto from t),
v as (select source, block, epoch, upto <= extra fits, extra - upto + n room from u where extra - upto + n > 0),
x as (select q.doc_id, q.source, q.tokens, v.epoch, q.block, fits, room, sum(tokens) over (partition by q.source, q.block order by pl, doc_id, rest rows unbounded preceding) upto
  from q join v on q.source is not distinct from v.source and q.block = v.block where q.tokens > 0)
select doc_id, source, tokens, epoch, block from whole union all select doc_id, source, tokens, epoch, block from x where fits or upto <= room
"""


@query(_SQL)
def op2_temperature_mixing(spark, sf_dir):
    """The mixing plan of all documents: one row for each copy, sources repeated at most 1.5 times the least repeated one."""
    plan, _ = mixed(documents(spark, sf_dir))
    return plan.select("doc_id", "source", "tokens", "epoch", "block")
