"""Ordered (prefix) computations that survive hot groups.

A SQL window puts a whole group into one task. Without keys, and where the
caller says that a group may be hot, the rows are range partitioned on (keys,
order) instead, every range becomes a block, each block is scanned on its own
and small per-block summaries carry sums, last values and neighbours over
block borders. All other scans are ordinary windows, and nothing is counted
while a query is built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltables.session import shuffle_width, stable

_BLOCK = "_block"


@dataclass(frozen=True)
class Ordered:
    """Rows with a total order inside each group; ``block`` is None for plain windows."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    block: str | None = None

    def scan(
        self,
        sums: Mapping[str, Column] | None = None,
        lasts: Mapping[str, Column] | None = None,
        nexts: Mapping[str, Column] | None = None,
        lags: Mapping[str, Column] | None = None,
        leads: Mapping[str, Column] | None = None,
        maxes: Mapping[str, Column] | None = None,
    ) -> "Ordered":
        """Add running columns in one pass.

        sums / maxes: running up to and including the row. lasts: last non-null
        so far (row included). nexts: first non-null from the row on. lags /
        leads: value of the previous / next row.
        """
        parts = {
            "sum": dict(sums or {}), "last": dict(lasts or {}), "next": dict(nexts or {}),
            "lag": dict(lags or {}), "lead": dict(leads or {}), "max": dict(maxes or {}),
        }
        w = Window.partitionBy(*self.keys, *([self.block] if self.block else [])).orderBy(*self.order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        onward = w.rowsBetween(0, Window.unboundedFollowing)
        local = {}
        for n, e in parts["sum"].items():
            local[n] = F.sum(e).over(upto)
        for n, e in parts["max"].items():
            local[n] = F.max(e).over(upto)
        for n, e in parts["last"].items():
            local[n] = F.last(e, ignorenulls=True).over(upto)
        for n, e in parts["next"].items():
            local[n] = F.first(e, ignorenulls=True).over(onward)
        for n, e in parts["lag"].items():
            local[n] = F.lag(e).over(w)
        for n, e in parts["lead"].items():
            local[n] = F.lead(e).over(w)
        if self.block is None:
            return Ordered(self.df.withColumns(local), self.keys, self.order)
        return self._scan_blocks(parts, local, w)

    def _scan_blocks(self, parts, local, w) -> "Ordered":
        keys, block = self.keys, self.block
        at = F.struct(*[F.col(c) for c in self.order])
        seen = lambda e: F.when(e.isNotNull(), at)
        summarise = {
            "sum": F.sum,
            "max": F.max,
            "last": lambda e: F.max_by(e, seen(e)),
            "next": lambda e: F.min_by(e, seen(e)),
            "lag": lambda e: F.max_by(F.struct(e.alias("v")), at),
            "lead": lambda e: F.min_by(F.struct(e.alias("v")), at),
        }
        aggs = [summarise[kind](e).alias(f"_s_{n}") for kind, cols in parts.items() for n, e in cols.items()]
        per_block = self.df.groupBy(*keys, block).agg(*aggs)
        wk = Window.partitionBy(*keys).orderBy(block)
        before = wk.rowsBetween(Window.unboundedPreceding, -1)
        after = wk.rowsBetween(1, Window.unboundedFollowing)
        carry = {"_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))}
        for kind, cols in parts.items():
            for n in cols:
                s = F.col(f"_s_{n}")
                carry[f"_c_{n}"] = {
                    "sum": F.sum(s).over(before), "max": F.max(s).over(before),
                    "last": F.last(s, ignorenulls=True).over(before),
                    "next": F.first(s, ignorenulls=True).over(after),
                    "lag": F.lag(s).over(wk), "lead": F.lead(s).over(wk),
                }[kind]
        # A block border cuts at most one group, so the carry table has at most
        # two rows per block however many groups there are.
        names = [*keys, block]
        carried = (
            per_block.withColumns(carry).filter("_n > 1")
            .select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)],
                    *[F.col(f"_c_{n}") for cols in parts.values() for n in cols])
        )
        edges = {}
        if parts["lag"]:
            edges["_first"] = F.row_number().over(w) == 1
        if parts["lead"]:
            edges["_last"] = F.lead(F.lit(1)).over(w).isNull()
        base_cols = [c for c in self.df.columns if c not in local]
        d = self.df.withColumns({**local, **edges})
        d = d.join(carried, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(names)], "left")
        out = []
        for kind, cols in parts.items():
            for n in cols:
                here, c = F.col(n), F.col(f"_c_{n}")
                if kind == "sum":
                    v = F.coalesce(here + c, here, c)
                elif kind == "max":
                    v = F.greatest(here, c)
                elif kind == "lag":
                    v = F.when(F.col("_first"), c["v"]).otherwise(here)
                elif kind == "lead":
                    v = F.when(F.col("_last"), c["v"]).otherwise(here)
                else:
                    v = F.coalesce(here, c)
                out.append(v.alias(n))
        return Ordered(d.select(*base_cols, *out), keys, self.order, block)

    def row_number(self, name: str) -> "Ordered":
        return self.scan(sums={name: F.lit(1).cast("bigint")})

    def with_columns(self, cols: Mapping[str, Column]) -> "Ordered":
        return Ordered(self.df.withColumns(dict(cols)), self.keys, self.order, self.block)

    def result(self) -> DataFrame:
        return self.df.drop(self.block) if self.block == _BLOCK else self.df


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: bool = False) -> Ordered:
    """Prepare ``df`` for scans: plain windows, or range blocks without keys and for ``hot`` groups.

    ``order`` (ascending column names) must be total inside each group.
    """
    keys, order = tuple(keys), tuple(order)
    if keys and not hot:
        return Ordered(df, keys, order)
    ranged = df.repartitionByRange(2 * shuffle_width(df.sparkSession), *keys, *order).withColumn(_BLOCK, F.spark_partition_id())
    return Ordered(stable(ranged), keys, order, _BLOCK)


def ordered_by_block(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str]) -> Ordered:
    """Use blocks the data already has (file splits): ``block`` ascends with the order."""
    return Ordered(df, tuple(keys), tuple(order), block)


def running_count_at(df: DataFrame, keys: Sequence[str], at: str, weight: Column, out: str, hot: bool = False) -> DataFrame:
    """Distinct (keys, at) with the weight summed over all rows whose ``at`` is <= it.

    Equal values are added up before the scan, so ties cannot make a hot spot.
    """
    pts = df.groupBy(*keys, at).agg(F.sum(weight).alias("_wt"))
    return ordered(pts, keys, [at], hot).scan(sums={out: F.col("_wt")}).result().drop("_wt")


def min_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, ascending: bool, hot: bool = False) -> DataFrame:
    """Competition rank (1,1,3) of ``value`` inside the group; null values get a null rank."""
    if keys and not hot:
        o = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
        r = F.rank().over(Window.partitionBy(*keys).orderBy(o)).cast("bigint")
        return df.withColumn(out, F.when(F.col(value).isNotNull(), r))
    pts = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_o", F.col(value) if ascending else -F.col(value))
    )
    ranks = ordered(pts, keys, ["_o"], hot).scan(sums={"_upto": F.col("_n")}).result()
    ranks = ranks.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(value).alias("_v"),
                         (F.col("_upto") - F.col("_n") + 1).alias(out))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col(value) == F.col("_v")]
    return df.join(ranks, on, "left").drop(*[f"_k_{k}" for k in keys], "_v")
