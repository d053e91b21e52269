"""Scaffold groups of an assay table: sizes, success rates, ranks, cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltables.operators.ordered import min_rank, ordered, running_count_at


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def group_size_summary(df: DataFrame, group: str, above: Sequence[int] = (1, 5, 10, 25)) -> DataFrame:
    """One row: number of groups, and of groups with more than k members."""
    sizes = group_sizes(df.filter(F.col(group).isNotNull()), group)
    return sizes.agg(
        F.count(F.lit(1)).alias("groups"),
        *[F.count_if(F.col("n") > k).alias(f"groups_above_{k}") for k in above],
    )


def large_groups(df: DataFrame, group: str, above: int = 25) -> DataFrame:
    return group_sizes(df, group).filter(F.col("n") > above)


def number_groups(df: DataFrame, group: str, order: str, out: str = "group_no") -> DataFrame:
    """Number groups 1, 2, … by the first row (smallest ``order``) they appear in."""
    firsts = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min(order).alias("_first"))
    numbers = ordered(firsts, [], ["_first"]).row_number(out).result().drop("_first")
    return df.join(numbers, group, "left")


def success_rates(
    df: DataFrame, group: str, potency: str, out: str = "prop_10x", factor: float = 10.0, min_size: int = 5,
    hot: bool = False,
) -> DataFrame:
    """Share of the group with potency <= own potency / factor, ties exact.

    Groups of ``min_size`` or fewer, and rows without a potency, get 0. Rows
    with a null potency still count in the group size. A sweep over a running
    count of the distinct (group, potency) values replaces the comparison of all
    pairs.
    """
    values = (
        df.filter(F.col(group).isNotNull() & F.col(potency).isNotNull())
        .groupBy(F.col(group).alias("_g"), F.col(potency).alias("_p")).agg(F.count(F.lit(1)).alias("_w"))
    )
    below = F.col("_p") / F.lit(factor)
    sweep = values.select("_g", F.explode(F.array(
        F.struct(F.col("_p").alias("at"), F.col("_w").alias("w"), F.col("_p")),
        F.struct(below.alias("at"), F.lit(0).cast("bigint").alias("w"), F.col("_p")),
    )).alias("e")).select("_g", "e.*")
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > min_size)
    if hot:
        counts = values.withColumn("at", below).join(running_count_at(sweep, ["_g"], "at", F.col("w"), "_c", hot), ["_g", "at"])
    else:  # the asking rows, of weight 0, keep their potency, so neither an aggregate nor a join is needed to come back to it
        upto = Window.partitionBy("_g").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        counts = sweep.withColumn("_c", F.sum("w").over(upto)).filter("w = 0")
    rates = counts.join(sizes, "_g").select("_g", "_p", (F.col("_c") / F.col("_n")).alias("_rate"))
    on = (F.col(group) == F.col("_g")) & (F.col(potency) == F.col("_p"))
    return df.join(rates, on, "left").withColumn(out, F.coalesce("_rate", F.lit(0.0))).drop("_g", "_p", "_rate")


def rank_in_group(
    df: DataFrame, group: str, potency: str, ascending: bool, hot: bool = False,
) -> DataFrame:
    """rank (min method), count and prop_improv = rank / count per row; rows without a group are a group."""
    ranked = min_rank(df, [group], potency, "rank", ascending, hot)
    if hot:
        counted = with_group_count(ranked, [group], "count")
    else:
        counted = ranked.withColumn("count", F.count(F.lit(1)).over(Window.partitionBy(group)))
    return counted.withColumn("prop_improv", F.col("rank") / F.col("count"))


def with_group_count(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """Attach group sizes; aggregated first, so a hot group never sits in one task."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    sizes = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], out)
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(sizes, on).drop(*[f"_k_{k}" for k in keys])


def clean_groups(
    df: DataFrame, target: str, group: str, heavy: Column, scaffold_heavy: Column, min_size: int = 5, max_gap: int = 2,
) -> DataFrame:
    """Drop (target, group) pairs under ``min_size`` and rows whose atom counts differ by more than ``max_gap``."""
    small = df.groupBy(target, group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < min_size)
    kept = df.join(small.drop("_n"), [target, group], "left_anti")
    return kept.filter(F.abs(heavy - scaffold_heavy) <= max_gap)


def potency_extremes(df: DataFrame, group: str, potency: str, label: str, order: str, scaffold: str | None = None) -> DataFrame:
    """Most and least potent member per group; ties go to the first row in ``order``."""
    has = F.col(potency).isNotNull()
    lowest = F.when(has, F.struct(potency, order))
    highest = F.when(has, F.struct(F.col(potency), -F.col(order)))
    aggs = [
        F.count(F.lit(1)).alias("n"), F.min(potency).alias("min_potency"), F.min_by(label, lowest).alias("min_label"),
        F.max(potency).alias("max_potency"), F.max_by(label, highest).alias("max_label"),
    ]
    if scaffold:
        aggs.append(F.min_by(scaffold, order).alias("scaffold"))
    return df.groupBy(group).agg(*aggs)


def top_groups(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    return group_sizes(df, group).orderBy(F.col("n").desc(), F.col(group)).limit(k)


def only_new(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the existing table."""
    return df.join(existing.select(key).distinct(), key, "left_anti")


def rate_summary(df: DataFrame, rate: str) -> DataFrame:
    return df.agg(F.count(rate).alias("n"), F.avg(rate).alias("p"))


def finite_between(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    c = F.col(col)
    return df.filter((c > low) & (c < high) & ~F.isnan(c))


def activity_join(
    activities: DataFrame, assays: DataFrame, structures: DataFrame, targets: DataFrame,
    min_pchembl: float = 5.0, min_confidence: int = 8,
) -> DataFrame:
    """Curated single-protein activities with structure and target names."""
    a, s = activities, assays
    a = a.filter(
        a.standard_type.isNotNull() & a.standard_relation.isin("=", "<") & a.standard_value.isNotNull()
        & a.standard_units.isNotNull() & (a.potential_duplicate == 0) & (a.pchembl_value >= min_pchembl)
        & a.data_validity_comment.isNull() & (a.standard_flag == 1)
    )
    s = s.filter((s.confidence_score >= min_confidence) & (s.relationship_type == "D"))
    t = targets.filter(targets.target_type == "SINGLE PROTEIN")
    return (
        a.join(s, a.assay_id == s.assay_id).join(structures, a.molregno == structures.molregno).join(t, s.tid == t.tid)
        .select(a.standard_type, a.standard_relation, a.standard_value, a.standard_units, a.activity_comment,
                structures.canonical_smiles, structures.chembl_id, t.pref_name.alias("target_name"),
                t.chembl_id.alias("target_chembl_id"))
    )
