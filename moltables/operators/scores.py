"""Docking scores: best per compound, totals, preferences, enrichment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from moltables.functions.units import KT, KT_TO_KCAL
from moltables.operators.ordered import ordered, running_count_at
from moltables.session import forget, stable

RANDOM_LOG_AUC = 0.14462


def sorted_scores(df: DataFrame, score: str, *ties: str) -> DataFrame:
    return df.orderBy(score, *ties)


def best_per_compound(df: DataFrame, compound: Column, score: str, ties: Sequence[str] = (), keep: Sequence[str] | None = None) -> DataFrame:
    """Lowest score row per compound; combined map-side before the shuffle."""
    cols = list(keep or df.columns)
    order = F.struct(score, *ties) if ties else F.struct(score)
    return df.groupBy(compound.alias("_compound")).agg(F.min_by(F.struct(*cols), order).alias("_r")).select("_r.*")


def base_compound(compound: Column) -> Column:
    return F.substring_index(compound, ".", 1)


def collect_scores(scores: DataFrame, finished: DataFrame, directory: str, score: str, compound: Column,
                   ties: Sequence[str], limit: float | None = None) -> DataFrame:
    """Scores of finished directories under the save limit, best per compound."""
    d = scores.join(finished.select(directory).distinct(), directory, "left_semi")
    if limit is not None:
        d = d.filter(F.col(score) <= limit)
    return best_per_compound(d, compound, score, ties)


def top_scores(df: DataFrame, score: str, ties: Sequence[str], n: int = 500) -> DataFrame:
    return df.orderBy(score, *ties).limit(n)


def fetch_list(df: DataFrame, score: str, ties: Sequence[str], n: int, chunk: str, index: str) -> DataFrame:
    """Output files per chunk needed for the top n (n bounds every set)."""
    return top_scores(df, score, ties, n).groupBy(chunk).agg(F.sort_array(F.collect_set(index)).alias("indexes"))


def best_poses(poses: DataFrame, wanted: DataFrame, name: str = "name", energy: str = "energy", ties: Sequence[str] = ("file", "ordinal"),
               max_energy: float = 500.0) -> tuple[DataFrame, DataFrame]:
    """(best pose per wanted name, wanted names without one); only energies under ``max_energy`` count."""
    want = wanted.select(name).distinct()
    usable = poses.filter(F.col(energy) < max_energy).join(want, name, "left_semi")
    best = best_per_compound(usable, F.col(name), energy, ties)
    return best, want.join(best.select(name), name, "left_anti")


def drop_identical(df: DataFrame, same: Sequence[str], order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """First row of every set of rows equal in the ``same`` columns."""
    cols = df.columns
    return df.groupBy(*within, *[F.col(c).alias(f"_same_{c}") for c in same]).agg(
        F.min_by(F.struct(*cols), F.struct(*order)).alias("_r")).select("_r.*")


def rank_against(df: DataFrame, score: str, reference: DataFrame, ref_score: str, out: str = "rank",
                 hot: bool = False) -> DataFrame:
    """max(1, number of reference scores <= score)."""
    pts = df.select(F.col(score).alias("at")).distinct().withColumn("w", F.lit(0).cast("bigint")).unionByName(
        reference.groupBy(F.col(ref_score).alias("at")).agg(F.count(F.lit(1)).alias("w")))
    both = df.select(F.lit(1)).unionAll(reference.select(F.lit(1)))
    counts = running_count_at(pts, [], "at", F.col("w"), "_c", hot)
    return df.join(counts, F.col(score) == F.col("at"), "left").withColumn(
        out, F.greatest(F.lit(1).cast("bigint"), F.coalesce("_c", F.lit(0)))).drop("at", "_c")


def rescore(df: DataFrame, receptor: str, parts: DataFrame, others: Sequence[str], key: Sequence[str], multiplier: float = 1.0) -> DataFrame:
    """New receptor energy = sum of its parts, other terms scaled, total recomputed.

    parts: (part, energy).
    """
    pieces = df.select(*key, F.explode(F.split(receptor, r"\.")).alias("part")).join(parts, "part", "left")
    energy = pieces.groupBy(*key).agg(F.sum("energy").alias("receptor_energy"))
    d = df.join(energy, list(key)).withColumns({c: F.col(c) * multiplier for c in others})
    total = F.col("receptor_energy")
    for c in others:
        total = total + F.col(c)
    return d.withColumn("total", total)


def run_totals(events: DataFrame) -> DataFrame:
    """One row of totals from run-log events: counters summed, compounds distinct per class."""
    counters = ("min_steps", "hierarchies", "orients", "conformations", "nodes", "complexes", "secs", "hours")
    kinds = ("bump", "no_match", "no_viable", "clash", "skip", "misc")
    seen = events.filter(F.col("kind") != "counter").groupBy("compound").agg(
        *[F.max(F.col("kind") == k).alias(k) for k in ("scored", *kinds)])
    distinct = seen.agg(F.count(F.lit(1)).alias("docked"), *[F.count_if(k).alias(k) for k in ("scored", *kinds)])
    sums = events.agg(*[F.sum(F.when(F.col("counter") == c, F.col("value"))).alias(f"total_{c}") for c in counters])
    return sums.join(distinct)


def distinct_by_class(df: DataFrame, kind: str, ident: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count_distinct(ident).alias("n"))


def boltzmann_preference(df: DataFrame, group: Sequence[str], energy: str, inside: Column, kt: float = KT) -> DataFrame:
    """Weight inside / all per group, weights e^(-E/kT) relative to the group's lowest energy.

    The sums are kept per (group, energy floor) first, so one pass with map-side
    combination is enough: e^(-(E - floor)/kT) stays in range and is rescaled by
    the floors afterwards.
    """
    step = 100.0 * kt
    floor = F.floor(F.col(energy) / step) * step
    w = F.exp(-(F.col(energy) - F.col("_f")) / kt)
    part = df.withColumn("_f", floor).withColumn("_in", inside).groupBy(*group, "_f").agg(
        F.sum(F.when(F.col("_in"), w).otherwise(0.0)).alias("_wi"), F.sum(w).alias("_wa"))
    low = part.groupBy(*group).agg(F.min("_f").alias("_low"))
    joined = part.join(low, list(group)) if group else part.join(F.broadcast(low))
    scale = F.exp(-(F.col("_f") - F.col("_low")) / kt)
    return joined.groupBy(*group).agg(
        (F.sum(F.col("_wi") * scale) / F.sum(F.col("_wa") * scale)).alias("preference"))


def part_preferences(df: DataFrame, compound: str, receptor: str, energy: str, same: Sequence[str], kt: float = KT) -> DataFrame:
    """Preference of every receptor part per compound, identical poses counted once.

    A pose is identical when the ``same`` columns agree; duplicates are removed
    inside the set with the part and inside the set without it.
    """
    poses = df.groupBy(compound, *same, F.col(energy).alias("_e")).agg(F.count(F.lit(1)).alias("_n"))
    low = df.groupBy(compound).agg(F.min(energy).alias("_low"))
    w = F.exp(-(F.col("_e") - F.col("_low")) / kt)
    totals = poses.join(low, compound).groupBy(compound).agg(F.sum(w).alias("_all"))
    with_part = (
        df.select(compound, *same, F.col(energy).alias("_e"), F.explode(F.array_distinct(F.split(receptor, r"\."))).alias("part"))
        .groupBy(compound, "part", *same, "_e").agg(F.count(F.lit(1)).alias("_np"))
    )
    joined = with_part.join(poses, [compound, *same, "_e"]).join(low, compound)
    sums = joined.groupBy(compound, "part").agg(
        F.sum(w).alias("_in"), F.sum(F.when(F.col("_np") == F.col("_n"), w).otherwise(0.0)).alias("_only_in"))
    out = sums.join(totals, compound)
    return out.select(compound, "part", (F.col("_in") / (F.col("_in") + F.col("_all") - F.col("_only_in"))).alias("preference"))


def kth_from_list(neighbours: DataFrame, compound: str = "compound", n_dist: int = 10) -> DataFrame:
    """(compound, pose, rmsd, _k): the value at index k of each pose's ascending distances (compound, pose, rmsd) to the other poses.

    k is n_dist, not below the largest number of zero distances of a pose of
    the compound and not above the number of distances every pose has; an index
    past the end means the last value.
    """
    per_pose = neighbours.groupBy(compound, "pose").agg(
        F.count(F.lit(1)).alias("_m"), F.count_if(F.col("rmsd") == 0).alias("_z"))
    clamp = per_pose.groupBy(compound).agg(F.max("_z").alias("_lo"), F.min("_m").alias("_hi")).select(
        compound, "_hi", F.least(F.greatest(F.lit(n_dist), F.col("_lo")), F.col("_hi")).alias("_k"))
    w = Window.partitionBy(compound, "pose").orderBy("rmsd")
    nth = neighbours.withColumn("_i", F.row_number().over(w) - 1).join(clamp, compound)
    return nth.filter(F.col("_i") == F.least(F.col("_k"), F.col("_hi") - 1)).select(compound, "pose", "rmsd", "_k")


def kth_on_line(poses: DataFrame, compound: str, pose: str, value: str, n_dist: int = 10) -> DataFrame:
    """The same from poses that are numbers: the k + 1 nearest are neighbours in sorted order, some on each side.

    How many on the left is searched for by halves: with more on the left, the
    left end is farther and the right one nearer. Compounds whose ``_want`` is at
    most n_dist + 1 look at their neighbours by offsets, in the pass that numbers
    the poses. Compounds with more equal poses look by joins on the place in
    the order, so no list of distances exists, however many are equal.
    """
    rows = poses.select(compound, pose, value)
    equal = rows.groupBy(compound, value).agg(F.count("*").alias("_e"))
    size = equal.groupBy(compound).agg(F.sum("_e").alias("_all"), (F.max("_e") - 1).alias("_z"))
    size = size.filter("_all > 1").withColumn("_k", F.least(F.greatest(F.lit(n_dist), F.col("_z")), F.col("_all") - 1))
    size = stable(size.withColumn("_want", F.least(F.col("_k") + 1, F.col("_all") - 1)))
    numbered = ordered(rows, [compound], [value, pose]).row_number("_at").result()
    reach = n_dist + 1
    w = Window.partitionBy(compound).orderBy(value, pose)
    beside = F.array(*[F.lag(value, i).over(w) for i in range(reach, 0, -1)], F.col(value), *[F.lead(value, i).over(w) for i in range(1, reach + 1)])
    near = numbered.withColumn("_beside", beside).join(size.filter(F.col("_want") <= reach), compound)
    at_offset = lambda d, name, offset: d.withColumn(name, F.get("_beside", (F.lit(reach) + offset).cast("int")))
    out = _kth_by_halves(near, compound, pose, value, at_offset, (reach + 1).bit_length(), lambda d, _: d)
    crowded = size.filter(F.col("_want") > reach)
    if crowded.isEmpty():
        return out
    d = stable(numbered.join(crowded, compound))
    value_at = d.select(F.col(compound).alias("_c2"), F.col("_at").alias("_p2"), F.col(value).alias("_v2"))

    def at_place(d: DataFrame, name: str, offset: Column) -> DataFrame:
        on = (F.col(compound) == F.col("_c2")) & (F.col("_at") + offset == F.col("_p2"))
        return d.join(value_at.withColumnRenamed("_v2", name), on, "left").drop("_c2", "_p2")

    def written(d: DataFrame, last: DataFrame) -> DataFrame:
        d = stable(d)
        forget(last)
        return d
    widest = d.agg(F.max(F.col("_want"))).first()[0] + 1
    return out.unionByName(_kth_by_halves(d, compound, pose, value, at_place, int(widest).bit_length(), written))


def _kth_by_halves(d: DataFrame, compound: str, pose: str, value: str, value_at: Callable[[DataFrame, str, Column], DataFrame],
                   rounds: int, after_round: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The distance that ``kth_on_line`` looks for. ``value_at`` adds the value so many places on, null where there is none."""
    def ends(rows: DataFrame, left: Column) -> DataFrame:
        """Distances to the ends of a neighbourhood with so many on the left: null where it does not fit in."""
        rows = value_at(value_at(rows.withColumn("_a", left), "_l", -F.col("_a")), "_r", F.col("_want") - F.col("_a"))
        return rows.withColumn("_l", F.col(value) - F.col("_l")).withColumn("_r", F.col("_r") - F.col(value))
    least = F.greatest(F.lit(0), F.col("_want") - (F.col("_all") - F.col("_at")))
    most = F.least(F.col("_want"), F.col("_at") - 1)
    d = d.withColumn("_lo", least).withColumn("_hi", most + 1).withColumn("_min", least).withColumn("_max", most)
    for _ in range(rounds):  # least number on the left whose left end is not nearer than the right one
        last, d = d, ends(d, F.floor((F.col("_lo") + F.col("_hi")) / 2).cast("long"))
        open_ = F.col("_lo") < F.col("_hi")
        far = F.col("_l") >= F.col("_r")
        d = d.withColumns({"_lo": F.when(open_ & ~far, F.col("_a") + 1).otherwise(F.col("_lo")), "_hi": F.when(open_ & far, F.col("_a")).otherwise(F.col("_hi"))})
        d = after_round(d.drop("_a", "_l", "_r"), last)
    none = F.lit(float("inf"))
    d = ends(d, F.col("_lo")).withColumn("_one", F.when(F.col("_lo") <= F.col("_max"), F.greatest("_l", "_r")).otherwise(none)).drop("_a", "_l", "_r")
    d = ends(d, F.col("_lo") - 1).withColumn("_two", F.when(F.col("_lo") > F.col("_min"), F.greatest("_l", "_r")).otherwise(none))
    return d.select(compound, F.col(pose).alias("pose"), F.least("_one", "_two").alias("rmsd"), "_k")


def density_corrected_preferences(
    poses: DataFrame, nth: DataFrame, compound: str = "compound", receptor: str = "receptor", energy: str = "energy",
    dof: float = 1.0, kt: float = KT,
) -> DataFrame:
    """Part preferences with weights e^(-E/kT) / (k / r_k^dof).

    nth: (compound, pose, rmsd, _k) of ``kth_from_list`` or ``kth_on_line``.
    """
    low = poses.groupBy(compound).agg(F.min(energy).alias("_low"))
    # Equal poses have an r_k of 0 where all of a compound's other poses are equal too; they have no weight then.
    weighted = poses.join(nth.select(compound, "pose", "rmsd", "_k").join(low, compound), [compound, "pose"]).withColumn(
        "_w", F.exp(-(F.col(energy) - F.col("_low")) / kt) / F.try_divide(F.col("_k").cast("double"), F.pow("rmsd", F.lit(dof))))
    # A pose counts for each of its parts and, as the null part, for the sum over all poses: the weights are made in one pass.
    parts = F.coalesce(F.array_distinct(F.split(receptor, r"\.")), F.array().cast("array<string>"))
    sums = weighted.select(compound, "_w", F.explode(F.concat(F.array(F.lit(None).cast("string")), parts)).alias("part")).groupBy(compound, "part").agg(F.sum("_w").alias("_in"))
    total = F.max(F.when(F.col("part").isNull(), F.col("_in"))).over(Window.partitionBy(compound))
    return sums.withColumn("_all", total).filter(F.col("part").isNotNull()).select(compound, "part", (F.col("_in") / F.col("_all")).alias("preference"))


def information_content(df: DataFrame, x: str, group: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col(x) > 0).groupBy(*group).agg(F.sum(F.col(x) * F.log(x)).alias("information"))


def roc_points(df: DataFrame, score: str, is_ligand: Column, hot: bool = False) -> DataFrame:
    """(x, y, x0, y0) per distinct score: decoy and ligand fractions found so far and before it."""
    pts = df.filter(F.col(score).isNotNull()).groupBy(score).agg(
        F.count_if(is_ligand).alias("_l"), F.count_if(~is_ligand).alias("_d"))
    run = ordered(pts, [], [score], hot).scan(sums={"_cl": F.col("_l"), "_cd": F.col("_d")}).result()
    tot = pts.agg(F.sum("_l").alias("_tl"), F.sum("_d").alias("_td"))
    d = run.join(F.broadcast(tot))  # one row
    return d.select(
        score, F.try_divide("_cd", "_td").alias("x"), F.try_divide("_cl", "_tl").alias("y"),
        F.try_divide(F.col("_cd") - F.col("_d"), F.col("_td")).alias("x0"),
        F.try_divide(F.col("_cl") - F.col("_l"), F.col("_tl")).alias("y0"))


def log_auc(points: DataFrame, floor: float = 0.001, interpolate: bool = True) -> DataFrame:
    """Area under the ROC curve on a log10 x axis from ``floor`` to 1, and minus the random value.

    The step that crosses the floor is cut there (linear in x); without
    ``interpolate`` such a step is left out.
    """
    x0, x, y0, y = F.col("x0"), F.col("x"), F.col("y0"), F.col("y")
    lo = F.greatest(x0, F.lit(floor))
    y_lo = F.when(x0 >= floor, y0).otherwise(y0 + F.try_divide((y - y0) * (F.lit(floor) - x0), x - x0))
    area = (F.log10(x) - F.log10(lo)) * (y + y_lo) / 2.0
    used = (x > floor) & (x > x0) & (F.lit(interpolate) | (x0 >= floor))
    total = F.coalesce(F.sum(F.when(used, area)), F.lit(0.0)) / F.log10(F.lit(1.0 / floor))
    return points.agg(total.alias("log_auc"), (total - RANDOM_LOG_AUC).alias("adjusted_log_auc"))


def ligand_and_decoy_lists(rows: DataFrame, name: str, kind: str, prot_id: str, order: Sequence[str], smiles: str) -> DataFrame:
    """Names once over both sets in read order (ligands count, decoys only without protomer id), cut at ``_``."""
    usable = rows.filter((F.col(kind) == "ligand") | (F.col(prot_id) == "NA"))
    first = usable.groupBy(name).agg(F.min_by(F.struct(kind, smiles), F.struct(*order)).alias("_r"))
    return first.select(F.col(f"_r.{kind}").alias(kind), F.substring_index(name, "_", 1).alias("short_name"),
                        F.col(name), F.col(f"_r.{smiles}").alias(smiles))


def first_states(states: DataFrame, parent: str, canonical: str, order: str, k: int, inputs: DataFrame | None = None) -> DataFrame:
    """Distinct canonical forms per parent, the first k in order; parents without any fall back to the input."""
    distinct = states.filter(F.col(canonical).isNotNull()).groupBy(parent, canonical).agg(F.min(order).alias(order))
    w = Window.partitionBy(parent).orderBy(order, canonical)
    out = distinct.withColumn("state", F.row_number().over(w)).filter(F.col("state") <= k)
    if inputs is None:
        return out
    rest = inputs.join(out.select(parent).distinct(), parent, "left_anti").select(
        parent, F.col(canonical), F.lit(None).cast(dict(states.dtypes)[order]).alias(order), F.lit(1).alias("state"))
    return out.unionByName(rest)


def lowest_k(df: DataFrame, group: Sequence[str], value: str, ties: Sequence[str], k: int, out: str = "rank_in_group") -> DataFrame:
    """k lowest rows per group; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(value, *ties)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def scores_by_compound(scores: DataFrame, wanted: DataFrame, compound: str, fields: Sequence[str], order: Sequence[str],
                       chunk: int = 1000) -> DataFrame:
    """Score rows of wanted compounds as lists of at most ``chunk`` rows (``part`` 0, 1, …)."""
    d = scores.join(wanted.select(compound).distinct(), compound, "left_semi")
    o = ordered(d, [compound], order).row_number("_rn").result()
    return o.groupBy(compound, F.floor((F.col("_rn") - 1) / chunk).cast("int").alias("part")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_rn", F.struct(*fields).alias("s")))), lambda z: z["s"]).alias("scores"))


def scores_with_text(scores: DataFrame, texts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Score rows joined to their pose text; scores without a pose drop out."""
    return scores.join(texts, list(key))


def molecule_contributions(atoms: DataFrame, molecule: str) -> DataFrame:
    """Per-molecule sums of per-atom terms: charge*field in kT, vdW a - b, desolvation, net charge."""
    return atoms.groupBy(molecule).agg(
        (F.sum(F.col("charge") * F.col("field")) * KT_TO_KCAL).alias("electrostatic"),
        F.sum(F.col("a") - F.col("b")).alias("vdw"), F.sum("desolvation").alias("desolvation"),
        F.sum("charge").alias("net_charge"), F.count(F.lit(1)).alias("n_atoms"))
