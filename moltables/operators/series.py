"""Ordered series: thinning, window statistics, integrals, smoothing, plateaus."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moltables.operators.ordered import ordered


def every_nth(df: DataFrame, keys: Sequence[str], order: Sequence[str], stride: int, hot: bool = False) -> DataFrame:
    d = ordered(df, keys, order, hot).row_number("_rn").result()
    return d.filter((F.col("_rn") - 1) % stride == 0).drop("_rn")


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def window_statistics(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, discard: float = 0.20,
                      hot: bool = False) -> DataFrame:
    """Mean, standard error and n per window after dropping the first int(discard * n) samples."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = ordered(df, keys, order, hot).row_number("_rn").result()
    d = d.join(sizes, list(keys)).filter(F.col("_rn") > F.floor(F.col("_n") * F.lit(discard)))
    n = F.count(value)
    return d.groupBy(*keys).agg(
        n.alias("n_values"), F.avg(value).alias("mean"),
        F.when(n > 1, F.stddev_samp(value) / F.sqrt(n)).alias("sem"))


def integrate(df: DataFrame, keys: Sequence[str], x: str, y: str, sem: str | None = None,
              hot: bool = False) -> DataFrame:
    """Trapezoid integral per series, and its propagated uncertainty when ``sem`` is given."""
    lags = {"_x": F.col(x), "_y": F.col(y)}
    if sem:
        lags["_s"] = F.col(sem)
    d = ordered(df, keys, [x], hot).scan(lags=lags).result()
    dx = F.col(x) - F.col("_x")
    aggs = [F.coalesce(F.sum(dx * (F.col(y) + F.col("_y")) / 2.0), F.lit(0.0)).alias("integral"),
            F.count(F.lit(1)).alias("n_points")]
    if sem:
        half = 0.5 * dx
        var = F.pow(half * F.col(sem), F.lit(2.0)) + F.pow(half * F.col("_s"), F.lit(2.0))
        aggs.append(F.sqrt(F.coalesce(F.sum(var), F.lit(0.0))).alias("uncertainty"))
    return d.groupBy(*keys).agg(*aggs)


def total_free_energy(legs: DataFrame, integral: str = "integral", uncertainty: str = "uncertainty", correction: float = 0.0) -> DataFrame:
    """Sum over legs, reversed sign, plus a correction; uncertainties add in squares."""
    return legs.agg(
        F.sum(integral).alias("decoupling"), (-F.sum(integral)).alias("free_energy_raw"),
        (-F.sum(integral) + F.lit(correction)).alias("free_energy"),
        F.sqrt(F.sum(F.pow(uncertainty, F.lit(2.0)))).alias("uncertainty"))


def smoothing_width(n: int, window: int = 51) -> int:
    """Odd window not longer than the series."""
    if window >= n:
        window = n - 1 if n % 2 == 0 else n
    return window - 1 if window % 2 == 0 else window


def _fit_weights(window: int, degree: int, at: int) -> list[float]:
    """Weights of the window's values in its least-squares polynomial evaluated at position ``at``."""
    half = window // 2
    a = np.vander(np.arange(window) - half, degree + 1, increasing=True).astype(float)
    p = np.power(float(at - half), np.arange(degree + 1))
    return (p @ np.linalg.pinv(a)).tolist()


def _weights(spark: SparkSession, window: int, degree: int) -> DataFrame:
    """(_w, _m): for each odd window up to ``window`` the weights _m[at][j] of its j-th value at its place ``at``.

    A window of at most ``degree`` values is met exactly by its polynomial, so there
    the weights leave values as they are. The table has ``window`` / 2 rows.
    """
    rows = []
    for w in range(1, window + 1, 2):
        fit = [_fit_weights(w, degree, at) for at in range(w)] if w > degree else np.eye(w).tolist()
        rows.append((w, fit))
    return spark.createDataFrame(rows, "_w int, _m array<array<double>>")


def smooth(df: DataFrame, keys: Sequence[str], order: str, value: str, window: int = 51, degree: int = 2, out: str = "smooth",
           clip_at: float | None = 0.0, hot: bool = False) -> DataFrame:
    """Savitzky-Golay smoothing; ends use the end polynomials.

    A series shorter than ``window`` takes the longest odd window it has. Inner
    rows take the weights of the window's middle, the first and last
    ``window // 2`` rows the polynomial of the first or last window. Rows see
    their neighbours through a window frame; a series cut into blocks is never
    gathered, there each row adds its weighted value to the rows it influences.
    """
    window = window - 1 if window % 2 == 0 else window
    d = df.select(*keys, order, value)
    sizes = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_w", F.least(F.lit(window), F.col("_n") - F.when(F.col("_n") % 2 == 0, 1).otherwise(0)).cast("int"))
    sizes = sizes.join(F.broadcast(_weights(df.sparkSession, window, degree)), "_w")
    run = ordered(d, keys, [order], hot)
    smoothed = _smooth_in_frames if run.block is None else _smooth_in_blocks
    return smoothed(run, sizes, keys, order, value, window, out, clip_at)


def _with_sizes(d: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not keys:
        return d.join(F.broadcast(sizes))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    sizes = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n", "_w", "_m")
    return d.join(sizes, on).drop(*[f"_k{i}" for i in range(len(keys))])


def _smooth_in_blocks(run, sizes, keys, order, value, window, out, clip_at) -> DataFrame:
    o = run.row_number("_rn").result()
    i, n, w = F.col("_rn") - 1, F.col("_n"), F.col("_w")
    half = F.floor(w / 2)
    # Rows this value contributes to, as (target, place of the target in its window, place of the value in it).
    start = lambda t: F.greatest(F.lit(0), F.least(t - half, n - w))
    near = F.sequence(F.greatest(F.lit(0), i - w + 1), F.least(n - 1, i + w - 1))
    targets = F.filter(near, lambda t: (start(t) <= i) & (i < start(t) + w))
    d = _with_sizes(o, sizes, keys).select(*keys, F.col(value).alias("_v"), "_m", F.explode(F.transform(
        targets, lambda t: F.struct(t.alias("t"), (t - start(t)).cast("int").alias("at"), (i - start(t)).cast("int").alias("j")))).alias("_c"))
    part = F.col("_v") * F.get(F.get("_m", F.col("_c.at")), F.col("_c.j"))
    sums = d.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_c.t").alias("_t")).agg(F.sum(part).alias(out))
    if clip_at is not None:
        sums = sums.withColumn(out, F.greatest(F.col(out), F.lit(clip_at)))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_rn") == F.col("_t") + 1]
    return o.join(sums, on).drop("_rn", "_t", *[f"_k{i}" for i in range(len(keys))])


def _smooth_in_frames(run, sizes, keys, order, value, window, out, clip_at) -> DataFrame:
    along = Window.partitionBy(*keys).orderBy(order)
    d = run.df.withColumns({
        "_i": F.row_number().over(along) - 1,
        "_near": F.collect_list(F.struct(F.col(value).alias("v"))).over(along.rowsBetween(-(window - 1), window - 1))})
    # First row of the fitted window, and its place in the neighbour list.
    d = _with_sizes(d, sizes, keys).withColumn("_s", F.greatest(F.lit(0), F.least(F.col("_i") - F.floor(F.col("_w") / 2), F.col("_n") - F.col("_w"))).cast("int"))
    used = F.slice("_near", F.col("_s") - F.greatest(F.lit(0), F.col("_i") - (window - 1)) + 1, F.col("_w"))
    total = F.aggregate(F.zip_with(used, F.get("_m", F.col("_i") - F.col("_s")), lambda a, b: F.coalesce(a["v"] * b, F.lit(0.0))),
                        F.lit(0.0), lambda a, b: a + b)
    result = total if clip_at is None else F.greatest(total, F.lit(clip_at))
    return d.select(*keys, order, value, result.alias(out))


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, p: float, out: str,
                     hot: bool = False) -> DataFrame:
    """Linear-interpolated percentile from running counts of distinct values, so no task holds a group."""
    pts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    sizes = pts.groupBy(*keys).agg(F.sum("_w").alias("_n"))
    run = ordered(pts, keys, [value], hot).scan(sums={"_c": F.col("_w")}).result()
    run = run.join(sizes, list(keys)) if keys else run.join(F.broadcast(sizes))
    at = F.lit(p) * (F.col("_n") - 1)
    both = run.groupBy(*keys).agg(
        F.min(F.when(F.col("_c") >= F.floor(at) + 1, F.col(value))).alias("_lo"),
        F.min(F.when(F.col("_c") >= F.ceil(at) + 1, F.col(value))).alias("_hi"),
        F.first(at - F.floor(at)).alias("_part"))
    return both.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias(out))


def plateau(df: DataFrame, keys: Sequence[str], order: str, value: str, bulk_share: float = 0.90, edge_share: float = 0.05,
            hot: bool = False) -> DataFrame:
    """Longest run at or above bulk_share * p95, and the extent at or above edge_share * p95.

    (keys, bulk, bulk_low, bulk_high, bulk_rows, extent_low, extent_high); the
    first of equally long runs wins.
    """
    p95 = exact_percentile(df, keys, value, 0.95, "bulk", hot)
    d = df.select(*keys, order, value)
    d = d.join(p95, list(keys)) if keys else d.join(F.broadcast(p95))
    d = d.withColumn("_in", F.col(value) >= F.col("bulk") * bulk_share)
    o = ordered(d, keys, [order], hot).scan(lags={"_prev": F.col("_in")})
    o = o.with_columns({"_start": (F.col("_in") & ~F.coalesce(F.col("_prev"), F.lit(False))).cast("int")})
    d = o.scan(sums={"_run": F.col("_start")}).result()
    runs = d.filter("_in").groupBy(*keys, "_run").agg(
        F.count(F.lit(1)).alias("_len"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    best = runs.groupBy(*keys).agg(F.max_by(F.struct("_lo", "_hi", "_len"), F.struct(F.col("_len"), -F.col("_run"))).alias("_b"))
    extent = d.filter(F.col(value) >= F.col("bulk") * edge_share).groupBy(*keys).agg(
        F.first("bulk").alias("bulk"), F.min(order).alias("extent_low"), F.max(order).alias("extent_high"))
    out = extent.join(best, list(keys), "left") if keys else extent.join(F.broadcast(best))
    return out.select(*keys, "bulk", F.col("_b._lo").alias("bulk_low"), F.col("_b._hi").alias("bulk_high"),
                      F.col("_b._len").alias("bulk_rows"), "extent_low", "extent_high")


def interfaces(plateaus: DataFrame) -> DataFrame:
    return plateaus.withColumns({
        "lower_interface": F.struct(F.col("extent_low").alias("from"), F.col("bulk_low").alias("to")),
        "upper_interface": F.struct(F.col("bulk_high").alias("from"), F.col("extent_high").alias("to"))})


def last_value_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Later rows overwrite earlier ones with the same key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def lowest_energy_frame(df: DataFrame, energy: str, step: str, time: str, stride: int, keys: Sequence[str] = ()) -> DataFrame:
    """Row of the lowest energy (earliest on ties) and its frame number step / stride."""
    best = df.filter(F.col(energy).isNotNull()).groupBy(*keys).agg(
        F.min_by(F.struct(energy, step, time), F.struct(energy, time, step)).alias("_r")).select(*keys, "_r.*")
    return best.withColumn("frame", F.floor(F.col(step) / stride))


def plateau_verdict(df: DataFrame, keys: Sequence[str], time: str, value: str, slope_tolerance: float, shift_tolerance: float) -> DataFrame:
    """Converged when, over the second half of the time span, slope and mean shift stay inside tolerances.

    The shift compares the means of the third and the last quarter.
    """
    span = df.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    d = df.join(span, list(keys)) if keys else df.join(F.broadcast(span))
    at = (F.col(time) - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0))
    d = d.withColumn("_at", at).filter(F.col("_at") >= 0.5)
    third, last = F.col("_at") < 0.75, F.col("_at") >= 0.75
    out = d.groupBy(*keys).agg(
        F.regr_slope(F.col(value), F.col(time).cast("double")).alias("slope"),
        (F.avg(F.when(last, F.col(value))) - F.avg(F.when(third, F.col(value)))).alias("shift"))
    ok = (F.abs("slope") <= slope_tolerance) & (F.abs("shift") <= shift_tolerance)
    return out.withColumn("converged", F.coalesce(ok, F.lit(False)))


def demultiplex(frames: DataFrame, index: DataFrame, slot: str = "slot", time: str = "time") -> DataFrame:
    """Attach the walker that sat in a slot at a time; index: (time, slot, walker).

    Both sides are shuffled: the planner takes an index made by ``explode`` for
    as small as its source and would broadcast it.
    """
    return frames.join(index.hint("merge"), [slot, time])


def cumulative_share(df: DataFrame, order: str, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    return ordered(df, keys, [order]).scan(sums={out: F.col(value)}).result()


def frame_time(frame: Column, timestep: float) -> Column:
    return frame * F.lit(timestep)
