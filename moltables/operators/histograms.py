"""Histograms, binned means, densities, empirical distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from moltables.operators.ordered import ordered, running_count_at


def bin_index(x: Column, low: float | Column, width: float | Column, bins: int, closed_last: bool = True) -> Column:
    """0-based bin, null outside the range; the last bin includes its upper edge."""
    lo = F.lit(low) if isinstance(low, (int, float)) else low
    wd = F.lit(width) if isinstance(width, (int, float)) else width
    high = lo + wd * bins
    i = F.floor((x - lo) / wd)
    out = F.when((x >= lo) & (i < bins), i)
    if closed_last:
        out = F.when((x <= high) & (i >= bins) & (x >= lo), F.lit(bins - 1)).otherwise(out)
    return out.cast("int")


def bin_index_by_edges(x: Column, edges: Sequence[float]) -> Column:
    """Bins given by explicit edges: closed left, the last one closed on both sides."""
    n = len(edges) - 1
    out = F.when((x >= edges[n - 1]) & (x <= edges[n]), n - 1)
    for i in range(n - 2, -1, -1):
        out = out.when((x >= edges[i]) & (x < edges[i + 1]), i)
    return out.cast("int")


def even_edges(low: float, step: float, count: int) -> list[float]:
    return [low + step * i for i in range(count + 1)]


def _with_empty_bins(counts: DataFrame, keys: Sequence[str], bins: int, values: Sequence[str]) -> DataFrame:
    """Add rows for empty bins: the bins of one key are a generated array, not a cross join."""
    groups = counts.groupBy(*keys).agg(F.lit(1).alias("_one")) if keys else counts.sparkSession.range(1).select(
        F.lit(1).alias("_one"))
    frame = groups.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(counts, [*keys, "bin"], "left").select(*keys, "bin", *values)


def edge_histogram(df: DataFrame, value: str, edges: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, low, count, fraction); fractions sum to 1 over the counted values."""
    counts = df.withColumn("bin", bin_index_by_edges(F.col(value), edges)).filter(F.col("bin").isNotNull()).groupBy(
        *keys, "bin").agg(F.count(F.lit(1)).alias("count"))
    full = _with_empty_bins(counts, keys, len(edges) - 1, ["count"]).withColumn("count", F.coalesce("count", F.lit(0)))
    low = F.get(F.array(*[F.lit(float(e)) for e in edges]), F.col("bin"))
    # One row per bin is left here, so the window is over a handful of rows per key.
    total = F.sum("count").over(Window.partitionBy(*keys))
    return full.select(*keys, "bin", low.alias("low"), "count",
                       F.when(total > 0, F.col("count") / total).alias("fraction"))


def range_histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = (), shared_keys: Sequence[str] | None = None) -> DataFrame:
    """Histogram over the data's own range: (keys, bin, low, high, center, count, fraction).

    The range is that of ``shared_keys`` (default: all keys), so several series
    can share one axis. A range of width zero is widened by 0.5 on both sides.
    """
    over = list(keys if shared_keys is None else shared_keys)
    span = df.filter(F.col(value).isNotNull()).groupBy(*over).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    flat = F.col("_a") == F.col("_b")
    span = span.select(*over, F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_a"),
                       F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_b"))
    d = df.filter(F.col(value).isNotNull())
    d = d.join(span, over) if over else d.join(F.broadcast(span))
    width = (F.col("_b") - F.col("_a")) / bins
    idx = F.least(F.floor((F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1)).cast("int")
    counts = d.groupBy(*keys, idx.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.first("_a").alias("_a"), F.first("_b").alias("_b"))
    full = _with_empty_bins(counts, keys, bins, ["count", "_a", "_b"])
    w = Window.partitionBy(*keys)
    full = full.withColumns({"_a": F.max("_a").over(w), "_b": F.max("_b").over(w),
                             "count": F.coalesce("count", F.lit(0)), "_t": F.sum("count").over(w)})
    low = F.col("_a") + width * F.col("bin")
    return full.select(*keys, "bin", low.alias("low"), (low + width).alias("high"), (low + width / 2).alias("center"),
                       "count", (F.col("count") / F.col("_t")).alias("fraction"))


def property_histograms(rows: DataFrame, sets: str, properties: Sequence[str], bins: int = 10, half_even: bool = True) -> DataFrame:
    """Per (set, property): whole-number values in ``bins`` bins over their own range."""
    rnd = F.bround if half_even else F.round
    long = rows.unpivot([sets], list(properties), "property", "value").withColumn("value", rnd("value", 0))
    return range_histogram(long, "value", bins, [sets, "property"])


def term_histograms(rows: DataFrame, terms: Sequence[str], bins: int = 30) -> DataFrame:
    """Histograms of several columns on one shared range."""
    long = rows.select(*[F.col(t).cast("double") for t in terms]).unpivot([], list(terms), "term", "value")
    return range_histogram(long, "value", bins, ["term"], shared_keys=[])


def density_histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str]) -> DataFrame:
    """Per-class probability density on one shared range."""
    h = range_histogram(df, value, bins, keys, shared_keys=[])
    return h.withColumn("density", F.col("fraction") / (F.col("high") - F.col("low")))


def binned_means(df: DataFrame, x: str, values: Sequence[str], low: float, width: float, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, center, count, mean_<value>…); empty bins have count 0 and null means."""
    i = F.floor((F.col(x) - low) / width)
    d = df.withColumn("bin", F.when((i >= 0) & (i < bins), i).cast("int")).filter(F.col("bin").isNotNull())
    means = [f"mean_{v}" for v in values]
    agg = d.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("count"), *[F.avg(v).alias(m) for v, m in zip(values, means, strict=True)])
    full = _with_empty_bins(agg, keys, bins, ["count", *means])
    return full.select(*keys, "bin", (F.lit(low) + (F.col("bin") + 0.5) * width).alias("center"),
                       F.coalesce("count", F.lit(0)).alias("count"), *means)


def axis_density(df: DataFrame, frame: str, x: str, weight: Column, low: float, width: float, bins: int, area: float, frames: DataFrame) -> DataFrame:
    """Mean and sd over frames of the weight density per bin (number, mass or charge).

    A frame without atoms in a bin counts as zero there, so sums and squares
    are divided by the number of frames.
    """
    i = F.floor((F.col(x) - low) / width)
    per = df.withColumn("bin", F.when((i >= 0) & (i < bins), i).cast("int")).filter(F.col("bin").isNotNull()).groupBy(
        frame, "bin").agg((F.sum(weight) / F.lit(area * width)).alias("d"))
    n = frames.agg(F.count_distinct(frame).alias("_n"))
    sums = per.groupBy("bin").agg(F.sum("d").alias("_s"), F.sum(F.col("d") * F.col("d")).alias("_s2"))
    full = _with_empty_bins(sums, [], bins, ["_s", "_s2"]).na.fill(0.0).join(F.broadcast(n))
    mean = F.col("_s") / F.col("_n")
    var = F.greatest(F.col("_s2") / F.col("_n") - mean * mean, F.lit(0.0))
    return full.select("bin", (F.lit(low) + (F.col("bin") + 0.5) * width).alias("center"), mean.alias("mean"), F.sqrt(var).alias("sd"))


def right_closed_means(df: DataFrame, x: str, value: str, bins: int = 20) -> DataFrame:
    """Mean of ``value`` in (i/bins, (i+1)/bins] bins of x on (0, 1]."""
    i = F.ceil(F.col(x) * bins).cast("int") - 1
    d = df.withColumn("bin", F.when((F.col(x) > 0) & (F.col(x) <= 1), i)).filter(F.col("bin").isNotNull())
    agg = d.groupBy("bin").agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"))
    return _with_empty_bins(agg, [], bins, ["count", "mean"]).withColumn("count", F.coalesce("count", F.lit(0)))


def empirical_cdf(df: DataFrame, value: str, hot: bool = False) -> DataFrame:
    """(value, n, cdf) per distinct value."""
    d = df.filter(F.col(value).isNotNull())
    pts = d.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    run = running_count_at(pts, [], value, F.col("n"), "_c", hot)
    total = pts.agg(F.sum("n").alias("_t"))
    return run.join(pts, value).join(F.broadcast(total)).select(
        value, "n", (F.col("_c") / F.col("_t")).alias("cdf"), ((F.col("_c") - F.col("n")) / F.col("_t")).alias("cdf_before"))


def ks_against(df: DataFrame, value: str, cdf: Column) -> DataFrame:
    """Kolmogorov-Smirnov distance of a sample from a given distribution function."""
    e = empirical_cdf(df, value).withColumn("_f", cdf)
    return e.agg(F.max(F.greatest(F.abs(F.col("_f") - F.col("cdf")), F.abs(F.col("_f") - F.col("cdf_before")))).alias("ks"))


def ks_two_samples(df: DataFrame, value: str, first: Column, hot: bool = False) -> DataFrame:
    """Largest gap between the distribution functions of the rows with and without ``first``."""
    pts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(
        F.count_if(first).alias("_a"), F.count_if(~first).alias("_b"))
    run = ordered(pts, [], [value], hot).scan(sums={"_ca": F.col("_a"), "_cb": F.col("_b")}).result()
    tot = pts.agg(F.sum("_a").alias("_ta"), F.sum("_b").alias("_tb"))
    return run.join(F.broadcast(tot)).agg(
        F.max(F.abs(F.col("_ca") / F.col("_ta") - F.col("_cb") / F.col("_tb"))).alias("ks"))


def kernel_density(df: DataFrame, value: str, low: float, high: float, points: int = 100, cells_per_bandwidth: int = 0) -> DataFrame:
    """Gaussian kernel density on an even grid, normalised to sum 1.

    Every value contributes to every grid point in generated code and is summed
    map-side; ``cells_per_bandwidth`` > 0 first merges values into that many
    cells per bandwidth (an approximation for very large inputs).
    """
    d = df.select(F.col(value).alias("v")).filter(F.col("v").isNotNull())
    stats = d.agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("v").alias("_sd"))
    stats = stats.select((F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).alias("_h"))
    vals = d.groupBy("v").agg(F.count(F.lit(1)).alias("w")).join(F.broadcast(stats))
    if cells_per_bandwidth:
        cell = F.round(F.col("v") / F.col("_h") * cells_per_bandwidth) * F.col("_h") / cells_per_bandwidth
        vals = vals.groupBy(cell.alias("v"), "_h").agg(F.sum("w").alias("w"))
    step = (high - low) / (points - 1)
    sums = [
        F.sum(F.col("w") * F.exp(-0.5 * F.pow((F.lit(low + step * i) - F.col("v")) / F.col("_h"), F.lit(2.0)))).alias(f"g{i}")
        for i in range(points)
    ]
    row = vals.agg(*sums)
    long = row.unpivot([], [f"g{i}" for i in range(points)], "g", "raw")
    i = F.substring("g", 2, 10).cast("int")
    total = F.sum("raw").over(Window.partitionBy())  # over the grid rows only
    return long.select(i.alias("i"), (F.lit(low) + i * step).alias("x"), (F.col("raw") / total).alias("density"))
