"""Simulation output: energy logs, dV/dlambda files, umbrella samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltables.functions.units import degree_force_constant, wrap360
from moltables.sources.lines import in_order, number, word, words


def energy_log(lines: DataFrame) -> DataFrame:
    """Long table (file, record, block, time, metric, value) of an MD energy log.

    A record starts at an NSTEP line. The block is ``average`` or ``rms`` when
    such a heading stands between the record and the one before it.
    """
    v = F.col("value")
    step = v.contains("NSTEP")
    heading = F.when(v.contains("A V E R A G E S"), "average").when(v.contains("R M S"), "rms")
    d = in_order(lines.filter(step | heading.isNotNull() | v.contains("="))).scan(sums={"record": step.cast("int")}).df
    d = d.withColumn("_heading", heading).withColumn(
        "record", F.col("record") + F.when(F.col("_heading").isNotNull(), 1).otherwise(0))
    pair = r"([A-Za-z0-9][A-Za-z0-9_\-()/. ]*?)\s*=\s*(-?\d+\.?\d*(?:[eE][+-]?\d+)?)"
    names = F.regexp_extract_all(v, F.lit(pair), F.lit(1))
    values = F.regexp_extract_all(v, F.lit(pair), F.lit(2))
    pairs = d.filter(F.col("_heading").isNull()).select(
        "file", "record", F.explode(F.arrays_zip(names.alias("m"), values.alias("x"))).alias("p"))
    pairs = pairs.select("file", "record", F.trim("p.m").alias("metric"), number(F.col("p.x")).alias("value"))
    heads = d.filter(F.col("_heading").isNotNull() | step).groupBy("file", "record").agg(
        F.coalesce(F.min("_heading"), F.lit("instant")).alias("block"),
        F.max(F.when(step, number(F.regexp_extract(v, r"TIME\(PS\)\s*=\s*(-?\d+\.?\d*)", 1)))).alias("time"),
    ).filter(F.col("time").isNotNull())
    return pairs.join(heads, ["file", "record"]).filter(~F.col("metric").isin("NSTEP", "TIME(PS)")).select(
        "file", "record", "block", "time", "metric", "value")


def dvdl_samples(lines: DataFrame, lambda_pattern: str = r"lambda_([0-9.]+)") -> DataFrame:
    """(leg, lambda, file, block, seq, value) of ``DV/DL = x`` lines."""
    raw = F.regexp_extract("value", r"DV/DL\s*=\s*(-?\d+\.?\d*(?:[eE][+-]?\d+)?)", 1)
    return lines.filter(F.col("value").contains("DV/DL")).select(
        F.regexp_extract("file", r"([^/]+)/lambda_", 1).alias("leg"),
        number(F.regexp_extract("file", lambda_pattern, 1)).alias("lambda"), "file", "block", "seq",
        number(raw).alias("value"),
    ).filter(F.col("value").isNotNull())


def dvdl_skips(expected: DataFrame, files: DataFrame, samples: DataFrame) -> DataFrame:
    """Windows without data and why: ``missing``, ``empty`` or ``no values``.

    expected: (leg, lambda); files: (leg, lambda, length); samples: dvdl_samples.
    """
    have = samples.groupBy("leg", "lambda").agg(F.count("*").alias("_n"))
    d = expected.join(files, ["leg", "lambda"], "left").join(have, ["leg", "lambda"], "left")
    why = F.when(F.col("length").isNull(), "missing").when(F.col("length") == 0, "empty").when(
        F.col("_n").isNull(), "no values")
    return d.withColumn("reason", why).filter(F.col("reason").isNotNull()).select("leg", "lambda", "reason")


def umbrella_samples(data: DataFrame, restraints: DataFrame, tag_pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """(window, center, k, value): last word of every data line, wrapped to [0, 360)."""
    v = F.col("value")
    tag = lambda d: d.withColumn("window", F.regexp_extract("file", tag_pattern, 1))
    keep = (F.trim(v) != "") & ~v.startswith("#") & ~v.startswith("@")
    rows = tag(data.filter(keep)).select(
        "window", "block", "seq", wrap360(number(F.element_at(words(v), -1))).alias("angle"))
    found = lambda key: F.nullif(F.regexp_extract(v, rf"{key}\s*=\s*(-?\d+\.?\d*)", 1), F.lit(""))
    centers = tag(restraints).groupBy("window").agg(
        F.max(number(found(r"\br2"))).alias("center"),
        F.max(degree_force_constant(number(found(r"\brk2")))).alias("k"),
    )
    return rows.join(centers, "window", "left").select("window", "block", "seq", "center", "k", "angle")


def umbrella_metadata(samples: DataFrame) -> DataFrame:
    return samples.groupBy("window").agg(
        F.first("center").alias("center"), F.first("k").alias("k"), F.count("*").alias("n"))


def second_word_values(lines: DataFrame) -> DataFrame:
    """Two-column series (x, y) of a plain output file."""
    return lines.select("file", "block", "seq", number(word(F.col("value"), 0)).alias("x"),
                        number(word(F.col("value"), 1)).alias("y")).dropna(subset=["x", "y"])
