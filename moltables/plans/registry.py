"""Registry of queries on the star-schema tables, each with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name."""
    def add(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(col: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def rs(expr: str, digits: int = 6) -> str:
    """SQL rounding that never yields a negative zero."""
    return f"(round({expr}, {digits}) + 0e0)"


def big(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")


def fitted_rmsd(points: str, key: str) -> str:
    """SQL tables that give fit(key, rmsd), the best RMSD of points x, y, z on rx, ry, rz of the table ``points`` after rotation.

    The largest singular value of the moments comes from the cosine form of the
    cubic, the sum of the other two, with the sign of the determinant, from the
    minors and the determinant.
    """
    xyz = "xyz"
    moments = ", ".join(f"sum(x{a} * r{b}) s{i}{j}" for i, a in enumerate(xyz) for j, b in enumerate(xyz))
    centred = ", ".join(f"{c} - avg({c}) over (partition by {key}) x{c}, r{c} - avg(r{c}) over (partition by {key}) r{c}" for c in xyz)
    gram = {(i, j): "(" + " + ".join(f"s{k}{i} * s{k}{j}" for k in range(3)) + ")" for i in range(3) for j in range(3)}
    pairs = ((0, 1), (0, 2), (1, 2))
    minors = " + ".join(f"pow(s{a}{c} * s{b}{d} - s{a}{d} * s{b}{c}, 2)" for a, b in pairs for c, d in pairs)
    det = "(s00 * (s11 * s22 - s12 * s21) - s01 * (s10 * s22 - s12 * s20) + s02 * (s10 * s21 - s11 * s20))"
    return f"""fit_c as (select {key}, {centred} from {points}),
fit_s as (select {key}, count(*) n, sum(xx * xx + xy * xy + xz * xz + rx * rx + ry * ry + rz * rz) g, {moments} from fit_c group by {key}),
fit_m as (select *, {gram[0, 0]} m00, {gram[1, 1]} m11, {gram[2, 2]} m22, {gram[0, 1]} m01, {gram[0, 2]} m02, {gram[1, 2]} m12, {minors} mi, {det} de from fit_s),
fit_q as (select *, (m00 + m11 + m22) / 3 q, sqrt((pow(m00 - (m00 + m11 + m22) / 3, 2) + pow(m11 - (m00 + m11 + m22) / 3, 2) + pow(m22 - (m00 + m11 + m22) / 3, 2)
  + 2 * (m01 * m01 + m02 * m02 + m12 * m12)) / 6) p from fit_m),
fit_e as (select *, case when p > 0 then q + 2 * p * cos(acos(greatest(-1, least(1, ((m00 - q) * ((m11 - q) * (m22 - q) - m12 * m12) - m01 * (m01 * (m22 - q) - m12 * m02)
  + m02 * (m01 * m12 - (m11 - q) * m02)) / (2 * p * p * p)))) / 3) else q end e from fit_q),
fit as (select {key}, sqrt(greatest(0, g - 2 * case when e > 0 then sqrt(e) + sqrt(greatest(0, (mi - de * de / e) / e + 2 * de / sqrt(e))) else 0 end) / n) rmsd from fit_e)"""
