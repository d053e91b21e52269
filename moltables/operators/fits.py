"""Curve fits from one aggregate row, and the small distributions they need."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """y = a ln x + b by least squares: (a, b, r2, n)."""
    lx, yy = F.log(F.col(x)), F.col(y)
    return df.filter((F.col(x) > 0) & yy.isNotNull()).agg(
        F.regr_slope(yy, lx).alias("a"), F.regr_intercept(yy, lx).alias("b"), F.regr_r2(yy, lx).alias("r2"),
        F.count(F.lit(1)).alias("n"))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """y = slope x + intercept: (slope, intercept, r2, n, x_mean, sxx, x_min, x_max, s_residual)."""
    xx, yy = F.col(x).cast("double"), F.col(y).cast("double")
    d = df.filter(xx.isNotNull() & yy.isNotNull()).agg(
        F.regr_slope(yy, xx).alias("slope"), F.regr_intercept(yy, xx).alias("intercept"), F.regr_r2(yy, xx).alias("r2"),
        F.count(F.lit(1)).alias("n"), F.avg(xx).alias("x_mean"), F.regr_sxx(yy, xx).alias("sxx"),
        F.min(xx).alias("x_min"), F.max(xx).alias("x_max"), F.regr_syy(yy, xx).alias("_syy"), F.regr_sxy(yy, xx).alias("_sxy"))
    rest = F.greatest(F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("sxx"), F.lit(0.0))
    return d.withColumn("s_residual", F.sqrt(rest / (F.col("n") - 2))).drop("_syy", "_sxy")


def fit_bands(df: DataFrame, x: str, y: str, points: int = 100, level: float = 0.95) -> DataFrame:
    """The linear fit with confidence and prediction half-widths on an even grid of x."""
    fit = linear_fit(df, x, y)
    n = fit.select("n").first()[0]
    t = t_quantile(0.5 + level / 2.0, n - 2)
    i = F.col("i")
    gx = F.col("x_min") + (F.col("x_max") - F.col("x_min")) * i / (points - 1)
    spread = F.lit(1.0) / F.col("n") + F.pow(gx - F.col("x_mean"), F.lit(2.0)) / F.col("sxx")
    return fit.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(
        "i", gx.alias("x"), (F.col("slope") * gx + F.col("intercept")).alias("y"),
        (F.lit(t) * F.col("s_residual") * F.sqrt(spread)).alias("confidence"),
        (F.lit(t) * F.col("s_residual") * F.sqrt(F.lit(1.0) + spread)).alias("prediction"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + num * d or tiny)
        c = (1.0 + num / c) or tiny
        f *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * (f - 1.0)


def t_cdf(t: float, dof: float) -> float:
    tail = 0.5 * incomplete_beta(dof / 2.0, 0.5, dof / (dof + t * t))
    return 1.0 - tail if t > 0 else tail


def t_quantile(p: float, dof: float) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if t_cdf(mid, dof) < p else (lo, mid)
    return (lo + hi) / 2.0


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p of a Pearson correlation."""
    if n < 3 or abs(r) >= 1.0:
        return 0.0 if n >= 3 else 1.0
    t2 = r * r * (n - 2) / (1.0 - r * r)
    return incomplete_beta((n - 2) / 2.0, 0.5, (n - 2) / (n - 2 + t2))


def f_p_value(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))
