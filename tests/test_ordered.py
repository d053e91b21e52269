"""The block path must give what the plain window gives, whatever the group sizes."""

import random

from pyspark.sql import functions as F

from moltables.operators.assays import rank_in_group, success_rates
from moltables.operators.histograms import empirical_cdf
from moltables.operators.ordered import min_rank, ordered, running_count_at
from moltables.operators.series import exact_percentile, integrate, plateau, smooth
from moltables.operators.structure import chain_numbers, renumber_residues


def rows(n=300, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = r.choice(["hot", "hot", "hot", "b", "c", None])
        v = r.choice([None, 1.0, 1.0, 2.5, 10.0, 25.0, 100.0, r.uniform(1, 200)])
        out.append((k, i, v, r.choice("xyz")))
    return out


def frame(spark):
    return spark.createDataFrame(rows(), "k string, i int, v double, s string")


def as_set(df, *cols):
    return sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))


def test_scan_blocks_equal_plain(spark):
    d = frame(spark)

    def run(limit):
        o = ordered(d, ["k"], ["i"], limit)
        assert (o.block is None) == (not limit)
        o = o.scan(sums={"sum": F.col("v"), "rn": F.lit(1)}, lasts={"last": F.col("v")}, nexts={"next": F.col("v")},
                   lags={"lag": F.col("v"), "lag_s": F.col("s")}, leads={"lead": F.col("s")}, maxes={"max": F.col("v")})
        return o.result().withColumn("sum", F.round("sum", 6))

    cols = ("k", "i", "v", "s", "sum", "rn", "last", "next", "lag", "lag_s", "lead", "max")
    assert as_set(run(True), *cols) == as_set(run(False), *cols)


def test_global_scan_without_keys(spark):
    d = frame(spark)
    got = ordered(d, [], ["i"]).row_number("rn").result()
    assert all(r["rn"] == r["i"] + 1 for r in got.collect())


def test_rank_and_counts(spark):
    d = frame(spark)
    for asc in (True, False):
        a = min_rank(d, ["k"], "v", "r", asc, True)
        b = min_rank(d, ["k"], "v", "r", asc)
        assert as_set(a, "i", "r") == as_set(b, "i", "r")
    c = {(r["k"], r["v"]): r["c"] for r in running_count_at(d.filter("v is not null"), ["k"], "v", F.lit(1), "c", True).collect()}
    data = rows()
    for (k, v), n in c.items():
        assert n == sum(1 for r in data if r[0] == k and r[2] is not None and r[2] <= v)


def test_success_rates_against_nested_loops(spark):
    data = rows()
    want = {}
    for k, i, v, _ in data:
        members = [r for r in data if r[0] == k]
        ok = k is not None and v is not None and len(members) > 5
        want[i] = sum(1 for m in members if m[2] is not None and m[2] <= v / 10) / len(members) if ok else 0.0
    for limit in (True, False):
        got = success_rates(frame(spark), "k", "v", hot=limit)
        assert {r["i"]: r["prop_10x"] for r in got.collect()} == want


def test_group_of_five_has_no_rate_and_six_has(spark):
    d = spark.createDataFrame([("a", 300.0)] + [("a", 30.0)] * 4 + [("b", 300.0)] + [("b", 30.0)] * 5, "g string, p double")
    got = {(r["g"], r["p"]): r["prop_10x"] for r in success_rates(d, "g", "p").collect()}
    assert got[("a", 300.0)] == 0.0 and got[("b", 300.0)] == 5 / 6


def test_null_potency_counts_but_has_no_rank(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", None), ("a", 3.0)], "g string, p double")
    got = sorted(((r["p"] or 0.0, r["rank"], r["count"]) for r in rank_in_group(d, "g", "p", True).collect()))
    assert got == [(0.0, None, 4), (1.0, 1, 4), (1.0, 1, 4), (3.0, 3, 4)]


def test_series_operators_do_not_depend_on_the_path(spark):
    d = frame(spark).filter("k is not null and v is not null")
    for fn in (
        lambda n: integrate(d, ["k"], "i", "v", "v", n).select("k", F.round("integral", 5), F.round("uncertainty", 5)),
        lambda n: plateau(d, ["k"], "i", "v", 0.3, hot=n),
        lambda n: exact_percentile(d, ["k"], "v", 0.95, "p", n).select("k", F.round("p", 9)),
        lambda n: smooth(d, ["k"], "i", "v", 7, 2, hot=n).select("k", "i", F.round("smooth", 6)),
        lambda n: renumber_residues(d, ["k"], ["i"], "s", "v", per_atoms={"x": 3}, hot=n).select("k", "i", "new_resid"),
        lambda n: chain_numbers(d, ["k"], ["i"], "s", F.col("v") == 1.0, n).select("k", "i", "chain_no"),
    ):
        a, b = fn(True), fn(False)
        assert as_set(a, *a.columns) == as_set(b, *b.columns)
