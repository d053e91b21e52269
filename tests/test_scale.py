"""Plans and bounds that keep large tables off the driver and out of single tasks."""

import math

import numpy as np

from pyspark.sql import functions as F

from moltables.functions.units import KT
from moltables.operators import assays as A
from moltables.operators import frames as R
from moltables.operators import scores as D
from moltables.operators import series as S
from moltables.operators import structure as X
from moltables.operators import variance as V
from moltables.sources import sinks as SK
from moltables.sources import structures as ST
from moltables.sources.lines import lines_from


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(df, path):
    """Read back from a file, whose size the planner knows."""
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_neighbours_are_not_broadcast(spark, tmp_path):
    atoms = stored(spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(30)], "id long, x double, y double, z double"), tmp_path / "a")
    springs = X.elastic_network(atoms, [], "id", 1.0, 9.0, 0.3, 1.0, 500.0, 60.0)
    for d in (X.neighbour_pairs(atoms, [], "id", 2.5), springs):
        assert "BroadcastExchange" not in plan_of(d)
    got = {(r["i"], r["j"]) for r in X.neighbour_pairs(atoms, [], "id", 2.5).collect()}
    assert got == {(i, j) for i in range(30) for j in range(i + 1, 30) if j - i < 2.5}


def test_atoms_do_not_meet_their_template_by_shuffle(spark):
    atoms = spark.createDataFrame([(m, s, "A", "CN"[s % 2], 1.0 * s, 0.0, 0.0) for m in range(5) for s in range(4)],
                                  "mol long, serial long, resname string, name string, x double, y double, z double")
    mapping = spark.createDataFrame([("A", "C", "BB"), ("A", "N", "SC")], "resname string, name string, bead string")
    template = spark.createDataFrame([("A", "N", 1), ("A", "C", 2)], "resname string, name string, position int")
    beads = X.beads(atoms, mapping, ["mol"], X.atom_mass_by_letter(atoms["name"]))
    serials = X.template_serials(atoms, template, ["mol"])
    for d in (beads, serials):
        assert "SortMergeJoin" not in plan_of(d)
    assert {(r["mol"], r["bead"], r["x"], tuple(r["serials"])) for r in beads.collect()} == {
        (m, b, x, s) for m in range(5) for b, x, s in (("BB", 1.0, (0, 2)), ("SC", 2.0, (1, 3)))}
    assert {tuple(r["serials"]) for r in serials.collect()} == {(1, 3, 0, 2)}


def test_copies_of_a_frame_do_not_grow_with_the_table():
    for n in (1_000, 100_000, 10_000_000):
        assert -(-n // R.block_rows(n, 3, R.BLOCK, R.SIDE)) <= R.SIDE
        assert -(-n // R.block_rows(n, 3, V.BLOCK, V.SIDE)) <= V.SIDE or R.block_rows(n, 3, V.BLOCK, V.SIDE) * 24 > R.BLOCK_BYTES // 2
    assert R.block_rows(10**9, 64, 1000, 16) * 64 * 8 <= R.BLOCK_BYTES


def near(v, w, eps, same):
    return {(i, j) for i in range(len(v)) for j in range(len(w)) if (not same or i < j) and np.sqrt(((v[i] - w[j]) ** 2).sum()) <= eps}


def test_many_small_cells_and_crowded_ones(spark, monkeypatch):
    """Groups of a few frames, groups cut by an Arrow batch, groups with products, and several blocks."""
    v = np.concatenate([np.arange(300.0)[:, None] * [1.0, 0.1], np.full((120, 2), 7.25), np.random.default_rng(1).normal(size=(100, 2)) + 500])
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "f long, v array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for block, small, pairs, tile in ((1000, 1 << 14, 1 << 20, 1000), (5, 10, 16, 3), (5, 0, 16, 1000), (1000, 100, 50, 4)):
            for name, x in (("BLOCK", block), ("SMALL", small), ("PAIRS", pairs), ("TILE", tile)):
                monkeypatch.setattr(R, name, x)
            got = [(r["i"], r["j"]) for r in R.frame_pairs(d, "f", "v", 2.0, 1).collect()]
            assert len(got) == len(set(got)) and set(got) == near(v, v, 2.0, True)
            links = [(r["i"], r["j"] - 200) for r in R.frame_links(d.filter("f < 200"), d.filter("f >= 200"), "f", "v", 2.0, 1).collect()]
            assert len(links) == len(set(links)) and set(links) == near(v[:200], v[200:], 2.0, False)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cells_are_not_grouped_in_python(spark):
    d = spark.createDataFrame([(i, [float(i)]) for i in range(40)], "f long, v array<double>")
    assert "CoGroup" not in plan_of(R.frame_pairs(d, "f", "v", 2.0, 1))


def test_an_exploded_index_is_not_broadcast(spark, tmp_path):
    frames = stored(spark.createDataFrame([(i, i % 3, i % 2) for i in range(12)], "event long, slot long, time long"), tmp_path / "f")
    who = stored(spark.createDataFrame([(0, 100), (1, 101), (1, 102), (None, 103)], "slot long, walker long"), tmp_path / "w")
    index = who.select("slot", "walker", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("time"))
    d = S.demultiplex(frames, index)
    assert "BroadcastExchange" not in plan_of(d)
    want = [(i, 100) for i in range(12) if i % 3 == 0] + [(i, w) for i in range(12) if i % 3 == 1 for w in (101, 102)]
    assert sorted((r["event"], r["walker"]) for r in d.collect()) == sorted(want)


def test_success_rates_read_each_value_once(spark):
    """The count at a tenth of a potency stays beside it: nothing is aggregated by the doubled values, and they are not joined again."""
    rows = [(g, p) for g in (1, 2) for p in (1.0, 1.0, 10.0, 10.0, 100.0, 50.0, 2.0)] + [(1, None), (3, 1.0), (3, 10.0), (None, 10.0)]
    d = spark.createDataFrame(rows, "g long, p double")
    got = A.success_rates(d, "g", "p")
    plan = plan_of(got)
    assert plan.count("Generate ") == 1 and plan.count("Join") == 2
    def share(g, p):
        mine = [y for x, y in rows if x == g and g is not None]
        return sum(y is not None and y <= p / 10 for y in mine) / len(mine) if len(mine) > 5 and p is not None else 0.0
    for d in (got, A.success_rates(d, "g", "p", hot=True)):
        assert sorted((x["g"] or 0, x["p"] or 0, x["prop_10x"]) for x in d.collect()) == sorted((g or 0, p or 0, share(g, p)) for g, p in rows)


def test_a_line_is_rendered_once(spark):
    """Filters on what is parsed from a line do not render it again."""
    d = spark.range(8).select("id", (F.col("id") / 2).alias("x"))
    value = SK.pdb_atom_line(F.lit("ATOM"), F.col("id"), F.lit("CA"), F.lit("ALA"), F.lit("A"), F.col("id"), F.col("x"), F.col("x"), F.col("x"), F.lit(1.0), F.lit(0.0), F.lit("S"), F.lit("C"))
    got, _ = ST.pdb_atoms(lines_from(d, F.lit("f"), F.col("id"), value))
    assert plan_of(got).count("format_string(") == 1
    assert [(r["serial"], r["x"]) for r in got.orderBy("seq").collect()] == [(i, i / 2) for i in range(8)]
    nulls = lines_from(d, F.lit("f"), F.col("id"), F.when(F.col("id") > 2, F.lit("a")))
    assert sorted((r["seq"], r["value"]) for r in nulls.collect()) == [(i, "a" if i > 2 else None) for i in range(8)]


def test_few_neighbours_are_looked_up_by_offsets(spark):
    """Only the sizes of the compounds are joined, by compound; the weights are made in one pass."""
    rows = [("a", i, float(i * i % 17), "P.Q" if i % 2 else "P") for i in range(12)] + [("b", 1, 2.0, None), ("b", 2, 3.0, "Q"), ("c", 1, 1.0, "P")]
    d = spark.createDataFrame(rows, "compound string, pose int, value double, receptor string").withColumn("energy", -F.col("value"))
    nth = D.kth_on_line(d, "compound", "pose", "value", 3)
    assert plan_of(nth).count("Join ") == 1
    got = D.density_corrected_preferences(d, nth)
    assert plan_of(got).count("Join ") == 3
    w, low = {}, {c: min(-v for x, _, v, _ in rows if x == c) for c in "abc"}
    for r in nth.collect():
        v = next(x[2] for x in rows if (x[0], x[1]) == (r["compound"], r["pose"]))
        w[r["compound"], r["pose"]] = math.exp(-(-v - low[r["compound"]]) / KT) / (r["_k"] / r["rmsd"])
    total = {c: sum(x for (k, _), x in w.items() if k == c) for c in "ab"}
    want = {(c, p): sum(w[x[0], x[1]] for x in rows if x[0] == c and x[3] and p in x[3].split(".")) / total[c] for c, p in (("a", "P"), ("a", "Q"), ("b", "Q"))}
    assert {(r["compound"], r["part"]): round(r["preference"], 9) for r in got.collect()} == {k: round(x, 9) for k, x in want.items()}
