import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moltables.operators import features as X
from moltables.operators import fits
from moltables.operators import frames as R
from moltables.operators import similarity as M
from moltables.operators import structure as S
from moltables.functions.sequence import find_exact, helix_types


def fps(seed, n=24):
    r = random.Random(seed)
    out = []
    for i in range(n):
        base = r.choice([range(0, 12), range(8, 20), range(30, 40)])
        bits = sorted({b for b in base if r.random() < 0.8} | {r.randrange(50)})
        out.append((i, bits))
    out.append((n, out[0][1]))
    return out


def jac(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


def brute(data, cut, linkage):
    cl = {i: [i] for i, _ in data}
    bits = dict(data)
    while True:
        best = None
        for a in sorted(cl):
            for b in sorted(cl):
                if a < b:
                    ds = [1 - jac(bits[i], bits[j]) for i in cl[a] for j in cl[b]]
                    d = max(ds) if linkage == "complete" else sum(ds) / len(ds)
                    if d < cut - 1e-12 and (best is None or d < best[0] - 1e-12):
                        best = (d, a, b)
        if best is None:
            return {frozenset(v) for v in cl.values()}
        cl[best[1]] += cl.pop(best[2])


def test_similar_pairs_are_exact(spark):
    data = fps(3, 40)
    df = spark.createDataFrame(data, "id int, bits array<int>")
    reps, members = M.distinct_fingerprints(df, "id", "bits")
    kept = {r["id"]: r["bits"] for r in reps.collect()}
    for t in (0.3, 0.5, 0.8):
        want = {(a, b) for a in kept for b in kept if a < b and jac(kept[a], kept[b]) >= t}
        assert {(r["a"], r["b"]) for r in M.similar_pairs(reps, t).collect()} == want
    assert {r["id"] for r in members.filter("representative = 0").select("representative", F.col("representative").alias("x")).withColumnRenamed("representative", "id").collect()} == {0}


def test_linkage_matches_sequential_merging(spark):
    for seed, linkage in ((5, "complete"), (6, "average")):
        data = fps(seed, 16)
        df = spark.createDataFrame(data, "mol int, bits array<int>")
        got = {}
        for r in M.linkage_clusters(df, "mol", "bits", 0.5, linkage).collect():
            got.setdefault(r["cluster"], set()).add(r["mol"])
        want = brute(data, 0.5, linkage)
        # Equal distances may merge in either order; every cluster obeys the cut and none can still merge.
        bits = dict(data)
        score = (lambda ds: max(ds)) if linkage == "complete" else (lambda ds: sum(ds) / len(ds))
        cl = list(got.values())
        assert len(cl) == len(want)
        for i, a in enumerate(cl):
            for b in cl[i + 1:]:
                assert score([1 - jac(bits[x], bits[y]) for x in a for y in b]) >= 0.5 - 1e-9


def test_components(spark):
    r = random.Random(2)
    nodes = spark.range(60)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(20, 40)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = M.connected_components(nodes, spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["id"]: r["component"] for r in got} == {i: find(i) for i in range(60)}


def test_superposition_recovers_a_rotation(spark):
    rng = np.random.default_rng(1)
    p = rng.normal(size=(20, 3)) + 50
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    t = p @ q + np.array([1.0, -2.0, 3.0])
    mk = lambda a: spark.createDataFrame([("m", i, *map(float, r)) for i, r in enumerate(a)], "mol string, ordinal int, x double, y double, z double")
    a, b = mk(p), mk(t)
    fit = S.superpose(S.matched_by_order(a, b, ["mol"], "ordinal"), ["mol"])
    assert fit.first()["rmsd"] < 1e-6
    got = np.array([[r["x"], r["y"], r["z"]] for r in S.moved(a, fit, ["mol"]).orderBy("ordinal").collect()])
    assert np.allclose(got, t, atol=1e-6)


def test_farthest_pair_and_neighbours_by_brute_force(spark):
    r = random.Random(4)
    pts = [(i % 2, i, r.uniform(0, 10), r.uniform(0, 10), r.uniform(-5, 5)) for i in range(80)]
    d = spark.createDataFrame(pts, "g int, i int, x double, y double, z double")
    dist = lambda a, b: math.dist(a[2:], b[2:])
    for row in S.farthest_pair(d, ["g"], "i").withColumnsRenamed({"i": "p", "j": "q"}).collect():
        best = max(dist(a, b) for a in pts for b in pts if a[0] == b[0] == row["g"])
        assert abs(row["distance"] - best) < 1e-9
    got = {(x["g"], x["i"], x["j"]) for x in S.neighbour_pairs(d, ["g"], "i", 2.0).collect()}
    assert got == {(a[0], a[1], b[1]) for a in pts for b in pts if a[0] == b[0] and a[1] < b[1] and dist(a, b) < 2.0}


def test_frame_pairs_by_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 6))
    d = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "f int, v array<double>")
    got = {(r["i"], r["j"]) for r in R.frame_pairs(d, "f", "v", 1.2, 2).collect()}
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if np.sqrt(((v[i] - v[j]) ** 2).sum() / 2) <= 1.2}
    assert got == want


def test_ring_bonds_are_not_rotatable(spark):
    ring = [(1, 2), (2, 3), (3, 4), (4, 1), (4, 5), (5, 6), (6, 7)]
    b = spark.createDataFrame([("m", k + 1, a, c, "1") for k, (a, c) in enumerate(ring)], "mol string, num int, a1 int, a2 int, type string")
    assert {r["num"] for r in S.rotatable_bonds(b, ["mol"]).collect()} == {5, 6}


def test_distributions():
    assert abs(fits.t_quantile(0.975, 10) - 2.228138852) < 1e-7
    assert abs(fits.correlation_p_value(0.5, 20) - 0.02477) < 1e-5
    assert abs(fits.f_p_value(4.0, 1, 18) - 0.0608) < 1e-3


def test_motifs_and_helices(spark):
    d = spark.createDataFrame([("AAAA", "CHHHHHHHHHC"), ("xAAx", "HHHHHCHH")], "s string, h string")
    got = d.select(find_exact(F.col("s"), "aa").alias("m"), helix_types(F.col("h")).alias("h")).collect()
    assert [r["m"] for r in got] == [[0, 1, 2], [1]]
    assert [r["h"] for r in got] == ["C1111H2222C", "13332C33"]


def test_rules_folds_and_selection(spark):
    rng = np.random.default_rng(0)
    rows = [(f"r{i % 6}", "lig1" if i % 2 else "lig2", "wt", float(i % 2) * 4 + rng.normal(), float(rng.normal())) for i in range(120)]
    d = spark.createDataFrame(rows, "replicate string, ligand string, mutant string, res_1 double, res_2 double")
    assert X.feature_columns(d) == ["res_1", "res_2"]
    lab = X.label_groups(d, ["A|LIG1 |wt|*", "B|lig2|WT|r0,r2,r4"])
    assert {r["group_label"] for r in lab.select("group_label").distinct().collect()} == {"A", "B"}
    curve = X.greedy_selection(lab, ["res_1", "res_2"], "group_label", "replicate", max_k=2)
    assert curve[0][2] == ["res_1"] and curve[0][1] > 0.9


def test_similar_pairs_come_out_of_blocks_alone(spark):
    """Sets of many sizes in blocks of the same and of neighbouring size classes; no table of candidates, which grow with the square of the rows, is shuffled."""
    r = random.Random(8)
    base = [r.sample(range(200), r.randint(1, 60)) for _ in range(10)]
    data = [(i, sorted({x for x in r.choice(base) if r.random() > 0.2} | {r.randrange(200)})) for i in range(150)]
    reps, _ = M.distinct_fingerprints(spark.createDataFrame(data, "id int, bits array<int>"), "id", "bits")
    kept = {x["id"]: x["bits"] for x in reps.collect()}
    for t in (0.3, 0.6):
        got = M.similar_pairs(reps, t)
        want = {(a, b): jac(kept[a], kept[b]) for a in kept for b in kept if a < b and jac(kept[a], kept[b]) >= t}
        assert {(x["a"], x["b"]): x["similarity"] for x in got.collect()} == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "array_intersect" not in plan and plan.count("FlatMapGroupsInArrow") >= 1
    lists = pa.array([kept[i] for i in sorted(kept)], pa.list_(pa.int32()))
    for places, tile in ((1 << 22, 1 << 20), (8, 5)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(M, "PLACES", places)
            m.setattr(M, "TILE", tile)
            for left in (len(lists), 40):
                i, j, s = M.block_pairs(lists, left, 0.5)
                sets = lists.to_pylist()
                want = {(a, b): jac(sets[a], sets[b]) for a in range(left) for b in range(a + 1 if left == len(lists) else left, len(lists)) if jac(sets[a], sets[b]) >= 0.5}
                assert dict(zip(zip(i.tolist(), j.tolist()), s.tolist())) == want


def test_rows_of_similar_pairs_are_not_copied(spark, monkeypatch):
    """Blocks are written once and read by their tasks: no set goes through the shuffle to each block it meets, and the blocks can be deleted."""
    monkeypatch.setattr(M, "CELL_ROWS", 3)
    r = random.Random(12)
    data = [(i, sorted(r.sample(range(60), r.randint(1, 30))), "ab"[i % 2] if i % 7 else None) for i in range(90)]
    data += [(100 + i, b[:-1] + [99], g) for i, b, g in data]
    reps = spark.createDataFrame(data, "id int, bits array<int>, g string")
    near = M.similar_pairs(reps, 0.5)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "bits" not in plan and plan.count("FlatMapGroupsInArrow") == 1
    want = {(a, b): jac(x, y) for a, x, _ in data for b, y, _ in data if a < b and jac(x, y) >= 0.5}
    assert {(x["a"], x["b"]): x["similarity"] for x in near.collect()} == want and want
    of = {i: g for i, _, g in data}
    for kept, group in ((want, None), ({p for p in want if of[p[0]] and of[p[0]] == of[p[1]]}, "g")):
        got = [(x["a"], x["b"]) for x in M.similar_pairs(reps, 0.5, group).collect()]
        assert len(got) == len(set(got)) and set(got) == set(kept)
    assert M.similar_pairs(reps.filter("id < 0"), 0.5).collect() == []
    M.forget(near)
    with pytest.raises(Exception):
        near.collect()


def test_blocks_cut_the_weights_into_equal_parts():
    classes = [(0, 1, 1, 5), (1, 2, 3, 30), (2, 4, 4, 1)]
    rows, spans = M._blocks(classes, 10)
    assert rows == [(0, 0, 5), (1, 5, 30), (2, 35, 1)] and spans == [(1, 3), (2, 3), (2, 3), (2, 4)]
