"""Trajectory queries: each embedding is a frame of 22 points (7 residues of N, CA, C, and one more N; the last point is padded with zeros)."""

from __future__ import annotations

from pyspark.sql import functions as F

from moltables.operators import frames as R
from moltables.operators import histograms as H
from moltables.operators import principal as P
from moltables.operators import trajectory as J
from moltables.operators.structure import superpose_alpha_carbons
from moltables.plans.registry import big, fitted_rmsd, query, rounded, rs, table


def frames(spark, sf):
    e = table(spark, sf, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    at = lambda i: F.coalesce(F.get("_v", i), F.lit(0.0))
    pts = F.transform(F.sequence(F.lit(0), F.lit(21)), lambda i: F.struct(
        i.alias("atom"), at(i * 3).alias("x"), at(i * 3 + 1).alias("y"), at(i * 3 + 2).alias("z")))
    d = e.select(F.col("vec_id").alias("frame"), "label", v.alias("_v")).select("frame", "label", F.explode(pts).alias("p"))
    name = F.get(F.array(F.lit("N"), F.lit("CA"), F.lit("C")), F.col("p.atom") % 3)
    return d.select("frame", "label", F.col("p.atom").alias("atom"), name.alias("name"), F.lit("A").alias("chain"),
                    F.floor(F.col("p.atom") / 3).cast("int").alias("resseq"), "p.x", "p.y", "p.z")


_F = """f as (select vec_id frame, label, a::int atom, coalesce(embedding[a*3+1], 0)::double x, coalesce(embedding[a*3+2], 0)::double y, coalesce(embedding[a*3+3], 0)::double z, a % 3 nm, (a // 3)::int res from embeddings, range(22) r(a))"""


def _tors(p1, p2, p3, p4):
    def d(a, b, c):
        return f"({b}.{c} - {a}.{c})"
    u, v, w = ({c: d(a, b, c) for c in "xyz"} for a, b in ((p1, p2), (p2, p3), (p3, p4)))
    cr = lambda s, t: {"x": f"({s['y']}*{t['z']}-{s['z']}*{t['y']})", "y": f"({s['z']}*{t['x']}-{s['x']}*{t['z']})", "z": f"({s['x']}*{t['y']}-{s['y']}*{t['x']})"}
    dot = lambda s, t: "(" + "+".join(f"{s[c]}*{t[c]}" for c in "xyz") + ")"
    n1, n2 = cr(u, v), cr(v, w)
    ang = f"degrees(acos(greatest(-1, least(1, {dot(n1, n2)} / (sqrt({dot(n1, n1)}) * sqrt({dot(n2, n2)}))))))"
    return f"(case when {dot(cr(n1, n2), v)} < 0 then -{ang} else {ang} end)"


_TORS = f"""{_F}, t as (select n.frame, n.res as resseq,
  case when pc.frame is not null and nn.frame is not null then {_tors('pc', 'n', 'ca', 'c')} end phi, case when pc.frame is not null and nn.frame is not null then {_tors('n', 'ca', 'c', 'nn')} end psi
  from f n left join f ca on ca.frame = n.frame and ca.res = n.res and ca.nm = 1 left join f c on c.frame = n.frame and c.res = n.res and c.nm = 2
  left join f pc on pc.frame = n.frame and pc.res = n.res - 1 and pc.nm = 2 left join f nn on nn.frame = n.frame and nn.res = n.res + 1 and nn.nm = 0 where n.nm = 0)"""

_RMSD = f"""m as (select f.frame, count(*) n, sqrt(var_pop(f.x - r.x) + var_pop(f.y - r.y) + var_pop(f.z - r.z)) rmsd from f join f r on r.atom = f.atom and r.frame = 0 group by 1)"""


@query(f"with {_TORS} select frame, 'A' as chain, resseq, {rs('phi', 4)} as phi_deg, {rs('psi', 4)} as psi_deg from t")
def torsion_angles(spark, sf):
    d = J.torsions(frames(spark, sf), ["frame"])
    return d.withColumns({"phi_deg": rounded("phi_deg", 4), "psi_deg": rounded("psi_deg", 4)})


@query(f"with {_F}, {_RMSD} select frame, {rs('rmsd')} as rmsd_angstrom from m")
def backbone_rmsd_to_first(spark, sf):
    d = J.backbone_rmsd(frames(spark, sf), [], "frame", ["atom"])
    return d.withColumn("rmsd_angstrom", rounded("rmsd_angstrom"))


@query(f"""with {_F}, m as (select f.label, f.frame, sqrt(var_pop(f.x - r.x) + var_pop(f.y - r.y) + var_pop(f.z - r.z)) rmsd from f join (select label, min(frame) f0 from f group by 1) s using (label)
join f r on r.atom = f.atom and r.frame = s.f0 group by all) select label, frame, {rs('rmsd')} as rmsd_angstrom from m""")
def backbone_rmsd_by_replica(spark, sf):
    f = frames(spark, sf)
    first = f.groupBy("label").agg(F.min("frame").alias("_f0"))
    d = f.join(first, "label").withColumn("step", F.col("frame") - F.col("_f0"))
    r = J.backbone_rmsd(d, ["label"], "step", ["atom"])
    return r.join(first, "label").select("label", (F.col("step") + F.col("_f0")).alias("frame"), rounded("rmsd_angstrom").alias("rmsd_angstrom"))


@query(f"with {_F} select res as residue, {rs('sqrt(var_pop(x) + var_pop(y) + var_pop(z))')} as rmsf_angstrom from f where nm = 1 group by 1")
def residue_fluctuations(spark, sf):
    d = J.fluctuation(frames(spark, sf).filter("name = 'CA'").withColumnRenamed("resseq", "residue"), ["residue"], label=None)
    return d.withColumn("rmsf_angstrom", rounded("rmsf_angstrom"))


@query(f"""with {_TORS}, {_RMSD} select frame, resseq, {rs('frame * 2.5', 4)} as time_ps, {rs('phi', 4)} as phi_deg, {rs('psi', 4)} as psi_deg, {rs('rmsd')} as rmsd_angstrom from t join m using (frame)""")
def per_frame_table(spark, sf):
    f = frames(spark, sf)
    t = J.torsions(f, ["frame"])
    d = J.frame_table(t, J.backbone_rmsd(f, [], "frame", ["atom"]), [], "frame", 2.5, keep=["resseq"])
    return d.withColumns({"time_ps": rounded("time_ps", 4), "phi_deg": rounded("phi_deg", 4), "psi_deg": rounded("psi_deg", 4),
                          "rmsd_angstrom": rounded("rmsd_angstrom")})


_COV = """l as (select vec_id, i::int i, embedding[i + 1]::double v from embeddings, range(64) r(i)), c as (select i, avg(v) m from l group by 1), d as (select vec_id, i, v - m v from l join c using (i))"""


@query(f"with {_COV} select a.i, b.i as j, {rs('sum(a.v * b.v) / (count(*) - 1)', 9)} as cov from d a join d b on a.vec_id = b.vec_id and a.i <= b.i group by all")
def coordinate_covariance(spark, sf):
    return J.vector_covariance(_vectors(spark, sf), "v").withColumn("cov", rounded("cov", 9))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


# Leading eigenvectors one after the other: the covariance squared thirty times, its largest column, and what that explains taken off.
_PCA = """x0 as (select vec_id, embedding::double[] v from embeddings where embedding is not null),
mean as (select list(a order by i) m from (select i, avg(v[i]) a from x0, range(1, 65) r(i) group by i)),
x as (select vec_id, list_transform(range(1, 65), lambda k: v[k] - m[k]) d from x0, mean),
cov as (select list(r order by i) c from (select i, list(s order by j) r from (select a.i i, b.i j, sum(d[a.i] * d[b.i]) / (count(*) - 1) s from x, range(1, 65) a(i), range(1, 65) b(i) group by all) group by i)),
p as (select 1 comp, 0 step, c, c p, null::double val, null::double[] vec from cov
  union all
  select case when step < 30 then comp else comp + 1 end, case when step < 30 then step + 1 else 0 end, c2,
    case when step < 30 then list_transform(q, lambda r: list_transform(r, lambda t: t / list_sum(list_transform(range(1, 65), lambda k: q[k][k])))) else c2 end, val2, u
  from (select *, case when u is null then c else list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: c[i][j] - val2 * u[i] * u[j])) end c2
    from (select *, list_dot_product(u, list_transform(c, lambda r: list_dot_product(r, u))) val2
      from (select *, list_transform(w, lambda t: t / sqrt(list_dot_product(w, w)) * sign(w[list_position(list_transform(w, lambda t2: abs(t2)), list_max(list_transform(w, lambda t3: abs(t3))))])) u
        from (select *, case when step < 30 then list_transform(p, lambda r: list_transform(p, lambda s: list_dot_product(r, s))) end q,
            case when step = 30 then p[list_position(list_transform(range(1, 65), lambda k: p[k][k]), list_max(list_transform(range(1, 65), lambda k2: p[k2][k2])))] end w
          from p where comp <= 10))))),
e as (select (comp - 1)::int component, val, vec from p where vec is not null)"""


@query(f"""with recursive {_PCA}, t as (select list_sum(list_transform(range(1, 65), lambda k: c[k][k])) total from cov)
select component, {rs('val')} as eigenvalue, {rs('100 * val / sum(val) over ()')} as variance_explained_percent, {rs('100 * val / total')} as variance_total_percent,
  {rs('100 * sum(val) over (order by component) / sum(val) over ()')} as cumulative_percent from e, t""")
def principal_component_table(spark, sf):
    comp, _ = P.principal_components(_vectors(spark, sf), "v", 10)
    return comp.withColumns({c: rounded(c, 6) for c in comp.columns if c != "component"})


@query(f"with recursive {_PCA} select vec_id as frame, component, {rs('list_dot_product(d, vec)', 5)} as projection from x, e")
def principal_projections(spark, sf):
    v = _vectors(spark, sf)
    _, ev = P.principal_components(v, "v", 10)
    return P.projections(v, "v", ev, ["frame"]).withColumn("projection", rounded("projection", 5))


# Frames of one point each, spread along the order key: the number of near frames does not grow with the table.
_EPS = 8.0
_PAIRS = f"""g as (select o_orderkey id, o_orderkey::double x, (o_custkey % 40)::double y, o_totalprice / 20000 z from orders),
p0 as (select a.id i, b.id j, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) rmsd from g a join g b on b.id between a.id + 1 and a.id + 8),
p1 as (select * from p0 where rmsd <= {_EPS})"""


def _single_points(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame"), F.array(
        F.col("o_orderkey").cast("double"), (F.col("o_custkey") % 40).cast("double"), F.col("o_totalprice") / 20000).alias("v"))


@query(f"with {_PAIRS} select i, j, {rs('rmsd')} as rmsd from p1")
def close_frame_pairs(spark, sf):
    return R.frame_pairs(_single_points(spark, sf), "frame", "v", _EPS, 1).withColumn("rmsd", rounded("rmsd"))


# Frames of 64 values, every pair of them compared in the SQL.
_NEAR = 0.25
_NEAR_PAIRS = f"""g as (select vec_id id, embedding::double[] v from embeddings where embedding is not null),
w as (select a.id i, b.id j, sqrt(pow(list_distance(a.v, b.v), 2) / 22.0) rmsd from g a join g b on a.id < b.id), n as (select * from w where rmsd <= {_NEAR})"""


@query(f"with {_NEAR_PAIRS} select i, j, {rs('rmsd')} as rmsd from n")
def near_frame_pairs(spark, sf):
    return R.frame_pairs(_vectors(spark, sf), "frame", "v", _NEAR, 22).withColumn("rmsd", rounded("rmsd"))


_SIEVED = f"""{_NEAR_PAIRS}, p as (select i, j, rmsd from n union all select j, i, rmsd from n), q as (select * from p where i % 3 = 0 and j % 3 = 0),
core as (select i from q group by 1 having count(*) + 1 >= 4), l as (select i, j from q where i in (select i from core) and j in (select i from core)),
reach as (select i, i as c from core union select l.i, r.c from l join reach r on r.i = l.j), comp as (select i, min(c) c from reach group by 1),
b as (select i, arg_min(j, (rmsd, j)) j from p where i not in (select i from core) and j in (select i from core) group by 1),
s as (select id as frame, coalesce(comp.c, bc.c) as cluster, comp.c is not null as core from g left join comp on comp.i = id left join b on b.i = id left join comp bc on bc.i = b.j)"""


def _sieved(spark, sf):
    return R.sieved_clusters(_vectors(spark, sf), "frame", "v", _NEAR, 22, min_points=4, sieve=3)


@query(f"with recursive {_SIEVED} select * from s")
def sieved_frame_clusters(spark, sf):
    return _sieved(spark, sf)


@query(f"""with recursive {_SIEVED} , c as (select frame // 100 as block, cluster, count(*) as frames from s group by all)
select block, cluster, frames, {rs('frames / sum(frames) over (partition by block)::double', 8)} as fraction from c""")
def cluster_population_over_time(spark, sf):
    d = R.population_over_time(_sieved(spark, sf), F.floor(F.col("frame") / 100))
    return d.withColumn("fraction", rounded("fraction", 8))


@query(f"""
with e as (select vec_id, embedding::double[] v from embeddings), r as (select * from e where vec_id < 5)
select e.vec_id as frame, r.vec_id as reference, {rs("sqrt(list_sum(list_transform(range(1, 65), lambda k: pow(e.v[k] - r.v[k], 2))) / 22.0)")} as rmsd from e, r
""")
def rmsd_to_reference_frames(spark, sf):
    v = _vectors(spark, sf)
    return R.rmsd_to_references(v, v.filter("frame < 5"), "frame", "v", 22).withColumn("rmsd", rounded("rmsd"))


@query(f"""with {_F}, w as (select *, case nm when 0 then 14.0 else 12.0 end m from f), c as (select frame, sum(m*x)/sum(m) cx, sum(m*y)/sum(m) cy, sum(m*z)/sum(m) cz from w group by 1)
select frame, {rs('sqrt(sum(m * (pow(x-cx,2) + pow(y-cy,2) + pow(z-cz,2))) / sum(m))')} as rg from w join c using (frame) group by 1""")
def gyration_radii(spark, sf):
    m = F.when(F.col("name") == "N", 14.0).otherwise(12.0)
    return J.gyration(frames(spark, sf), ["frame"], m).withColumn("rg", rounded("rg"))


@query(f"""with {_F}, {_RMSD}, h as (select label, floor(rmsd / 0.02)::int bin, count(*) c from m join (select distinct frame, label from f) using (frame) group by all)
select label, bin, coalesce(c, 0) as count, {rs('coalesce(c, 0) / sum(c) over (partition by label)::double', 8)} as fraction from (select distinct label from f) join (select unnest(range((select max(bin) + 1 from h)))::int bin) on true left join h using (label, bin)""")
def rmsd_histogram_by_replica(spark, sf):
    f = frames(spark, sf)
    r = J.backbone_rmsd(f, [], "frame", ["atom"]).join(f.select("frame", "label").distinct(), "frame")
    top = r.agg(F.coalesce(F.floor(F.max("rmsd_angstrom") / 0.02), F.lit(-1))).first()[0]
    h = H.binned_means(r, "rmsd_angstrom", ["rmsd_angstrom"], 0.0, 0.02, int(top) + 1, ["label"])
    tot = h.groupBy("label").agg(F.sum("count").alias("t"))
    return h.join(tot, "label").select("label", "bin", "count", rounded(F.col("count") / F.col("t"), 8).alias("fraction"))


# Waters: one per order with its first three rows as O, H, H; other orders are not waters.
_W = """w as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) k, l_quantity x, l_extendedprice / 1000 y, l_discount * 100 z from lineitem),
v as (select l_orderkey, max(x) filter (k = 1) ox, max(y) filter (k = 1) oy, max(z) filter (k = 1) oz, avg(x) filter (k > 1) hx, avg(y) filter (k > 1) hy, avg(z) filter (k > 1) hz from w group by 1 having count(*) = 3),
d as (select l_orderkey, oz z, hx - ox x, hy - oy y, hz - oz dz from v),
c as (select l_orderkey, z, case when x*x + y*y + dz*dz > 0 then dz / sqrt(x*x + y*y + dz*dz) else 0 end c from d)"""


def _waters(spark, sf):
    from moltables.plans.structure import atoms
    a = atoms(spark, sf).withColumn("name", F.when(F.col("serial") == 1, "O").otherwise("H1"))
    return J.water_dipoles(a, ["mol"])


@query(f"with {_W} select l_orderkey as mol, {rs('z')} as z, {rs('c')} as cos_theta, {rs('0.5 * (3 * c * c - 1)')} as p2 from c")
def water_dipole_orientation(spark, sf):
    return _waters(spark, sf).withColumns({c: rounded(c) for c in ("z", "cos_theta", "p2")})


@query(f"""with {_W}, b as (select floor((z + 0.5) / 1.0)::int bin, count(*) n, avg(c) mc, avg(0.5 * (3 * c * c - 1)) mp from c where z >= -0.5 and z < 11.5 group by 1)
select r.bin::int as bin, r.bin::double as center, coalesce(n, 0) as count, {rs('mc')} as mean_cos_theta, {rs('mp')} as mean_p2 from range(12) r(bin) left join b using (bin)""")
def water_orientation_profile(spark, sf):
    d = H.binned_means(_waters(spark, sf), "z", ["cos_theta", "p2"], -0.5, 1.0, 12)
    return d.withColumns({c: rounded(c) for c in ("mean_cos_theta", "mean_p2")})


@query(f"""with {_F}, c as (select frame, avg(x) cx, avg(y) cy, avg(z) cz from f where nm = 1 group by 1), w as (select frame, atom, {', '.join(f"({c} - c{c} + 0.5) - floor({c} - c{c} + 0.5) - 0.5 as {c}" for c in 'xyz')} from f join c using (frame))
select frame, {', '.join(rs(f'sum({c})', 5) + f' as {c}' for c in 'xyz')}, count(*) as n from w group by 1""")
def slab_centred_frames(spark, sf):
    d = J.centred(frames(spark, sf), ["frame"], F.col("name") == "CA", F.lit(1.0), box=(1.0, 1.0, 1.0))
    return d.groupBy("frame").agg(*[rounded(F.sum(c), 5).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("n"))


@query(f"""
with recursive {_PAIRS}, p as (select i, j, rmsd from p1 union all select j, i, rmsd from p1), core as (select i from p group by 1 having count(*) + 1 >= 5),
l as (select i, j from p where i in (select i from core) and j in (select i from core)),
reach as (select i, i as c from core union select l.i, r.c from l join reach r on r.i = l.j), comp as (select i, min(c) c from reach group by 1),
b as (select i, arg_min(j, (rmsd, j)) j from p where i not in (select i from core) and j in (select i from core) group by 1)
select o_orderkey as frame, coalesce(comp.c, bc.c) as cluster, comp.c is not null as core from orders left join comp on comp.i = o_orderkey left join b on b.i = o_orderkey left join comp bc on bc.i = b.j
""")
def density_based_clusters(spark, sf):
    v = _single_points(spark, sf)
    pairs = R.frame_pairs(v, "frame", "v", _EPS, 1)
    return R.density_clusters(pairs, v.select("frame"), "frame", 5)


@query("select vec_id as frame, vec_id * 0.5::double as time_ps from embeddings")
def frame_times(spark, sf):
    from moltables.operators.series import frame_time
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), frame_time(big("vec_id"), 0.5).alias("time_ps"))


@query(f"""with {_F}, pt as (select a.frame, a.x, a.y, a.z, b.x rx, b.y ry, b.z rz from f a join f b on b.frame = a.frame + 1 and b.atom = a.atom where a.nm = 1 and a.res between 1 and 5),
{fitted_rmsd("pt", "frame")} select frame, {rs('rmsd', 5)} as rmsd from fit""")
def alpha_carbon_fits(spark, sf):
    """Fit of the alpha carbons of residues 1 to 5 of each frame on the next frame's."""
    f = frames(spark, sf)
    fit = superpose_alpha_carbons(f, f.withColumn("frame", F.col("frame") - 1), 1, 5, ["frame"])
    return fit.select("frame", rounded("rmsd", 5).alias("rmsd"))
