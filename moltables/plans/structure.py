"""Structure queries: line items as atoms (order = molecule, quantity/price/discount = coordinates)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from moltables.functions import residues as R
from moltables.operators import structure as X
from moltables.plans.registry import big, fitted_rmsd, query, rounded, rs, table

TYPES = {"A": "C.3", "N": "N.am", "R": "O.2"}
_TYPE = "case l_returnflag when 'A' then 'C.3' when 'N' then 'N.am' else 'O.2' end"
_MASS = "case l_returnflag when 'A' then 12.011 when 'N' then 14.00674 else 15.9994 end::double"
_XYZ = "l_quantity x, l_extendedprice / 1000 as y, l_discount * 100 as z"


def atoms(spark, sf, *extra):
    """Atoms with a serial unique inside the molecule (rows of an order, at most a few tens)."""
    li = table(spark, sf, "lineitem")
    t = F.when(F.col("l_returnflag") == "A", "C.3").when(F.col("l_returnflag") == "N", "N.am").otherwise("O.2")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.select(F.col("l_orderkey").alias("mol"), big(F.row_number().over(w)).alias("serial"), t.alias("type"),
                     F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"),
                     F.col("l_tax").alias("q"), *extra)


_A = f"""a as (select l_orderkey mol, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) serial,
  {_TYPE} as type, {_MASS} m, {_XYZ}, l_tax q, l_partkey, l_suppkey, l_linestatus, l_returnflag, l_linenumber from lineitem)"""


def _r(d, cols, n=6):
    return d.withColumns({c: rounded(c, n) for c in cols})


@query(f"with {_A} select mol, {rs('avg(x)', 9)} as cx, {rs('avg(y)', 9)} as cy, {rs('avg(z)', 9)} as cz, count(*) as n_atoms from a group by 1")
def molecule_centroids(spark, sf):
    return _r(X.centroid(atoms(spark, sf), ["mol"]), ("cx", "cy", "cz"), 9)


@query(f"with {_A} select mol, {rs('sum(m)')} as mass, {', '.join(rs(f'sum(m * {c}) / sum(m)', 9) + f' as c{c}' for c in 'xyz')} from a group by 1")
def centres_of_mass(spark, sf):
    return _r(X.centre_of_mass(atoms(spark, sf), ["mol"], R.mass_of_type(F.col("type"))).withColumn("mass", rounded("mass")), ("cx", "cy", "cz"), 9)


@query(f"with {_A} select mol, {rs('sum(m)')} as weight from a group by 1")
def molecular_weights(spark, sf):
    return _r(X.molecular_weight(atoms(spark, sf), ["mol"]), ("weight",))


@query(f"""
with {_A}, d as (select mol, sum(q) net_charge, {', '.join(f"sum(q * {c}) - sum(q) * sum(m * {c}) / sum(m) d{c}" for c in 'xyz')} from a group by 1)
select mol, {rs('net_charge')} as net_charge, {', '.join(rs(f'd{c}', 5) + f' as d{c}' for c in 'xyz')}, {rs('sqrt(dx*dx + dy*dy + dz*dz) * 4.796', 4)} as dipole from d
""")
def molecule_dipoles(spark, sf):
    d = X.dipole(atoms(spark, sf), ["mol"], "q", R.mass_of_type(F.col("type")))
    return _r(_r(_r(d, ("net_charge",)), ("dx", "dy", "dz"), 5), ("dipole",), 4)


@query(f"""
with {_A}, r as (select mol - 1 mol, serial, x rx, y ry, z rz, count(*) over (partition by mol) nr, type from a), p as (select *, count(*) over (partition by mol) np from a)
select mol, case when np = nr then {rs('sqrt(avg((x-rx)*(x-rx) + (y-ry)*(y-ry) + (z-rz)*(z-rz)))')} else -1 end as rmsd
from p join r using (mol, serial) group by mol, np, nr
""")
def pose_to_reference_rmsd(spark, sf):
    a = atoms(spark, sf)
    ref = a.withColumn("mol", F.col("mol") - 1)
    return _r(X.pose_rmsd(a, ref, ["mol"], ["mol"], "serial"), ("rmsd",))


@query(f"with {_A} select l_suppkey, {', '.join(rs(f'max({c}) - min({c})') + f' as box_{c}' for c in 'xyz')} from a where l_linestatus = 'O' group by 1")
def water_box_sizes(spark, sf):
    return _r(X.box_size(atoms(spark, sf, "l_suppkey", "l_linestatus").filter("l_linestatus = 'O'"), ["l_suppkey"]), ("box_x", "box_y", "box_z"))


@query(f"""
with {_A}, c as (select mol, avg(x) cx, avg(y) cy, avg(z) cz from a group by 1)
select mol, {rs('2 * sqrt(max((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz)))')} as diameter, {rs('2 * sqrt(max((x-cx)*(x-cx) + (y-cy)*(y-cy)))')} as diameter_xy from a join c using (mol) group by 1
""")
def molecule_diameters(spark, sf):
    return _r(X.diameter(atoms(spark, sf), ["mol"]), ("diameter", "diameter_xy"))


@query(f"""
with {_A}, h as (select l_suppkey, {', '.join(f'sum(m*{c})/sum(m) h{c}' for c in 'xyz')} from a where l_linestatus = 'O' group by 1),
t as (select l_suppkey, {', '.join(f'sum(m*{c}*2)/sum(m) t{c}' for c in 'xyz')} from a where l_linestatus = 'O' group by 1)
select l_suppkey, l_linestatus, {', '.join(rs(f"sum({c} + case when l_linestatus = 'O' then t{c} - h{c} else 0 end)", 2) + f' as {c}' for c in 'xyz')} from a join h using (l_suppkey) join t using (l_suppkey) group by all
""")
def protein_shift(spark, sf):
    a = atoms(spark, sf, "l_suppkey", "l_linestatus").withColumn("segid", F.when(F.col("l_linestatus") == "O", "PROA").otherwise("MEMB"))
    target = a.withColumns({c: F.col(c) * 2 for c in "xyz"})
    d = X.shift_to(a, target, R.mass_of_type(F.col("type")), ["l_suppkey"])
    return d.groupBy("l_suppkey", "l_linestatus").agg(*[rounded(F.sum(c), 2).alias(c) for c in "xyz"])


@query(f"""
with {_A}, b as (select mol, case when type = 'C.3' then 'BB' else 'SC' end bead, case when type = 'C.3' then 12 when type = 'N.am' then 14 else 16 end m, x, y, z, serial from a)
select mol, bead, {', '.join(rs(f'sum(m * {c}) / sum(m)', 9) + f' as {c}' for c in 'xyz')}, string_agg(serial::varchar, ' ' order by serial) as serials from b group by all
""")
def coarse_beads(spark, sf):
    a = atoms(spark, sf).withColumns({"resname": F.lit("RES"), "name": F.concat(F.substring("type", 1, 1), F.lit("1"))})
    mapping = spark.createDataFrame([("RES", "C1", "BB"), ("RES", "N1", "SC"), ("RES", "O1", "SC")], "resname string, name string, bead string")
    d = X.beads(a, mapping, ["mol"], X.atom_mass_by_letter(F.col("name")))
    return _r(d, "xyz", 9).select("mol", "bead", "x", "y", "z", F.array_join(F.transform("serials", lambda s: s.cast("string")), " ").alias("serials"))


@query(f"""
with {_A}, c as (select mol, avg(x) cx, avg(y) cy, avg(z) cz, count(*) n_atoms from a group by 1), d as (select *, sqrt(pow(cx - 25, 2) + pow(cy - 50, 2) + pow(cz - 5, 2)) distance from c)
select mol, n_atoms, {rs('distance')} as distance from d where distance <= 10
""")
def poses_near_site(spark, sf):
    site = spark.range(1).select(F.lit(25.0).alias("cx"), F.lit(50.0).alias("cy"), F.lit(5.0).alias("cz"))
    d = X.within_distance(X.centroid(atoms(spark, sf), ["mol"]), site, 10.0)
    return _r(d.select("mol", "n_atoms", "distance"), ("distance",))


# Atoms spread along the order key, so the number of neighbours does not grow with the table.
_LONG = """g as (select o_orderkey id, o_orderkey::double x, (o_custkey % 40)::double y, o_totalprice / 20000 z, o_orderstatus s from orders)"""


def long_atoms(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("double").alias("x"), (F.col("o_custkey") % 40).cast("double").alias("y"),
        (F.col("o_totalprice") / 20000).alias("z"), F.col("o_orderstatus").alias("s"))


_NEAR = """g a join g b on b.id between a.id + 1 and a.id + {c} and (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) < {c}*{c}"""
_DIST = "sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))"


@query(f"with {_LONG} select a.id as i, b.id as j, {rs(_DIST)} as distance from {_NEAR.format(c=8)}")
def contact_pairs(spark, sf):
    return _r(X.neighbour_pairs(long_atoms(spark, sf), [], "id", 8.0), ("distance",))


@query(f"""with {_LONG}, p as (select a.id i, b.id j, a.s, {_DIST} d from {_NEAR.format(c=8)} and a.s = b.s)
select s, i, j, {rs('d')} as distance from p union all select s, j, i, {rs('d')} from p""")
def residue_distances_by_chain(spark, sf):
    a = long_atoms(spark, sf).withColumns({"name": F.lit("CA"), "model": F.lit(0)})
    return _r(X.distance_table(a, ["s"], "id", 8.0), ("distance",))


@query(f"""with {_LONG}, p as (select a.id i, b.id j, {_DIST} d from {_NEAR.format(c=9)})
select i, j, {rs('d')} as distance, {rs('exp(-0.3 * pow(d - 1.0, 1.0))')} as scale from p where j - i >= 3 and exp(-0.3 * pow(d - 1.0, 1.0)) * 500 > 60""")
def elastic_network_springs(spark, sf):
    d = X.elastic_network(long_atoms(spark, sf), [], "id", 1.0, 9.0, 0.3, 1.0, 500.0, 60.0)
    return _r(d, ("distance", "scale"))


@query(f"""
with {_A}, p as (select a.mol, a.serial i, b.serial j, {_DIST} d from a join a b on a.mol = b.mol and a.serial < b.serial),
r as (select *, row_number() over (partition by mol order by d desc, i, j) rn from p) select mol, i, j, {rs('d')} as distance from r where rn = 1
""")
def farthest_atom_pairs(spark, sf):
    return _r(X.farthest_pair(atoms(spark, sf), ["mol"], "serial"), ("distance",))


@query("""
with t as (select p_name as name, min(p_partkey) as ordinal from part group by 1)
select o_orderkey, name, ordinal from (select o_orderkey, p_name as name from orders join part on p_partkey = o_custkey) join t using (name)
""")
def atoms_in_reference_order(spark, sf):
    p = table(spark, sf, "part")
    ref = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ordinal"))
    a = table(spark, sf, "orders").join(p, F.col("o_custkey") == F.col("p_partkey")).select("o_orderkey", F.col("p_name").alias("name"), F.lit(0).alias("ordinal"))
    return X.reorder_atoms(a, ref, ["o_orderkey"])


@query(f"""
with {_A}, t(type, position) as (values ('O.2', 1), ('C.3', 2))
select mol, string_agg(serial::varchar, ' ' order by position, serial) as serials from a join t using (type) group by 1
""")
def template_ordered_serials(spark, sf):
    a = atoms(spark, sf).withColumns({"resname": F.lit("A"), "name": F.col("type")})
    t = spark.createDataFrame([("A", "O.2", 1), ("A", "C.3", 2)], "resname string, name string, position int")
    d = X.template_serials(a, t, ["mol"])
    return d.select("mol", F.array_join(F.transform("serials", lambda s: s.cast("string")), " ").alias("serials"))


@query(f"""
with {_A}, b as (select mol, serial, x, y, z from a where type <> 'O.2'), g as (select p.mol, p.serial as residue, min(sqrt(pow(p.x-q.x,2)+pow(p.y-q.y,2)+pow(p.z-q.z,2))) gap from b p join b q on p.mol = q.mol and q.serial = p.serial + 1 group by all)
select mol, residue, {rs('gap')} as gap from g where gap > 25
""")
def backbone_breaks(spark, sf):
    a = atoms(spark, sf).withColumns({"name": F.when(F.col("type") == "C.3", "CA").when(F.col("type") == "N.am", "N").otherwise("O"), "residue": F.col("serial")})
    return _r(X.chain_breaks(a, ["mol"], "residue", 25.0), ("gap",))


_SEQ_NAMES = ["ALA", "GLY", "TRP", "MSE", "LIG"]


@query(f"""with {_A} select mol, 0 as part, string_agg(list_extract(['A', 'G', 'W', 'M', 'X'], (l_partkey % 5 + 1)::int), '' order by serial) as sequence from a group by 1""")
def residue_sequences(spark, sf):
    name = F.get(F.array(*[F.lit(n) for n in _SEQ_NAMES]), (F.col("l_partkey") % 5).cast("int"))
    a = atoms(spark, sf, "l_partkey").withColumns({"name": F.lit("CA"), "resname": name, "segid": F.lit("S"), "chain": F.lit("A"), "resseq": F.col("serial")})
    return X.residue_sequence(a, ["mol"], "serial")


# A chain of bonds along each molecule; the flag N stands for hydrogen here.
_BT = "case l_returnflag when 'A' then 'C.3' when 'N' then 'H' else 'O.2' end"


def _bonded(spark, sf):
    a = atoms(spark, sf, "l_returnflag").withColumns({"num": F.col("serial"), "type": F.when(F.col("l_returnflag") == "N", "H").otherwise(F.col("type"))})
    a = a.withColumn("heavy", R.is_heavy(F.col("type")))
    n = a.groupBy("mol").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    b = n.select("mol", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n") - 1)).alias("num")).select(
        "mol", "num", F.col("num").alias("a1"), (F.col("num") + 1).alias("a2"), F.lit("1").alias("type"))
    return a.select("mol", "num", "type", "heavy"), b


@query(f"""
with {_A}, t as (select mol, serial, {_BT} as type from a), p as (select t.*, coalesce(b.type, c.type) partner from t left join t b on b.mol = t.mol and b.serial = t.serial - 1 left join t c on c.mol = t.mol and c.serial = t.serial + 1)
select mol, serial as num, type, case when type = 'C.3' then 5 when type = 'O.2' then 11 when partner = 'C.3' then 7 else 6 end as dock_type from p
""")
def numeric_atom_types(spark, sf):
    a, b = _bonded(spark, sf)
    return X.dock_types(a, b, ["mol"]).drop("heavy")


@query(f"""
with {_A}, t as (select mol, serial, {_BT} as type from a)
select 'atom' as kind, mol, serial as num from t where type <> 'H' union all
select 'bond', p.mol, p.serial from t p join t q on p.mol = q.mol and q.serial = p.serial + 1 where p.type <> 'H' and q.type <> 'H'
""")
def hydrogens_removed(spark, sf):
    a, b = X.without_hydrogens(*_bonded(spark, sf), ["mol"])
    return a.select(F.lit("atom").alias("kind"), "mol", "num").unionByName(b.select(F.lit("bond").alias("kind"), "mol", "num"))


@query(f"""
with {_A}, n as (select mol, count(*) n from a group by 1 having count(*) > 1)
select mol, k as num, k as a1, k + 1 as a2 from n, unnest(range(2, n - 1)) u(k)
""")
def rotatable_chain_bonds(spark, sf):
    return X.rotatable_bonds(_bonded(spark, sf)[1], ["mol"])


@query("select distinct upper(o_orderstatus) || c_mktsegment as name from orders join customer on c_custkey = o_custkey")
def distinct_segment_names(spark, sf):
    d = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return X.distinct_names(d, F.concat(F.upper("o_orderstatus"), "c_mktsegment"))


@query(None)
def superposed_molecules(spark, sf):
    """Fit of every molecule on the one with the next key."""
    a = atoms(spark, sf)
    fit = X.superpose(X.matched_by_order(a, a.withColumn("mol", F.col("mol") - 1), ["mol"], "serial"), ["mol"])
    return X.moved(a, fit, ["mol"]).select("mol", "serial", *[rounded(c, 5).alias(c) for c in "xyz"])


@query(f"""with {_A}, pt as (select a.mol, a.x::double x, a.y::double y, a.z::double z, b.x::double rx, b.y::double ry, b.z::double rz from a join a b on b.mol = a.mol + 1 and b.serial = a.serial),
{fitted_rmsd("pt", "mol")} select mol, {rs('rmsd', 4)} as rmsd from fit""")
def superposed_rmsd(spark, sf):
    """RMSD of every molecule's best fit on the one with the next key."""
    a = atoms(spark, sf)
    fit = X.superpose(X.matched_by_order(a, a.withColumn("mol", F.col("mol") - 1), ["mol"], "serial"), ["mol"])
    return fit.select("mol", rounded("rmsd", 4).alias("rmsd"))
