"""File-format queries: tables rendered to text and read back by the parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from moltables.plans.registry import query, rounded, rs, table
from moltables.plans.structure import _A, atoms
from moltables.sources import mol2 as SM
from moltables.sources import poses as SP
from moltables.sources import structures as ST
from moltables.sources import tables as TB
from moltables.sources.lines import lines_from
from moltables.sources.scores import decoy_rows
from moltables.sources.sinks import pdb_atom_line, ranked_pose_lines, with_chain_ends



def _atom_lines(spark, sf):
    a = atoms(spark, sf)
    line = pdb_atom_line(
        F.when(F.col("type") == "O.2", "HETATM").otherwise("ATOM"), F.col("serial"), F.when(F.col("type") == "C.3", "CA").otherwise("N"),
        F.when(F.col("type") == "O.2", "HOH").otherwise("ALA"), F.when(F.col("q") > 0.04, "B").otherwise("A"), F.col("serial"),
        F.col("x"), F.col("y"), F.col("z"), F.lit(1.0), F.col("q"), F.lit("SEG"), F.substring("type", 1, 1))
    return a.withColumn("value", line)


@query(f"""with {_A} select mol, serial::int as serial, case when type = 'C.3' then 'CA' else 'N' end as name, case when type = 'O.2' then 'HOH' else 'ALA' end as resname,
case when q > 0.04 then 'B' else 'A' end as chain, serial::int as resseq, case when type = 'O.2' then 'W' else ' ' end as hetero, {rs('x', 3)} as x, {rs('z', 3)} as z, {rs('q', 2)} as bfactor, type[1] as element from a""")
def pdb_round_trip(spark, sf):
    d = _atom_lines(spark, sf)
    got, _ = ST.pdb_atoms(lines_from(d, F.col("mol").cast("string"), F.col("serial"), F.col("value")))
    return got.select(F.col("file").cast("bigint").alias("mol"), "serial", "name", "resname", "chain", "resseq", "hetero",
                      rounded("x", 3).alias("x"), rounded("z", 3).alias("z"), rounded("bfactor", 2).alias("bfactor"), "element")


@query(f"""with {_A}, c as (select mol, serial, case when q > 0.04 then 'B' else 'A' end chain from a), n as (select *, lead(chain) over (partition by mol order by serial) nx from c)
select mol, count(*) filter (nx is distinct from chain) as n_ter, count(*) as n_atoms from n group by 1""")
def chain_end_records(spark, sf):
    d = _atom_lines(spark, sf).withColumn("chain", F.when(F.col("q") > 0.04, "B").otherwise("A"))
    t = with_chain_ends(d, ["mol"], "chain", ["serial"])
    return t.groupBy("mol").agg(F.count_if(F.col("part") == 1).alias("n_ter"), F.count_if(F.col("part") == 0).alias("n_atoms"))


@query(f"""with {_A}, m as (select *, min(mol) over (partition by l_suppkey) m0 from a), f as (select l_suppkey, mol, dense_rank() over (partition by l_suppkey order by mol) - 1 model from (select distinct l_suppkey, mol from a))
select f.l_suppkey::varchar as file, f.model::int as model, count(*) as n, {rs('sum(x)', 2)} as x from m join f on f.l_suppkey = m.l_suppkey and f.mol = m.mol group by all""")
def multi_model_files(spark, sf):
    a = atoms(spark, sf, "l_suppkey")
    line = pdb_atom_line(F.lit("ATOM"), F.col("serial"), F.lit("CA"), F.lit("ALA"), F.lit("A"), F.col("serial"), F.col("x"), F.col("y"), F.col("z"),
                         F.lit(1.0), F.lit(0.0), F.lit("S"), F.lit("C"))
    body = a.select("l_suppkey", (F.col("mol") * 1000 + F.col("serial")).alias("at"), line.alias("v"))
    mols = a.select("l_suppkey", "mol").distinct()
    head = mols.select("l_suppkey", (F.col("mol") * 1000).alias("at"), F.lit("MODEL").alias("v"))
    tail = mols.select("l_suppkey", (F.col("mol") * 1000 + 999).alias("at"), F.lit("ENDMDL").alias("v"))
    d = body.unionByName(head).unionByName(tail)
    got, _ = ST.pdb_atoms(lines_from(d, F.col("l_suppkey").cast("string"), F.col("at"), F.col("v")))
    return got.groupBy("file", "model").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("x"), 2).alias("x"))


def mol2_lines(spark, sf):
    a = atoms(spark, sf)
    row = F.format_string("%-6d %-4s %9.4f %9.4f %9.4f %-5s %4s %6s %9.4f", "serial", F.lit("X"), "x", "y", "z", "type", F.lit("1"), F.lit("LIG"), "q")
    # One record per molecule: its rows, as many as the molecule has atoms.
    rec = a.groupBy("mol").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("serial", row.alias("t")))), lambda s: s["t"]), "\n").alias("t"))
    text = F.concat(F.lit("\n"), F.col("mol").cast("string"), F.lit("\n1 1 1 0 0\nSMALL\nUSER_CHARGES\n@<TRIPOS>ATOM\n"), F.col("t"), F.lit("\n@<TRIPOS>BOND\n1 1 2 1\n"))
    body = rec.select(F.col("mol").alias("at"), text.alias("v"))
    first = spark.range(1).select(F.lit(-1).cast("bigint").alias("at"), F.lit("########## Name: first").alias("v"))
    return lines_from(body.unionByName(first), F.lit("all"), F.col("at"), F.col("v"), hot=True)


@query(f"""with {_A} select mol, serial::int as num, type, {rs('x', 4)} as x, {rs('q', 4)} as q, type not like 'H%' as heavy from a""")
def mol2_round_trip(spark, sf):
    mols, got, _ = SM.mol2_tables(mol2_lines(spark, sf))
    d = got.join(mols.select("mol_id", F.col("name").cast("bigint").alias("mol")), "mol_id")
    return d.select("mol", "num", "type", rounded("x", 4).alias("x"), rounded("q", 4).alias("q"), "heavy")


@query(f"""with {_A} select (mol // 100)::varchar as file, mol, count(*) as n, {rs('avg(x)', 4)} as x, {rs('min(z)', 3)} as z from a group by all""")
def pose_file_round_trip(spark, sf):
    a = atoms(spark, sf)
    line = F.concat(F.lit("ATOM  "), F.format_string("%5d  C   LIG A   1    %8.3f%8.3f%8.3f", "serial", "x", "y", "z"))
    file = F.floor(F.col("mol") / 100).cast("string")
    body = a.select(file.alias("f"), (F.col("mol") * 1000 + F.col("serial")).alias("at"), line.alias("v"))
    mols = a.select(file.alias("f"), "mol").distinct()
    head = mols.select("f", F.explode(F.array(
        F.struct((F.col("mol") * 1000 - 2).alias("at"), F.concat(F.lit("REMARK VINA RESULT:   -"), F.col("mol").cast("string"), F.lit(".5")).alias("v")),
        F.struct((F.col("mol") * 1000 - 1).alias("at"), F.concat(F.lit("REMARK  Name = L"), F.col("mol").cast("string")).alias("v")),
    )).alias("r")).select("f", "r.at", "r.v")
    poses, got = SP.pdbqt_poses(lines_from(body.unionByName(head), F.col("f"), F.col("at"), F.col("v")))
    named = got.join(poses.select("file", "pose", "name", "score"), ["file", "pose"])
    num = lambda i, n: F.substring("value", i, n).try_cast("double")
    return named.filter(F.col("score") == -(F.substring("name", 2, 20).cast("double") + 0.5)).groupBy("file", F.substring("name", 2, 20).cast("bigint").alias("mol")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg(num(31, 8)), 4).alias("x"), rounded(F.min(num(47, 8)), 3).alias("z"))


@query("select row_number() over (order by score, f, o_orderkey) as rank, o_orderkey, 3 as lines_before_end, 1 as ends from (select -o_totalprice score, o_orderstatus f, o_orderkey from orders)")
def ranked_pose_text(spark, sf):
    o = table(spark, sf, "orders")
    p = o.select(F.col("o_orderstatus").alias("file"), F.col("o_orderkey").alias("pose"), (-F.col("o_totalprice")).alias("score"), F.col("o_orderkey").cast("string").alias("name"))
    body = p.select("file", "pose", F.lit(0).alias("block"), F.lit(1).alias("seq"), F.lit("ATOM").alias("value"))
    t = ranked_pose_lines(p, body)
    v = F.col("value")
    return t.groupBy("rank").agg(
        F.max(F.when(v.startswith("REMARK  Name"), F.regexp_extract(v, r"= (\d+)", 1))).cast("bigint").alias("o_orderkey"),
        F.count_if(v.startswith("MODEL") | v.startswith("REMARK VINA") | (v == "ATOM")).cast("int").alias("lines_before_end"),
        F.count_if(v == "ENDMDL").cast("int").alias("ends"))


@query("""select case when o_orderstatus = 'F' then 'ligand' else 'decoy' end as kind, 'N' || o_orderkey as name, o_custkey::double as mw, case when o_orderstatus <> 'F' then 'NA' end as prot_id from orders""")
def decoy_property_lines(spark, sf):
    o = table(spark, sf, "orders")
    base = F.concat(F.lit("CC N"), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" 1.5 2 3 4 -1"))
    text = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("LIGAND: "), base)).otherwise(F.concat(F.lit("DECOY x "), base, F.lit(" NA")))
    d = decoy_rows(lines_from(o, F.col("o_orderstatus"), F.col("o_orderkey"), text))
    return d.select("kind", "name", "mw", "prot_id")


@query(f"""select user_id::varchar as file, event_id as seq, {rs('value', 2)} as z, (event_id % 10)::double as count from events where event_type <> 'error'""")
def axis_profile_lines(spark, sf):
    e = table(spark, sf, "events")
    text = F.when(F.col("event_type") == "error", "# comment").otherwise(
        F.concat(F.lit("  "), F.format_string("%.2f", "value"), F.lit("   "), (F.col("event_id") % 10).cast("string"), F.lit("  0.5 # sd")))
    d = TB.axis_profile(lines_from(e, F.col("user_id").cast("string"), F.col("event_id"), text))
    return d.select("file", "seq", rounded("z", 2).alias("z"), "count")


@query("""with e as (select user_id, event_id, row_number() over (partition by user_id order by event_id) i from events)
select user_id::varchar as file, event_id as seq, i between 3 and 22 as in_atoms from e""")
def psf_sections(spark, sf):
    from moltables.operators.ordered import ordered
    e = ordered(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], ["event_id"]).row_number("i").result()
    text = F.when(F.col("i") == 2, "      20 !NATOM").otherwise("  1 SYSTEM")
    d = ST.psf_atom_section(lines_from(e, F.col("user_id").cast("string"), F.col("event_id"), text))
    return d.select("file", "seq", "in_atoms")


@query("select distinct c_name || '.pdbqt' as pdbqt from customer where c_acctbal > 0")
def manifest_paths(spark, sf):
    m = table(spark, sf, "customer").select(
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit('"'), F.col("c_name"), F.lit('.pdbqt"\r'))).otherwise(F.lit(' "" ')).alias("pdbqt"))
    return TB.manifest_column(m)


@query("select case event_type when 'click' then 'C' when 'view' then 'OA' else 'HD' end as name from events group by 1")
def atom_types_over_files(spark, sf):
    from moltables.operators.structure import atom_types_of
    t = F.when(F.col("event_type") == "click", "C").when(F.col("event_type") == "view", "OA").otherwise("HD")
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 7 == 0, F.lit("REMARK ZZ")).otherwise(F.concat(F.lit("ATOM   1  X  LIG  1.0 "), t)).alias("value"))
    return atom_types_of(e)
