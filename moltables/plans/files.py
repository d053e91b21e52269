"""Reader and writer queries: tables rendered to a format, or written as files, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from moltables.operators.ordered import ordered
from moltables.plans.registry import big, query, rounded, rs, table
from moltables.plans.structure import _A, atoms
from moltables.plans.texts import _atom_lines, mol2_lines
from moltables.session import shared_folder
from moltables.sources import mol2 as SM
from moltables.sources import sinks as SK
from moltables.sources import structures as ST
from moltables.sources import tables as TB
from moltables.sources.lines import lines_from


@query("select 'Z' || o_orderkey as id from orders where o_orderstatus <> 'O'")
def id_list_lines(spark, sf):
    text = F.when(F.col("o_orderstatus") == "O", F.lit("   ")).otherwise(F.concat(F.lit("  Z"), F.col("o_orderkey").cast("string"), F.lit(" ")))
    return TB.id_list(lines_from(table(spark, sf, "orders"), F.lit("list"), F.col("o_orderkey"), text, hot=True)).select("id")


@query(f"with {_A} select mol, serial::int as serial, 'ANISOU' as record, {rs('serial * 10 / 10000.0')} as u_first, {rs('(serial * 10 + 5) / 10000.0')} as u_last from a")
def side_records_parsed(spark, sf):
    d = _atom_lines(spark, sf)
    u = F.concat(F.rpad(F.lit("ANISOU"), 28, " "), *[F.format_string("%7d", F.col("serial").cast("int") * 10 + i) for i in range(6)])
    both = d.select("mol", F.explode(F.array(F.struct((F.col("serial") * 2).alias("at"), F.col("value").alias("v")),
                                             F.struct((F.col("serial") * 2 + 1).alias("at"), u.alias("v")))).alias("r")).select("mol", "r.*")
    got = ST.pdb_side_records(lines_from(both, F.col("mol").cast("string"), F.col("at"), F.col("v")))
    return got.select(F.col("file").cast("bigint").alias("mol"), "serial", "record", rounded(F.col("values")[0]).alias("u_first"), rounded(F.col("values")[5]).alias("u_last"))


@query(f"""with {_A}, f as (select l_suppkey, mol, dense_rank() over (partition by l_suppkey order by mol) - 1 frame from (select distinct l_suppkey, mol from a))
select f.l_suppkey::varchar as file, f.frame::bigint as frame, count(*) as n, {rs('sum(x)', 2)} as x from a join f on f.l_suppkey = a.l_suppkey and f.mol = a.mol group by all""")
def frames_of_records(spark, sf):
    a = atoms(spark, sf, "l_suppkey")
    line = SK.pdb_atom_line(F.lit("ATOM"), F.col("serial"), F.lit("CA"), F.lit("ALA"), F.lit("A"), F.col("serial"), F.col("x"), F.col("y"), F.col("z"),
                            F.lit(1.0), F.lit(0.0), F.lit("S"), F.lit("C"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("serial", line.alias("t")))), lambda s: s["t"])
    rec = a.groupBy("l_suppkey", "mol").agg(F.array_join(rows, "\n").alias("t"))  # a molecule's rows
    got = ST.trajectory_frames(lines_from(rec, F.col("l_suppkey").cast("string"), F.col("mol"), F.col("t")))
    return got.groupBy("file", big("frame").alias("frame")).agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("x"), 2).alias("x"))


@query(f"with {_A} select mol, 'system ' || mol as title, count(*) as n, {rs('sum(x)', 2)} as x, 50.0::double as box from a group by 1")
def gro_text_parsed(spark, sf):
    a = atoms(spark, sf)
    row = F.format_string("%5d%-5s%5s%5d%8.3f%8.3f%8.3f", F.col("serial").cast("int"), F.lit("LIG"), F.lit("C1"), F.col("serial").cast("int"), F.col("x") / 10, F.col("y") / 10, F.col("z") / 10)
    body = a.select("mol", F.col("serial").alias("at"), row.alias("v"))
    rest = a.groupBy("mol").agg(F.max("serial").alias("m"), F.count(F.lit(1)).alias("n")).select("mol", F.explode(F.array(
        F.struct(F.lit(-2).cast("bigint").alias("at"), F.concat(F.lit("system "), F.col("mol").cast("string")).alias("v")),
        F.struct(F.lit(-1).cast("bigint").alias("at"), F.col("n").cast("string").alias("v")),
        F.struct((F.col("m") + 1).cast("bigint").alias("at"), F.lit("   5.00000   5.00000   5.00000").alias("v")))).alias("r")).select("mol", "r.*")
    got, frames = ST.gro_frames(lines_from(body.unionByName(rest), F.col("mol").cast("string"), F.col("at"), F.col("v")))
    n = got.groupBy("file", "frame").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("x"), 2).alias("x"))
    return frames.join(n, ["file", "frame"]).select(F.col("file").cast("bigint").alias("mol"), "title", "n", "x", rounded(F.col("box")[0]).alias("box"))


@query(f"with {_A} select mol, count(*) as n_atoms, 1::bigint as n_rest, 10.5::double as a, 90.0::double as gamma from a group by 1")
def structure_parts(spark, sf):
    d = _atom_lines(spark, sf).select("mol", F.col("serial").alias("at"), F.col("value").alias("v"))
    head = d.select("mol").distinct().select("mol", F.explode(F.array(
        F.struct(F.lit(-2).cast("bigint").alias("at"), F.lit("REMARK  made").alias("v")),
        F.struct(F.lit(-1).cast("bigint").alias("at"), F.format_string("CRYST1%9.3f%9.3f%9.3f%7.2f%7.2f%7.2f", F.lit(10.5), F.lit(11.0), F.lit(12.0), F.lit(90.0), F.lit(90.0), F.lit(90.0)).alias("v")))).alias("r")).select("mol", "r.*")
    got, rest, box = ST.split_structure(lines_from(d.unionByName(head), F.col("mol").cast("string"), F.col("at"), F.col("v")))
    n = got.groupBy("file").agg(F.count(F.lit(1)).alias("n_atoms")).join(rest.groupBy("file").agg(F.count(F.lit(1)).alias("n_rest")), "file")
    return n.join(box, "file").select(F.col("file").cast("bigint").alias("mol"), "n_atoms", "n_rest", F.col("box")[0].alias("a"), F.col("box")[5].alias("gamma"))


@query(f"with {_A} select mol, count(*) filter (type = 'O.2') as n_ligand, count(*) filter (type <> 'O.2') as n_protein from a group by 1")
def ligand_and_protein_lines(spark, sf):
    d = _atom_lines(spark, sf)
    lig, rest = ST.split_ligand(lines_from(d, F.col("mol").cast("string"), F.col("serial"), F.col("value")), "HOH")
    both = lig.select("file", F.lit(1).alias("l")).unionByName(rest.select("file", F.lit(0).alias("l")))
    return both.groupBy(F.col("file").cast("bigint").alias("mol")).agg(F.sum("l").alias("n_ligand"), F.count_if(F.col("l") == 0).alias("n_protein"))


@query(f"with {_A} select 'X' as name, {rs('x', 4)} as x, count(*) as n from a group by all")
def mol2_coordinate_rows(spark, sf):
    got = SM.mol2_coordinates(mol2_lines(spark, sf))
    return got.groupBy("name", rounded("x", 4).alias("x")).agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey, c_name, c_acctbal::double as c_acctbal from customer where c_mktsegment <> 'BUILDING'")
def required_columns_round_trip(spark, sf):
    c = table(spark, sf, "customer")
    path = shared_folder(spark, "csv")
    SK.write_delimited(c.select("c_custkey", "c_name", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("c_acctbal")), path)
    d = TB.read_required_csv(spark, path, "c_custkey bigint, c_name string, c_acctbal decimal(12,2)", ["c_acctbal"])
    return d.withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


@query("select l_returnflag, l_linestatus, count(*) as n, sum(l_orderkey)::bigint as keys from lineitem group by all")
def files_by_key(spark, sf):
    path = shared_folder(spark, "by-key")
    SK.write_by_key(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey"), path, ["l_returnflag", "l_linestatus"], max_rows=1000)
    return spark.read.parquet(path).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").cast("bigint").alias("keys"))


@query("""with f as (select lpad(doc_id::varchar, 12, '0') path, text from documents), n as (select *, row_number() over (order by path) i from f)
select ((i + 99) // 100)::bigint as package, count(*) as n, sum(length(text))::bigint as n_chars from n group by 1""")
def packed_files(spark, sf):
    path = shared_folder(spark, "packed")
    SK.compact_files(table(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("text").alias("content")), path)
    return spark.read.parquet(path).groupBy("package").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("n_chars"))


@query("""with e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) i from events)
select user_id::varchar as file, row_number() over (partition by user_id order by event_id) as ordinal, 'C' || event_id as name, 'CT' as type from e where i > 2 and event_type <> 'error'""")
def template_atoms(spark, sf):
    e = ordered(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"]).row_number("i").result()
    line = F.concat(F.lit("  1  C"), F.col("event_id").cast("string"), F.lit("  CT  M"))
    text = (F.when(F.col("i") == 1, "CORRECT OMIT DU BEG").when(F.col("i") == 2, "0.0")
            .when(F.col("event_type") == "error", "  1  DUMM  DU  M").otherwise(line))
    got = ST.prepi_atoms(lines_from(e, F.col("user_id").cast("string"), F.col("event_id"), text))
    return got.select("file", big("ordinal").alias("ordinal"), "name", "type")
