"""Pose files, archives, sequence documents and streamed scores, written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from moltables.plans.registry import big, query, rounded, rs, table
from moltables.session import shared_folder
from moltables.sources import archives as AR
from moltables.sources import documents as DC
from moltables.sources import poses as PO
from moltables.sources.lines import lines_from
from moltables.streaming import scores as ST

# One pose for each order, in a file for each customer; its score and coordinates come from the price.
_N = "n as (select *, row_number() over (partition by o_custkey order by o_orderkey) pose, round(o_totalprice / 1000, 3)::double x from orders)"


def _numbers(o):
    return {"key": F.col("o_orderkey").cast("string"), "x": F.round(F.col("o_totalprice") / 1000, 3).cast("double")}


def _records(spark, sf):
    """Records that end before ENDMDL: name, result and two atoms, in the order of the keys."""
    o = table(spark, sf, "orders")
    n = _numbers(o)
    atom = lambda i, x: F.format_string("ATOM  %5d  C%d  LIG %4d %9.3f %9.3f %9.3f", F.lit(i), F.lit(i), F.lit(1), x, x + 1.5, F.lit(-2.25))
    text = F.concat_ws("\n", F.lit("MODEL 1"), F.concat(F.lit("REMARK  Name = Z"), n["key"]), F.format_string("REMARK VINA RESULT:   %.1f      0.000      0.000", -n["x"] / 10),
                       atom(1, n["x"]), atom(2, n["x"] * 2), F.lit("TER"), F.lit(""))
    return lines_from(o, F.col("o_custkey").cast("string"), F.col("o_orderkey"), text)


@query(f"with {_N} select o_custkey::varchar as file, pose, 'Z' || o_orderkey as name, {rs('-x / 10', 1)} as score, 2 as n_atoms, {rs('x + round(x * 2, 3)', 3)} as x from n")
def pose_records_parsed(spark, sf):
    d = PO.pose_records(_records(spark, sf))
    x = F.aggregate("atoms", F.lit(0.0), lambda a, s: a + s["x"])
    return d.select("file", big("pose").alias("pose"), "name", rounded("score", 1).alias("score"), F.size("atoms").alias("n_atoms"), rounded(x, 3).alias("x"))


def _annotated(spark, sf):
    """Poses with SMILES; those of pending orders lack a distance."""
    o = table(spark, sf, "orders")
    n = _numbers(o)
    text = F.concat_ws("\n", F.lit("MODEL"), F.concat(F.lit("REMARK Name = Z"), n["key"]), F.concat(F.lit("REMARK SMILES = C"), F.repeat(F.lit("C"), (F.col("o_orderkey") % 5).cast("int")), F.lit("O")),
                       F.format_string("REMARK Vina score: -%.3f", n["x"]),
                       F.when(F.col("o_orderstatus") != "P", F.format_string("REMARK Distance from crystal ligand centroid: %.3f A", n["x"] * 2)),
                       F.lit("ATOM      1  C1"), F.lit("HETATM    2  O1"), F.lit("TER"))
    return lines_from(o, F.col("o_custkey").cast("string"), F.col("o_orderkey"), text)


_SMILES = "'C' || repeat('C', (o_orderkey % 5)::int) || 'O'"


@query(f"with {_N} select o_custkey::varchar as file, pose, 'Z' || o_orderkey as name, {_SMILES} as smiles, {rs('-x', 3)} as score, {rs('x * 2', 3)} as distance, 2 as n_atoms from n where o_orderstatus <> 'P'")
def annotated_poses_parsed(spark, sf):
    d = PO.annotated_poses(_annotated(spark, sf))
    return d.select("file", big("pose").alias("pose"), "name", "smiles", rounded("score", 3).alias("score"), rounded("distance", 3).alias("distance"), F.size("atom_lines").alias("n_atoms"))


@query(f"with {_N} select o_custkey::varchar as file, pose, {_SMILES} as smiles, {rs('-x', 3)} as score from n where o_orderstatus <> 'P'")
def smiles_and_scores_parsed(spark, sf):
    d = PO.smiles_and_scores(_annotated(spark, sf))
    return d.select("file", big("pose").alias("pose"), "smiles", rounded("score", 3).alias("score"))


def _archives(spark, sf, compression):
    """Pose texts of the orders in files by customer."""
    o = table(spark, sf, "orders").repartition(8, "o_custkey").sortWithinPartitions("o_orderkey")
    text = F.concat(F.lit("##########  Name:   Z"), F.col("o_orderkey").cast("string"), F.lit("\n##########  Total Energy:  "), F.format_string("%.2f", -F.col("o_totalprice").cast("double")),
                    F.lit("\n@<TRIPOS>MOLECULE\nZ"), F.col("o_orderkey").cast("string"))
    path = shared_folder(spark, "archives")
    o.select(text.alias("value")).write.option("compression", compression).text(path)
    return path


@query(f"select 'Z' || o_orderkey as name, {rs('-o_totalprice::double', 2)} as energy, 4 as n_lines from orders")
def pose_archives_read(spark, sf):
    d = AR.read_pose_archives(spark, _archives(spark, sf, "gzip"))
    return d.select("name", rounded("energy", 2).alias("energy"), F.size(F.split(F.rtrim("text", F.lit("\n")), "\n")).alias("n_lines"))


@query("""with f as (select distinct 1 from orders)
select 'gzip' as folder, true as ok, null as error from f union all select 'none', false, 'BadGzipFile' from f""")
def archive_states_read(spark, sf):
    parts = [AR.archive_states(spark, _archives(spark, sf, c)).select(F.lit(c).alias("folder"), "ok", "error") for c in ("gzip", "none")]
    return parts[0].unionByName(parts[1]).distinct()


@query("""select 'b' || doc_id // 50 as name, count(*) as n, sum(length(text))::bigint as n_chars, min(doc_id)::varchar as first_id from documents where length(text) > 0 group by 1""")
def sequence_document_files(spark, sf):
    """Documents of 50 texts each, a file for each, read back from the folder tree."""
    d = table(spark, sf, "documents").withColumn("name", F.concat(F.lit("b"), F.floor(F.col("doc_id") / 50).cast("string")))
    one = F.struct(F.struct(F.array(F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("sequence")).alias("protein"))
    files = d.groupBy("name").agg(F.collect_list(one).alias("sequences")).select("*", F.array(F.lit(1)).alias("modelSeeds"), F.lit("alphafold3").alias("dialect"), F.lit(1).alias("version"), F.col("name").alias("folder"))
    path = shared_folder(spark, "sequences")
    files.write.partitionBy("folder").json(path)
    good, _ = DC.read_sequence_documents(spark, path)
    p = DC.proteins(good)
    return p.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sequence")).cast("bigint").alias("n_chars"), F.min(F.col("ids")[0].cast("bigint")).cast("string").alias("first_id"))


@query(f"select user_id, count(*) as n, {rs('sum(value)', 4)} as total from events group by 1")
def streamed_scores(spark, sf):
    """The events arrive in two parts; the third run finds no new file."""
    e = table(spark, sf, "events")
    arriving, out = shared_folder(spark, "arriving"), shared_folder(spark, "scores")
    for k in range(3):
        if k < 2:
            e.filter(F.col("event_id") % 2 == k).write.mode("append").parquet(arriving)
        stream = ST.score_stream(spark, arriving, e.schema)
        ST.extract_new(stream, out, f"{out}-progress").awaitTermination()
    return spark.read.parquet(out).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 4).alias("total"))
