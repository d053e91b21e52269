"""Writers and line renderers. Order is kept by a range sort, never by one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltables.operators.ordered import ordered
from moltables.sources.scores import SCORE_FIELDS


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("sep", sep).option("header", header).csv(path)


def write_lines(df: DataFrame, path: str, order: Sequence[str], value: str = "value") -> None:
    """Text part files whose concatenation is in order."""
    df.orderBy(*order).select(value).write.mode("overwrite").text(path)


def write_by_key(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet", max_rows: int = 1_000_000) -> None:
    """One folder per key; a huge key becomes several files."""
    df.write.mode("overwrite").option("maxRecordsPerFile", max_rows).partitionBy(*keys).format(fmt).save(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def batches(df: DataFrame, order: Sequence[str], size: int, out: str = "batch") -> DataFrame:
    """Batch numbers 1, 2, … of ``size`` rows each in the given total order."""
    o = ordered(df, [], order).row_number("_rn")
    return o.result().withColumn(out, F.ceil(F.col("_rn") / F.lit(size)).cast("bigint")).drop("_rn")


def compact_files(files: DataFrame, path: str, per_package: int = 100) -> None:
    """Pack many small files (path, content) into parquet packages of ``per_package`` files."""
    d = batches(files, ["path"], per_package, "package")
    d.repartition("package").write.mode("overwrite").option("maxRecordsPerFile", per_package).parquet(path)


def score_text(*skip: str) -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in SCORE_FIELDS if c not in skip])


def pdb_atom_line(record: Column, serial: Column, name: Column, resname: Column, chain: Column, resseq: Column,
                  x: Column, y: Column, z: Column, occupancy: Column, bfactor: Column, segid: Column, element: Column) -> Column:
    """Fixed-width atom record."""
    padded = F.when(F.length(name) < 4, F.concat(F.lit(" "), F.rpad(name, 3, " "))).otherwise(F.substring(name, 1, 4))
    return F.concat(
        F.rpad(record, 6, " "), F.lpad(serial.cast("string"), 5, " "), F.lit(" "), padded, F.lit(" "),
        F.lpad(resname, 3, " "), F.lit(" "), F.rpad(chain, 1, " "), F.lpad(resseq.cast("string"), 4, " "), F.lit("    "),
        F.format_string("%8.3f%8.3f%8.3f%6.2f%6.2f", x, y, z, occupancy, bfactor), F.lit("      "),
        F.rpad(segid, 4, " "), F.lpad(element, 2, " "),
    )


def with_chain_ends(atoms: DataFrame, keys: Sequence[str], chain: str, order: Sequence[str], line: str = "value") -> DataFrame:
    """Atom lines plus a TER line after the last atom of every chain run: adds ``part`` (0 atom, 1 TER)."""
    o = ordered(atoms, keys, order).scan(leads={"_next": F.col(chain)})
    d = o.result()
    last = F.col("_next").isNull() | (F.col("_next") != F.col(chain))
    rows = F.when(last, F.array(F.struct(F.lit(0).alias("part"), F.col(line).alias("v")),
                                F.struct(F.lit(1).alias("part"), F.lit("TER").alias("v")))
                  ).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.col(line).alias("v"))))
    return d.select(*keys, *order, F.explode(rows).alias("_r")).select(*keys, *order, "_r.part", F.col("_r.v").alias(line))


def ranked_pose_lines(poses: DataFrame, atoms: DataFrame) -> DataFrame:
    """Multi-model text of poses by rising score: (rank, part, block, seq, value).

    poses: (file, pose, score, name); atoms: (file, pose, block, seq, value).
    MODEL numbers are the global rank; every model ends with one ENDMDL.
    """
    r = ordered(poses, [], ["score", "file", "pose"]).row_number("rank").result()
    head = r.select("rank", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit("MODEL "), F.col("rank").cast("string")).alias("v")),
        F.struct(F.lit(1).alias("part"), F.concat(F.lit("REMARK  Name = "), F.col("name")).alias("v")),
        F.struct(F.lit(2).alias("part"), F.concat(F.lit("REMARK VINA RESULT: "), F.col("score").cast("string")).alias("v")),
        F.struct(F.lit(4).alias("part"), F.lit("ENDMDL").alias("v")),
    )).alias("_r")).filter("_r.v is not null")
    zero = F.lit(0).cast("bigint")
    head = head.select("rank", "_r.part", zero.alias("block"), zero.alias("seq"), F.col("_r.v").alias("value"))
    body = atoms.join(r.select("file", "pose", "rank"), ["file", "pose"]).select(
        "rank", F.lit(3).alias("part"), F.col("block").cast("bigint"), F.col("seq").cast("bigint"), "value")
    return head.unionByName(body)


def variant_documents(df: DataFrame, name: Column, ids: Column, sequence: Column, dialect: str = "alphafold3") -> DataFrame:
    """A ``document`` column: one sequence document (JSON) per row."""
    protein = F.struct(ids.alias("id"), sequence.alias("sequence"))
    doc = F.struct(
        name.alias("name"), F.array(F.struct(protein.alias("protein"))).alias("sequences"),
        F.array(F.lit(1)).alias("modelSeeds"), F.lit(dialect).alias("dialect"), F.lit(1).alias("version"),
    )
    return df.withColumn("document", F.to_json(doc))


def variant_yaml(ids: Column, sequence: Column) -> Column:
    """The same entry as a YAML text."""
    return F.concat(F.lit("version: 1\nsequences:\n  - protein:\n      id: ["), F.array_join(ids, ", "),
                    F.lit("]\n      sequence: "), sequence, F.lit("\n"))
