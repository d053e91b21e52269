"""Multi-molecule MOL2 files read as one record per molecule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltables.functions.residues import is_heavy
from moltables.sources.lines import in_order, number, read_lines, word, words

RECORD = "@<TRIPOS>MOLECULE"


def read_mol2(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return mol2_tables(read_lines(spark, path, sep=RECORD))


def mol2_tables(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mols, atoms, bonds), keyed (file, mol_id) with mol_id counting from 1.

    The comment header of a molecule ends the record before it, so it is taken
    from there.
    """
    header = F.array_join(F.filter(F.split("value", r"\r?\n"), lambda s: s.startswith("#")), "\n")
    o = in_order(records.withColumn("_head", header)).scan(lags={"header": F.col("_head")}, sums={"mol_id": F.lit(1)})
    d = o.df.withColumn("mol_id", F.col("mol_id") - 1).filter(F.col("mol_id") > 0)
    name = word(F.get(F.filter(F.split("value", r"\r?\n"), lambda s: (F.trim(s) != "") & ~s.startswith("#")), F.lit(0)), 0)
    mols = d.select("file", "mol_id", name.alias("name"), "header")
    sections = d.select("file", "mol_id", F.explode(F.split("value", "@<TRIPOS>")).alias("_sec"))
    rows = sections.select(
        "file", "mol_id", F.substring_index("_sec", "\n", 1).alias("_kind"),
        F.posexplode(F.split("_sec", r"\r?\n")).alias("ordinal", "value"),
    ).filter((F.col("ordinal") > 0) & ~F.col("value").startswith("#"))
    kind = F.trim("_kind")
    n = F.size(words(F.col("value")))
    at = lambda i: word(F.col("value"), i)
    atoms = rows.filter((kind == "ATOM") & (n >= 9)).select(
        "file", "mol_id", "ordinal", at(0).try_cast("int").alias("num"), at(1).alias("name"),
        number(at(2)).alias("x"), number(at(3)).alias("y"), number(at(4)).alias("z"), at(5).alias("type"),
        at(6).try_cast("int").alias("resnum"), at(7).alias("resname"), number(at(8)).alias("q"),
    ).withColumn("heavy", is_heavy(F.col("type")))
    bonds = rows.filter((kind == "BOND") & (n == 4)).select(
        "file", "mol_id", "ordinal", at(0).try_cast("int").alias("num"), at(1).try_cast("int").alias("a1"),
        at(2).try_cast("int").alias("a2"), at(3).alias("type"),
    )
    return mols, atoms, bonds


def mol2_coordinates(records: DataFrame) -> DataFrame:
    _, atoms, _ = mol2_tables(records)
    return atoms.select("file", "mol_id", "ordinal", "name", "x", "y", "z")
