"""Nested sequence documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEQUENCE_SCHEMA = (
    "name string, sequences array<struct<protein:struct<id:array<string>,sequence:string>>>, "
    "modelSeeds array<int>, dialect string, version int"
)


def read_sequence_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, bad files) below a folder, whole directory tree, one document per file."""
    raw = (spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
           .text(path).select(F.col("_metadata.file_path").alias("file"), "value"))
    schema = SEQUENCE_SCHEMA + ", _bad string"
    d = raw.withColumn("_d", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_d").isNull() | F.col("_d._bad").isNotNull()
    return d.filter(~bad).select("file", "_d.*").drop("_bad"), d.filter(bad).select("file", F.col("value").alias("text"))


def parse_sequence_document(text: Column) -> Column:
    return F.from_json(text, SEQUENCE_SCHEMA)


def proteins(documents: DataFrame, keep: tuple[str, ...] = ("file", "name")) -> DataFrame:
    """One row per protein entry that has both ids and a sequence."""
    d = documents.select(*keep, F.posexplode("sequences").alias("entry", "_s"))
    return d.select(*keep, "entry", F.col("_s.protein.id").alias("ids"), F.col("_s.protein.sequence").alias("sequence")).filter(
        (F.size("ids") > 0) & (F.length("sequence") > 0))
