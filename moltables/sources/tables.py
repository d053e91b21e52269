"""Delimited lists and tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moltables.functions.smiles import nanomolar_to_molar
from moltables.sources.lines import number, place, word, words

# Headers of an assay export.
ASSAY_HEADERS = {"target": "Target ChEMBL ID", "smiles": "Smiles", "potency": "Standard Value"}


def read_assays(spark: SparkSession, path: str, headers: Mapping[str, str] = ASSAY_HEADERS) -> DataFrame:
    raw = spark.read.option("sep", ";").option("header", True).option("inferSchema", False).csv(path)
    return typed_assays(raw.select(*[F.col(f"`{h}`").alias(n) for n, h in headers.items() if h in raw.columns]))


def typed_assays(raw: DataFrame, smiles: str = "smiles", potency: str = "potency") -> DataFrame:
    """Rows with both values; text potencies stay as rows with a null number."""
    p = F.col(potency).try_cast("double")
    return (
        raw.dropna(subset=[smiles, potency])
        .withColumn(potency, F.when(~F.isnan(p), p))
        .withColumn("potency_m", nanomolar_to_molar(F.col(potency)))
    )


def id_smiles_pairs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, rejects) of ``id,smiles`` lines; exactly two fields are accepted."""
    f = lines.withColumn("_f", F.split("value", ","))
    ok = F.size("_f") == 2
    good = f.filter(ok).select(
        "file", "block", "seq", F.trim(F.col("_f")[0]).alias("id"), F.trim(F.col("_f")[1]).alias("smiles"),
    )
    return good, f.filter(~ok).drop("_f")


def id_list(lines: DataFrame) -> DataFrame:
    return lines.select("file", "block", "seq", F.trim("value").alias("id")).filter(F.col("id") != "")


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the smallest order value each."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def ids_or_score_lines(lines: DataFrame, receptors: Sequence[str] | None = None, part: str | None = None) -> DataFrame:
    """Ids from plain lists or score lines (more than 10 words), first-seen unique."""
    w = words(F.col("value"))
    scored = F.size(w) > 10
    d = lines.withColumn("_w", w).withColumn("place", place()).filter(F.trim("value") != "")
    keep = F.lit(True)
    receptor = F.get("_w", F.lit(3))
    if receptors is not None:
        keep = keep & (~scored | receptor.isin(list(receptors)))
    if part is not None:
        keep = keep & (~scored | F.array_contains(F.split(receptor, r"\."), part))
    d = d.filter(keep).withColumn("id", F.when(scored, F.get("_w", F.lit(2))).otherwise(F.get("_w", F.lit(0))))
    return first_seen(d, "id", "place")


def smiles_by_name(lines: DataFrame) -> DataFrame:
    """``smiles name`` lines as name -> smiles, the last line of a name wins."""
    d = lines.filter(F.size(words(F.col("value"))) >= 2)
    return d.groupBy(word(F.col("value"), 1).alias("name")).agg(
        F.max_by(word(F.col("value"), 0), place()).alias("smiles"))


def union_sources(sources: Mapping[str, DataFrame], label: str = "source") -> DataFrame:
    out = None
    for name, df in sources.items():
        d = df.withColumn(label, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def read_table(spark: SparkSession, location: str, table: str | None = None, partition_column: str | None = None,
               bounds: tuple[int, int] | None = None, parts: int = 64, fetch_size: int = 5000) -> DataFrame:
    """A parquet table, or a JDBC table read in parallel ranges of ``partition_column``."""
    if not location.startswith("jdbc:"):
        return spark.read.parquet(location)
    r = spark.read.format("jdbc").option("url", location).option("dbtable", table).option("fetchsize", fetch_size)
    if partition_column and bounds:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", bounds[0])
             .option("upperBound", bounds[1]).option("numPartitions", parts))
    return r.load()


def read_required_csv(spark: SparkSession, path: str, schema: str, required: Sequence[str]) -> DataFrame:
    """CSV with a header; missing required columns raise, rows with nulls in them are dropped."""
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    types = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema)}
    return raw.select(*[F.col(c).try_cast(types.get(c, "string")).alias(c) for c in raw.columns]).dropna(subset=list(required))


def axis_profile(lines: DataFrame, columns: Sequence[str] = ("z", "count", "sd")) -> DataFrame:
    """Whitespace columns of numbers, ``#`` starts a comment."""
    d = lines.withColumn("value", F.substring_index("value", "#", 1)).filter(F.trim("value") != "")
    return d.select("file", "block", "seq", *[number(word(F.col("value"), i)).alias(c) for i, c in enumerate(columns)])


def manifest_column(manifest: DataFrame, column: str = "pdbqt") -> DataFrame:
    """Non-empty values of a manifest column without quotes and carriage returns."""
    v = F.trim(F.translate(F.col(column), "\"\r'", ""))
    return manifest.select(v.alias(column)).filter(F.length(v) > 0)
