"""What the operators of this folder share: the table, words, slices of batches, registration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SLICE_BYTES = 4 << 20
SPACES = " \\t\\n\\x0B\\f\\r"


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL it must equal if there is one."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Words between ASCII white space; no words for null or blank text."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+")
    return F.filter(parts, lambda w: w != "")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def with_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns for the Python side: id, and the text as UTF-8 bytes (null stays null)."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of about ``most`` bytes, so that memory is bounded by the longest text."""
    for b in batches:
        lengths = pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(lengths):
            n = 0 if n != n else int(n)
            if held and held + n > most:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < b.num_rows:
            yield b.slice(start)


def least_hashed(rows: DataFrame, id_col: str, total: int, most: int) -> DataFrame:
    """At most ``most`` of ``total`` rows, those of the least hashed ids.

    Rows far beyond the wanted share are left out before the sort, so that no
    task keeps ``most`` rows of its own once there are many tasks.
    """
    part = 1 << 30
    below = min(part, int(part * (2 * most + 50) / max(total, 1)))
    h = F.pmod(F.xxhash64(id_col), F.lit(part))
    return rows.filter(h < below).orderBy(h, F.xxhash64(*rows.columns)).limit(most)
