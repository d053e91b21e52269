"""Text lines with an order, and the scans over them.

Spark gives text rows no position. A line is placed by (file, block, seq):
the start of its file split and its place inside the split. Splits are bounded,
so they serve as the blocks of every carry-forward scan, however large a file is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moltables.operators.ordered import Ordered, ordered, ordered_by_block

PLACE = ("file", "block", "seq")
#: Set in the metadata of ``block`` where every file is a single block; kept by filters and added columns.
WHOLE = "whole_file"


def read_lines(spark: SparkSession, path: str | Sequence[str], sep: str | None = None, **options: str) -> DataFrame:
    """(file, block, seq, value); ``sep`` reads multi-line records, one per row."""
    r = spark.read.options(**options)
    if sep:
        r = r.option("lineSep", sep)
    return r.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )


def lines_from(df: DataFrame, file: Column, order: Column, value: Column, hot: bool = False) -> DataFrame:
    """Lines rendered from a table; with ``hot`` (one or few huge files) they are cut into range blocks.

    A line is rendered once: it is the only element of an exploded list, as
    filters on parsed columns would else take the rendering into each of their terms.
    """
    d = df.select(file.alias("file"), order.alias("seq"), F.explode(F.array(value)).alias("value"))
    o = ordered(d, ["file"], ["seq"], hot)
    block = F.col(o.block) if o.block else F.lit(0)
    return o.df.select("file", block.cast("bigint").alias("block", metadata={} if o.block else {WHOLE: True}), "seq", "value")


def in_order(lines: DataFrame) -> Ordered:
    """Scans over the lines of a file. Files of one block need no carry between blocks, which reads the lines a second time."""
    if lines.schema["block"].metadata.get(WHOLE):
        return ordered(lines, ["file"], ["seq"])
    return ordered_by_block(lines, ["file"], "block", ["seq"])


def words(value: Column) -> Column:
    return F.split(F.trim(value), r"\s+")


def word(value: Column, i: int) -> Column:
    return F.get(words(value), F.lit(i))


def number(value: Column) -> Column:
    return F.trim(value).try_cast("double")


def place() -> Column:
    return F.struct("file", "block", "seq")
