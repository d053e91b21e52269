"""Growing result folders as streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from moltables.operators.assays import only_new
from moltables.operators.compounds import new_registry_rows
from moltables.streaming.tables import BatchTable, source_name


def score_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder, each exactly once per checkpoint."""
    r = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


def running_best(stream: DataFrame, compound: Column, score: str, keep: Sequence[str]) -> DataFrame:
    """Best row per compound so far (update mode). A minimum does not depend on
    arrival order, so no watermark is needed; the state holds one row per compound.
    """
    return stream.groupBy(compound.alias("compound")).agg(F.min(F.struct(F.col(score), *keep)).alias("best"))


def _run(stream: DataFrame, mode: str, checkpoint: str, write) -> StreamingQuery:
    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def best_score_updates(stream: DataFrame, compound: Column, score: str, keep: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Write every improved best row to a batch table; ``current_best`` reads it, ``compact_best`` shortens it to a row per compound."""
    table, source = BatchTable(stream.sparkSession, path), source_name(checkpoint)
    return _run(running_best(stream, compound, score, keep), "update", checkpoint, lambda batch, n: table.write(batch, source, n))


def _best(rows: DataFrame) -> DataFrame:
    return rows.groupBy("compound").agg(F.min("best").alias("best"))


def current_best(spark: SparkSession, path: str) -> DataFrame:
    return _best(BatchTable(spark, path).read()).select("compound", "best.*")


def compact_best(spark: SparkSession, path: str) -> None:
    """Keep one row per compound of all batches so far."""
    BatchTable(spark, path).compact(_best)


def extract_new(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append every new score file once to a parquet table."""
    return (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def append_new_targets(stream: DataFrame, key: str, path: str, checkpoint: str) -> None:
    """Append only rows whose key the table did not have when this run began, and wait for the end of the run.

    The rows of a new target may come in several batches; all are written.
    What the table held at the beginning is kept in its log, also for a run
    that fails and is started again: its own batches never count as known.
    """
    table, source = BatchTable(stream.sparkSession, path), source_name(checkpoint)
    start = table.begin(source)
    known = table.read(before=(source, start))

    def write(batch: DataFrame, n: int) -> None:
        table.write(batch if known is None else only_new(batch, known, key), source, n)
    _run(stream, "append", checkpoint, write).awaitTermination()
    table.end(source)


def grow_registry(stream: DataFrame, path: str, key: str, order: str, required: str, checkpoint: str) -> StreamingQuery:
    """Insert-or-ignore each micro-batch: the first row of each key that no earlier batch has. ``read_table`` reads it."""
    table, source = BatchTable(stream.sparkSession, path), source_name(checkpoint)

    def write(batch: DataFrame, n: int) -> None:
        table.write(new_registry_rows(batch, table.read(before=(source, n)), key, order, required), source, n)
    return _run(stream, "append", checkpoint, write)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a table that a stream of this module writes."""
    return BatchTable(spark, path).read()
