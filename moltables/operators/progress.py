"""Work lists: what is finished, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of a folder tree without reading contents."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
            .load(path).select("path", "length", F.col("modificationTime").alias("modified")))


def without_result(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys of the work list that have no result yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def completeness(directories: DataFrame, lines: DataFrame, directory: str, ended: Column, failed: Column) -> DataFrame:
    """Per directory: whether an end marker was seen, and the number of error lines."""
    seen = lines.groupBy(directory).agg(F.bool_or(ended).alias("finished"), F.count_if(failed).alias("errors"))
    return directories.select(directory).distinct().join(seen, directory, "left").select(
        directory, F.coalesce("finished", F.lit(False)).alias("finished"), F.coalesce("errors", F.lit(0)).alias("errors"))


def split_finished(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    return state.filter("finished"), state.filter(~F.col("finished"))


def job_list(directories: DataFrame, logs: DataFrame, poses: DataFrame, restarts: DataFrame, directory: str) -> DataFrame:
    """Directories that need (more) work and why: no log, no poses, or a restart marker."""
    flag = lambda d, n: d.select(directory).distinct().withColumn(n, F.lit(True))
    d = directories.select(directory).distinct()
    for table, name in ((logs, "_log"), (poses, "_pose"), (restarts, "_restart")):
        d = d.join(flag(table, name), directory, "left")
    why = F.when(F.col("_log").isNull(), "no log").when(F.col("_restart"), "restart").when(F.col("_pose").isNull(), "no poses")
    return d.withColumn("reason", why).filter(F.col("reason").isNotNull()).select(directory, "reason")


def all_outputs_present(expected: DataFrame, files: DataFrame, directory: str, name: str) -> DataFrame:
    """(directory, complete): every expected file name is there."""
    have = files.select(directory, name).distinct().withColumn("_have", F.lit(True))
    d = expected.select(directory, name).join(have, [directory, name], "left")
    return d.groupBy(directory).agg(F.bool_and(F.coalesce("_have", F.lit(False))).alias("complete"))
