"""Tables that streams write batch by batch, so that a batch that runs again replaces itself.

A batch's rows have a folder of their own, which a second run overwrites. A
log says which folders count: a batch is noted after its rows are complete,
so what a lost run left behind is never read. Compaction writes all counted
rows to one base folder and notes that; the batches below it stop counting.
The log also keeps where a stream's run began until it is over, so a run that
is resumed goes on from the same beginning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "seq long, kind string, source string, batch long, folder string, covers array<struct<source: string, batch: long>>"


class BatchTable:
    """A table below ``path``: rows/… for batches and bases, log/ for what counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> list:
        """Entries in order; equal entries of a repeated note are harmless."""
        try:
            rows = self.spark.read.schema(_LOG).parquet(f"{self.path}/log").collect()
        except Exception as e:  # nothing was noted yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        return sorted(rows, key=lambda r: r["seq"])

    def note(self, kind: str, source: str, batch: int, folder: str = "", covers: list | None = None) -> None:
        seq = max((r["seq"] for r in self.log()), default=0) + 1
        self.spark.createDataFrame([(seq, kind, source, batch, folder, covers or [])], _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _counted(self) -> tuple[str | None, dict]:
        """(base folder, {(source, batch): folder} of the batches that are not in it)."""
        base, covered, batches = None, set(), {}
        for r in self.log():
            if r["kind"] == "base":
                base = r["folder"]
                covered |= {(c["source"], c["batch"]) for c in r["covers"]}
            elif r["kind"] == "batch":
                batches[r["source"], r["batch"]] = r["folder"]
        return base, {k: f for k, f in batches.items() if k not in covered}

    def write(self, rows: DataFrame, source: str, batch: int) -> None:
        """The rows of a batch, in place of those of an earlier run of it; a batch that is compacted already stays."""
        if any((c["source"], c["batch"]) == (source, batch) for r in self.log() for c in r["covers"]):
            return
        folder = f"{self.path}/rows/{source}-{batch}"
        rows.write.mode("overwrite").parquet(folder)
        self.note("batch", source, batch, folder)

    def read(self, before: tuple[str, int] | None = None) -> DataFrame | None:
        """All rows that count, or those without the batches of a source from some number on; None if there are none."""
        base, batches = self._counted()
        folders = [f for (s, b), f in sorted(batches.items()) if before is None or s != before[0] or b < before[1]]
        folders = ([base] if base else []) + folders
        return self.spark.read.parquet(*folders) if folders else None

    def compact(self, merge: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
        """Write ``merge`` of all rows to a new base. Not while a stream that needs its beginning is running."""
        base, batches = self._counted()
        if not batches:
            return
        seq = max(r["seq"] for r in self.log()) + 1
        folder = f"{self.path}/rows/base-{seq}"
        merge(self.read()).write.mode("overwrite").parquet(folder)
        self.note("base", "", 0, folder, [{"source": s, "batch": b} for s, b in batches])

    def begin(self, source: str) -> int:
        """Number of the first batch of the run of a stream: a new one, or that of a run that never ended."""
        start, last = None, -1
        for r in self.log():
            if r["source"] == source and r["kind"] == "begin":
                start = r["batch"]
            elif r["source"] == source and r["kind"] == "end":
                start = None
            elif r["source"] == source and r["kind"] == "batch":
                last = max(last, r["batch"])
        if start is None:
            start = last + 1
            self.note("begin", source, start)
        return start

    def end(self, source: str) -> None:
        self.note("end", source, 0)


def source_name(checkpoint: str) -> str:
    """Name of a stream by its checkpoint, whose batch numbers it shares."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
