"""All combinations of residues at a few positions of a template."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltables.functions.sequence import AMINO_ACIDS, edit_residues


def linker_variants(templates: DataFrame, sequence: str, positions: Sequence[int], alphabet: str = AMINO_ACIDS) -> DataFrame:
    """Every row times len(alphabet) ** len(positions) variants: adds linker and the edited sequence.

    Variant numbers are generated per row and read as digits in base
    len(alphabet), so nothing is joined and each row's variants are produced
    where the row is.
    """
    k, n = len(alphabet), len(positions)
    v = F.col("_v")
    letters = [F.substring(F.lit(alphabet), (F.floor(v / k ** (n - 1 - i)) % k + 1).cast("int"), F.lit(1)) for i in range(n)]
    d = templates.select("*", F.explode(F.sequence(F.lit(0), F.lit(k**n - 1))).alias("_v"))
    d = d.withColumn("linker", F.concat(*letters))
    edits = [F.substring("linker", i + 1, 1) for i in range(n)]
    return d.withColumn(sequence, edit_residues(F.col(sequence), positions, edits)).withColumnRenamed(sequence, "sequence").drop("_v")
