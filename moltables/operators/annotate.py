"""Hook for columns that need a user's own library (scaffolds, fingerprints, descriptors)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def annotate(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Append the columns ``fn`` computes from Arrow batches; it must keep row order and count."""
    base = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def run(batches):
        for pdf in batches:
            new = fn(pdf)
            if len(new) != len(pdf):
                raise ValueError("the annotator changed the number of rows")
            yield pd.concat([pdf.reset_index(drop=True), new.reset_index(drop=True)], axis=1)

    return df.mapInPandas(run, f"{base}, {schema}")
