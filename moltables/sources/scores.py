"""Docking score lines, run logs and decoy property files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltables.sources.lines import in_order, number, word, words

# Word positions of a score line.
SCORE_FIELDS = {
    "dir": 0, "molnum": 1, "compound": 2, "receptor": 3, "heavy_atoms": 7, "c8": 8, "c9": 9, "rank": 10,
    "e12": 12, "e13": 13, "e14": 14, "e15": 15, "e16": 16, "e17": 17, "e18": 18, "e19": 19, "e20": 20,
    "total": 21, "out_index": 22,
}
TEXT_FIELDS = ("dir", "compound", "receptor", "c8", "c9")
IDENTICAL_FIELDS = ("c8", "c9", "e12", "e13", "e14", "e15", "e16", "e17", "e18", "e19", "e20", "total")

# Failure classes of a run log in test order, and its counters.
FAILURES = (
    ("bump", "bump"), ("no_match", "no_match"), ("no_viable", "No viable poses."), ("clash", "clash"), ("skip", "skip"),
)
COUNTERS = (
    ("min_steps", "minimization", 4), ("hierarchies", "hierarchies", 4), ("orients", "orients", 5),
    ("conformations", "conformations", 5), ("nodes", "nodes", 5), ("complexes", "complexes", 4),
    ("secs", "elapsed time", 3), ("hours", "elapsed time", 5),
)


def score_lines(lines: DataFrame, score_dir: bool = True) -> DataFrame:
    """Typed columns of score lines; ``score_dir`` False when the first column is not there yet."""
    shift = 0 if score_dir else -1
    cols = []
    for name, i in SCORE_FIELDS.items():
        at = i + shift
        w = F.lit(None).cast("string") if at < 0 else F.get("_w", F.lit(at))
        if name not in TEXT_FIELDS:
            w = w.try_cast("int" if name in ("molnum", "heavy_atoms", "rank", "out_index") else "double")
        cols.append(w.alias(name))
    d = lines.withColumn("_w", words(F.col("value"))).filter(F.size("_w") >= 22 + shift)
    return d.select("file", "block", "seq", *cols, F.col("value").alias("line"))


def select_scores(scores: DataFrame, ids: DataFrame | None = None, receptors: Sequence[str] | None = None,
                  part: str | None = None) -> DataFrame:
    """Filters of the score reader; ``ids`` (column compound) is a semi join."""
    if receptors is not None:
        scores = scores.filter(F.col("receptor").isin(list(receptors)))
    if part is not None:
        scores = scores.filter(F.array_contains(F.split("receptor", r"\."), part))
    return scores if ids is None else scores.join(ids.select("compound").distinct(), "compound", "left_semi")


def failure_class(line: Column) -> Column:
    out = None
    for name, text in FAILURES:
        out = F.when(line.contains(text), name) if out is None else out.when(line.contains(text), name)
    return out.otherwise("misc")


def run_log_events(lines: DataFrame) -> DataFrame:
    """Log lines as events: (file, kind, compound, counter, value).

    kind is ``scored``, a failure class, or ``counter``. The result section is
    between a ``mol#`` line and ``we reached …`` / ``close SDIFILE``, the
    counters follow ``close SDIFILE``.
    """
    v = F.col("value")
    w0 = word(v, 0)
    closing = (w0 == "close") & (word(v, 1) == "SDIFILE")
    mark = F.when(w0 == "mol#", 1).when(w0 == "we", 0).when(closing, 2)
    o = in_order(lines.filter(F.trim("value") != "").withColumn("_mark", mark))
    # The marker takes effect after its own line, except that "we" closes before it.
    d = o.scan(lasts={"_state": F.col("_mark")}, sums={"_closed": F.when(closing, 1).otherwise(0)}).df
    d = d.withColumn("_n", F.size(words(v))).filter(F.col("_mark").isNull())
    reading = F.col("_state") == 1
    stats = (F.coalesce(F.col("_state"), F.lit(0)) != 1) & (F.col("_closed") > 0)
    result = d.filter(reading & ((F.col("_n") == 21) | ((F.col("_n") > 2) & word(v, 1).contains("ZINC")))).select(
        "file", F.when(F.col("_n") == 21, "scored").otherwise(failure_class(v)).alias("kind"),
        word(v, 1).alias("compound"), F.lit(None).cast("string").alias("counter"), F.lit(None).cast("double").alias("value"),
    )
    pairs = F.array(*[
        F.when(v.contains(text), F.struct(F.lit(name).alias("c"), number(word(v, i)).alias("x")))
        for name, text, i in COUNTERS
    ])
    counters = d.filter(stats).select("file", F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("p")).select(
        "file", F.lit("counter").alias("kind"), F.lit(None).cast("string").alias("compound"),
        F.col("p.c").alias("counter"), F.col("p.x").alias("value"),
    )
    return result.unionByName(counters)


def decoy_rows(lines: DataFrame) -> DataFrame:
    """LIGAND: / DECOY rows with six properties; decoys carry a protomer id at the end."""
    w = lines.withColumn("_w", words(F.col("value")))
    first = F.get("_w", F.lit(0))
    at = lambda i: F.when(first == "DECOY", F.get("_w", F.lit(i + 1))).otherwise(F.get("_w", F.lit(i)))
    props = ("mw", "logp", "rotb", "hbd", "hba", "charge")
    return w.filter(first.isin("LIGAND:", "DECOY")).select(
        "file", "block", "seq", F.when(first == "DECOY", "decoy").otherwise("ligand").alias("kind"),
        at(1).alias("smiles"), at(2).alias("name"),
        *[number(at(3 + i)).alias(p) for i, p in enumerate(props)],
        F.when(first == "DECOY", F.element_at("_w", -1)).alias("prot_id"),
    )
