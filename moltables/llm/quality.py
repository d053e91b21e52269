"""Quality rules as a short-circuit cascade of native expressions.

Each rule is a boolean column. Its cost (seconds a row) and selectivity (share
of rows it rejects) are measured on a bounded sample, the rules are ordered
by rejection per cost, and the verdict tries them in that order, so a row
that fails early pays for nothing that comes later. The order never changes
a verdict, only what it costs.
"""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltables.llm.common import SPACES, documents, least_hashed, query
from moltables.session import stable

#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 400
WINDOW = 5
MIN_WORDS = 10
MADE = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule"]
MAX_REPEAT_PERCENT = 20
#: Letters and marks of scripts written without spaces between words.
UNSPACED = "[" + "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan")) + "]"


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float  # for a row
    rejects: float  # share of rows

    @property
    def worth(self) -> float:
        return self.rejects / max(self.seconds, 1e-9)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(windows: Column) -> Column:
    """Words in windows that occur twice or more, from the hashes of a row's windows in text order.

    Equal hashes are neighbours after sorting (hash, place); the places of
    such windows, sorted again, cover ``WINDOW`` words each.
    """
    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("to"))
        step = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["to"])).cast("long").alias("n"), (i + WINDOW).alias("to"))
        return F.aggregate(at, zero, step, lambda a: a["n"])

    def places(s: Column) -> Column:
        twin = lambda x, k: F.when((F.try_element_at(s, k + 2)["h"] == x["h"]) | ((k > 0) & (F.try_element_at(s, F.greatest(k, F.lit(1)))["h"] == x["h"])), x["i"])
        return F.sort_array(F.filter(F.transform(s, twin), lambda i: i.isNotNull()))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    heavy = _let(pairs, lambda s: covered(places(s)))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), heavy).otherwise(F.lit(0).cast("long"))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the base counts of whole texts: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Null text has no words. Windows are compared by a 64-bit hash of their
    words, lines as they are, with the white space at their ends. Columns that
    start with ``_q_`` are used on the way and dropped.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("_q_t", F.btrim(t, F.lit(" \t\n\x0b\f\r")))
    d = d.withColumn("_q_w", F.when(F.col("_q_t") == "", F.array().cast("array<string>")).otherwise(F.split("_q_t", f"[{SPACES}]+")))
    n = F.size("_q_w")
    window = lambda i: F.xxhash64(*[F.col("_q_w")[i + k] for k in range(WINDOW)])
    d = d.withColumn("_q_h", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(F.array().cast("array<long>")))
    d = d.withColumn("_q_l", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != ""))
    d = d.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_q_w", "")).cast("long"),
        "n_symbols": F.regexp_count("_q_t", F.lit("[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("_q_l").cast("long"),
        "n_dup_lines": (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_q_h")),
    })
    return d.drop("_q_t", "_q_w", "_q_h", "_q_l")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rules(text_col: str = "text", unspaced: bool = False) -> dict[str, Column]:
    """The further rules, true where a document passes; each is set so that ordinary prose of languages written with spaces passes.

    With ``unspaced``, so does prose that is mainly in scripts written without
    spaces, whose words between spaces are clauses: no longest mean applies,
    and marks (vowel signs) count as letters. The SQL of op10 has no such case.
    """
    n, text = F.col("n_words"), F.coalesce(F.col(text_col), F.lit(""))
    short, letters = F.col("word_chars") <= 20 * n, r"\p{L}"
    if unspaced:
        short, letters = short | (2 * F.regexp_count(text, F.lit(UNSPACED)) > F.col("word_chars")), r"[\p{L}\p{M}]"
    return {
        "mean_word_length": (F.col("word_chars") >= 2 * n) & short,
        "symbols": 5 * F.col("n_symbols") <= n,
        "duplicate_lines": 10 * F.col("n_dup_lines") <= 3 * F.col("n_lines"),
        "letters": 2 * F.regexp_count(text, F.lit(letters)) >= F.col("word_chars"),
    }


def estimate(sample: DataFrame, checks: Mapping[str, Column]) -> list[Estimate]:
    """Measured cost and selectivity of each rule on a written sample, best rejection per cost first."""
    def lap(value: Column) -> tuple[float, float]:
        t0 = time.perf_counter()
        n, out = sample.agg(F.count("*"), F.coalesce(F.sum(F.when(value, 0).otherwise(1)), F.lit(0))).first()
        return time.perf_counter() - t0, out / max(n, 1)
    rows = max(1, sample.count())
    idle = min(lap(F.lit(True))[0] for _ in range(2))
    out = []
    for name, check in checks.items():
        laps = [lap(check) for _ in range(2)]
        out.append(Estimate(name, max(1e-9, min(t for t, _ in laps) - idle) / rows, laps[0][1]))
    return sorted(out, key=lambda e: (-e.worth, e.seconds, e.name))


def cascade(checks: Mapping[str, Column], order: list[str]) -> Column:
    """Name of the first rule in this order that a row fails, null if it passes all; later rules are not evaluated."""
    verdict = F.lit(None).cast("string")
    for name in reversed(order):
        verdict = F.when(~F.coalesce(checks[name], F.lit(False)), F.lit(name)).otherwise(verdict)
    return verdict


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, unspaced: bool = False) -> DataFrame:
    """Every row with all its columns, the counts, base_failed, kept and failed_rule.

    Null, empty and blank texts have no words and fail the base rule. A rule
    that is null counts as failed. Repeated rows get equal verdicts. Columns
    of ``docs`` that are named like a result column are replaced. ``unspaced``
    is that of ``rules``.
    """
    d = docs.drop(*[c for c in MADE if c in docs.columns and c != text_col])
    checks = rules(text_col, unspaced)
    sample = least_hashed(d.select(F.col(id_col).alias("_sample"), F.col(text_col)), "_sample", d.count(), sample_rows).select(text_col)
    sample = stable(with_counts(sample, text_col).select(F.col(text_col), *MADE[:6]))
    order = [e.name for e in estimate(sample, checks)]
    out = with_counts(d, text_col).withColumn("base_failed", base_failed())
    out = out.withColumn("failed_rule", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(checks, order)))
    return out.withColumn("kept", F.col("failed_rule").isNull())


def passing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that pass, with all the columns they came with, also those named like a result. Prose in unspaced scripts passes.

    The optimizer would move the filter below the counts and write their
    expressions out anew in every place that names them. It leaves a filter on
    a column that is not deterministic where it is.
    """
    own = [F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(docs.columns)]
    d = judged(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *own), "_id", "_text", unspaced=True)
    d = d.withColumn("_q_at", F.monotonically_increasing_id()).filter(F.col("kept") & (F.col("_q_at") >= 0))
    return d.select(*[F.col(f"_own{i}").alias(c) for i, c in enumerate(docs.columns)])


_SQL = r"""
with t as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from t),
g as (select doc_id, unnest(range(1, len(w) - 3)) i, w from w where len(w) >= 5),
h as (select doc_id, i, hash(array_to_string(w[i:i + 4], chr(10))) h from g),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, h) k from h) where k > 1),
c as (select doc_id, count(distinct j) n from (select doc_id, unnest(range(i, i + 5)) j from r) group by doc_id),
b as (select w.doc_id, t, len(w)::bigint n_words, len(array_to_string(w, ''))::bigint word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols, len(l)::bigint n_lines, (len(l) - len(list_distinct(l)))::bigint n_dup_lines,
  coalesce(c.n, 0)::bigint n_repeat_words from w left join c using (doc_id)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars between 2 * n_words and 20 * n_words and 5 * n_symbols <= n_words and 10 * n_dup_lines <= 3 * n_lines
  and 2 * len(regexp_extract_all(t, '\p{L}')) >= word_chars kept
from f
"""


@query(_SQL)
def op10_quality_rules(spark, sf_dir):
    """Base counts and the cascade's verdict for every document."""
    d = judged(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
