"""A small table with every awkward case: nulls, empty and blank texts, a very long text, ties, repeated rows, clashing column names."""

import random

import pytest

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["the", "an", "sol", "mi", "ta", "ré", "ber"]) for _ in range(r.randint(1, 3))) for _ in range(n))


def awkward():
    base = prose(1)
    near = base.replace("the", "THE", 1)
    edited = " ".join([*base.split()[:58], "other", "end"])
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"), (4, edited, "en", "b"), (5, prose(2), "de", "c"), (6, prose(3), "de", "c"),
        (7, None, "en", "a"), (8, "", "en", "a"), (9, " \t\n\x0b\f\r ", "fr", "a"), (10, "one two", "fr", None), (11, "ONE two", "fr", None),
        (12, LONG, "en", "a"), (13, "call +1 (526) 555-9022 or mail a.b@c.org now", None, "d"), (13, "call +1 (526) 555-9022 or mail a.b@c.org now", None, "d"),
        (None, prose(4), "en", "d"), (None, None, None, None), (14, "123 456 --- 789", "en", "d"), (15, "日本語 のテキスト 🙂 é́ ß", None, "e"),
        (16, "line\nline\nline\n\nother line", "en", "e"), (17, "a " * 300, "en", "e"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["n", "h", "key", "word", "tokens", "block", "epochs", "copies", "extra", "at", "size", "start", "media", "kept", "label", "Spans"]


@pytest.fixture(scope="session")
def awkward_docs(spark):
    from pyspark.sql import functions as F
    d = spark.createDataFrame(awkward(), SCHEMA)
    return d.withColumns({c: F.lit(f"own {c}") for c in EXTRA})


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
