"""Encoded compound ids: base 62, tranche names, shard keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 62 id symbols in value order.
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

# The 61 logP bins in order.
LOGP_LABELS = """
    M500 M400 M300 M200 M100 M000 P000 P010 P020 P030 P040 P050 P060 P070 P080 P090 P100 P110 P120 P130 P140 P150 P160
    P170 P180 P190 P200 P210 P220 P230 P240 P250 P260 P270 P280 P290 P300 P310 P320 P330 P340 P350 P360 P370 P380 P390
    P400 P410 P420 P430 P440 P450 P460 P470 P480 P490 P500 P600 P700 P800 P900
""".split()


def strip_and_pad(s: Column, width: int) -> Column:
    """Strip Z, I, N, C from both ends, then left pad with zeros, never cutting."""
    core = F.regexp_replace(s, "^[ZINC]+|[ZINC]+$", "")
    return F.when(F.length(core) < width, F.lpad(core, width, "0")).otherwise(core)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def base62_value(s: Column, width: int = 8) -> Column:
    """Value of up to ``width`` base-62 symbols; null for any other symbol. A sum over positions counted from the end."""
    def value(t: Column) -> Column:
        total = None
        for i in range(width):
            at = F.call_function("instr", F.lit(SYMBOLS), F.substring(t, -1 - i, 1)).cast("bigint")
            term = F.when(F.length(t) > i, (at - 1) * F.lit(62**i)).otherwise(F.lit(0).cast("bigint"))
            total = term if total is None else total + term
        return F.when(t.rlike(f"^[0-9a-zA-Z]{{1,{width}}}$"), total)
    return _bound(s, value)


def base62_text(n: Column, width: int = 8) -> Column:
    """Base-62 text of a non-negative number, zero padded to ``width``."""
    parts = []
    for i in range(width - 1, -1, -1):
        digit = _div(n, 62**i) % 62
        parts.append(F.substring(F.lit(SYMBOLS), (digit + 1).cast("int"), F.lit(1)))
    return F.when(n >= 0, F.concat(*parts))


def _div(n: Column, by: int) -> Column:
    # n - n mod by is a multiple of by, so the double quotient is exact below 2^53.
    return ((n - n % F.lit(by).cast("bigint")) / F.lit(by).cast("bigint")).cast("bigint")


def tranche_of(compound_id: Column) -> Column:
    """``H<heavy atoms><logP bin>`` from characters 5 and 6; null when out of range."""
    labels = F.array(*[F.lit(x) for x in LOGP_LABELS])

    def name(two: Column) -> Column:
        heavy, logp = base62_value(F.substring(two, 1, 1), 1), base62_value(F.substring(two, 2, 1), 1)
        return F.concat(F.format_string("H%02d", heavy), F.get(labels, logp.cast("int")))
    return _bound(F.substring(compound_id, 5, 2), name)


def number_of(compound_id: Column) -> Column:
    return base62_value(F.substring(compound_id, 9, 8))


def compound_id(number: Column, tranche: Column, prefix: str = "ZINC") -> Column:
    """Id text from (number, tranche); an unknown tranche is written ``??``."""
    labels = F.array(*[F.lit(x) for x in LOGP_LABELS])
    heavy = F.substring(tranche, 2, 2).try_cast("int")
    logp = F.array_position(labels, F.substring(tranche, 4, 4)).cast("int")
    known = (heavy.between(0, 61)) & (logp > 0)
    two = F.concat(
        F.substring(F.lit(SYMBOLS), heavy + 1, F.lit(1)), F.substring(F.lit(SYMBOLS), logp, F.lit(1)),
    )
    return F.concat(F.lit(prefix), F.when(known, two).otherwise("??"), F.lit("00"), base62_text(number))


def hash_shard(code: Column) -> Column:
    """Two hex characters, third and fourth from the end of the SHA-256 of the code."""
    return F.substring(F.sha2(code, 256), 61, 2)
