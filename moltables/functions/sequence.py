"""Column functions on residue sequences."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Residue codes.
ONE_LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E",
    "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F",
    "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "MSE": "M",
    "SEC": "U", "PYL": "O",
}
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
LINKER_POSITIONS = (70, 71, 313, 314)

# Secondary structure letters per program, all mapped onto COARSE.
COARSE = "FHHHEETSCC"
STRUCTURE_LETTERS = {"dssp": ".HGIBETSC~", "pymol": ".H...S...L", "gmx": ".H...ETS.C", "self": "FHHHEETSCC"}


def lookup(col: Column, table: Mapping[str, object]) -> Column:
    """Literal map lookup, null when absent. For small fixed tables only."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col)


def one_letter(resname: Column) -> Column:
    return F.coalesce(lookup(F.upper(resname), ONE_LETTER), F.lit("X"))


def residues_at(seq: Column, positions: Sequence[int]) -> Column:
    """Residues at 1-based positions, X where the sequence is too short."""
    return F.array(*[
        F.when((F.lit(p) >= 1) & (F.lit(p) <= F.length(seq)), F.substring(seq, p, 1)).otherwise("X")
        for p in positions
    ])


def edit_residues(seq: Column, positions: Sequence[int], residues: Sequence[Column]) -> Column:
    """Put residues at 1-based positions; positions outside the sequence change nothing."""
    out = seq
    for p, aa in zip(positions, residues, strict=True):
        ok = (F.lit(p) >= 1) & (F.lit(p) <= F.length(seq))
        out = F.when(ok, F.overlay(out, aa, F.lit(max(p, 1)), F.lit(1))).otherwise(out)
    return out


def linker(seq: Column, positions: Sequence[int] = LINKER_POSITIONS) -> Column:
    """Residues at the linker positions as one string (short sequences give fewer letters)."""
    return F.concat(*[F.substring(seq, p, 1) for p in positions])


def window_around(seq: Column, center: int | Column, half: int, index_base: int = 1) -> Column:
    """``2*half+1`` letters around the centre, padded with X."""
    c = (F.lit(center) if isinstance(center, int) else center) + (1 - index_base)
    pad = F.lit("X" * half)
    return F.substring(F.concat(pad, seq, pad), c.cast("int"), F.lit(2 * half + 1))


def find_exact(seq: Column, motif: str) -> Column:
    """0-based starts of all hits, overlapping ones too; one pass over each text in an Arrow batch. Null for null."""
    look = re.compile("(?=" + re.escape(motif.upper()) + ")")

    @F.pandas_udf("array<int>")
    def starts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [m.start() for m in look.finditer(t)])
    return starts(seq)


def find_regex(seq: Column, pattern: str) -> Column:
    """Spans (0-based start, end) of all non-overlapping hits of a regular expression; one pass over each text in an Arrow batch.

    Null for null. Patterns that match the empty string are refused.
    """
    wanted = re.compile(pattern)
    if wanted.match(""):
        raise ValueError("the pattern matches the empty string")

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": m.start(), "end": m.end()} for m in wanted.finditer(t)])
    return spans(seq)


def coarse_structure(ss: Column, program: str = "dssp") -> Column:
    """Secondary structure letters mapped to the coarse alphabet, unknown ones to coil."""
    table: dict[str, str] = {}
    for a, b in zip(STRUCTURE_LETTERS[program], COARSE, strict=True):
        table[a] = b
    letters = re.sub(r"([\]\\^-])", r"\\\1", "".join(table))
    # Letters the program does not use become coil; marked first so they cannot be mapped twice.
    marked = F.regexp_replace(ss, f"[^{letters}]", "\u0001")
    return F.translate(marked, "".join(table) + "\u0001", "".join(table.values()) + "C")


# Helix runs and their types, applied in this order; a dot stands for any other letter or an end.
HELIX_RUNS = (
    (".H.", ".3."),
    (".HH.", ".33."),
    (".HHH.", ".333."),
    (".HHHH.", ".3333."),
    (".HHHHH.", ".13332."),
    (".HHHHHH.", ".113322."),
    (".HHHHHHH.", ".1113222."),
    (".HHHH", ".1111"),
    ("HHHH.", "2222."),
)


def helix_types(coarse: Column) -> Column:
    """Mark helix starts (1), ends (2) and short helices (3) by the length of each H run."""
    out = coarse
    for run, types in HELIX_RUNS:
        before = "(?<![H123])" if run.startswith(".") else ""
        after = "(?!H)" if run.endswith(".") else ""
        out = F.regexp_replace(out, f"{before}{run.strip('.')}{after}", types.strip("."))
    return out
