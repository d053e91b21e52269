"""Column functions on SMILES text and potencies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bracket atoms, those of them that are hydrogen, and the symbols written without brackets.
BRACKET = r"\[[^\]]+\]"
BRACKET_HYDROGEN = r"\[[0-9]*H[+-]?[0-9]*\]"
PLAIN_ATOM = "Cl|Br|[BCNOPSFIbcnops]"


def simplify_smiles(s: Column) -> Column:
    """Upper case without stereo, charge, bracket, hydrogen and triple-bond marks."""
    return F.translate(F.upper(s), "@-+H[]#", "")


def heavy_atom_count(s: Column) -> Column:
    """Bracket atoms other than hydrogen plus plain symbols outside brackets."""
    bare = F.regexp_replace(s, BRACKET, "")
    return (F.regexp_count(s, F.lit(BRACKET)) - F.regexp_count(s, F.lit(BRACKET_HYDROGEN))
            + F.regexp_count(bare, F.lit(PLAIN_ATOM)))


def nanomolar_to_molar(x: Column) -> Column:
    return x * F.lit(1e-9)


def neg_log10(x: Column) -> Column:
    """-log10, null for values that have no logarithm."""
    return F.when(x > 0, -F.log10(x))


def url_quote(s: Column) -> Column:
    """Percent-encode; a blank becomes %20 and * is escaped, / stays as it is."""
    q = F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
    q = F.replace(q, F.lit("*"), F.lit("%2A"))
    q = F.replace(q, F.lit("%7E"), F.lit("~"))
    return F.replace(q, F.lit("%2F"), F.lit("/"))


def url_unquote(s: Column) -> Column:
    """Percent-decode; a plus sign stays a plus sign."""
    return F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))
