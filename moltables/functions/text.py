"""Names, paths and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moltables.functions.smiles import url_unquote


def safe_name(s: Column, limit: int = 200) -> Column:
    return F.substring(F.regexp_replace(s, "[^A-Za-z0-9_.-]+", "_"), 1, limit)


def complete_path(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def between_markers(html: Column, before: str, after: str) -> Column:
    """Text between two literal markers in the first line that holds the first one, percent-decoded."""
    line = F.get(F.filter(F.split(html, "\r?\n"), lambda x: x.contains(before)), F.lit(0))
    return F.when(html.contains(before), url_unquote(F.substring_index(F.substring_index(line, before, -1), after, 1)))


def all_matches(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def number_or_text(token: Column) -> Column:
    """Typed token: ``as_int``, else ``as_double``, else ``as_text`` (the others null)."""
    t = F.trim(token)
    is_int = t.rlike(r"^[+-]?[0-9]+$")
    i = F.when(is_int, t.try_cast("bigint"))
    d = F.when(i.isNull(), t.try_cast("double"))
    return F.struct(i.alias("as_int"), d.alias("as_double"), F.when(i.isNull() & d.isNull(), token).alias("as_text"))
