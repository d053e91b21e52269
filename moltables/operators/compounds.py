"""Compound lists: duplicates, cross-list matches, id lookups, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltables.functions.compound_ids import number_of, tranche_of
from moltables.operators.ordered import ordered

MISSING = "_null_"
LIST_CHUNK = 1000


def duplicate_report(df: DataFrame, key: str, ident: str, order: str, chunk: int = LIST_CHUNK) -> DataFrame:
    """Per key: first id, number of further ids, and those ids in lists.

    The usual group gives one row. Lists hold at most ``chunk`` ids; a larger
    group continues on further rows (``part`` 0, 1, …), so no row grows without
    bound.
    """
    rows = df.select(F.col(key).alias("key"), F.col(ident).alias("id"), F.col(order).alias("at"))
    heads = rows.groupBy("key").agg(
        F.min_by("id", "at").alias("first_id"), (F.count(F.lit(1)) - 1).alias("n_duplicates"))
    o = ordered(rows, ["key"], ["at"]).row_number("_rn").result()
    lists = (
        o.filter("_rn > 1")
        .groupBy("key", F.floor((F.col("_rn") - 2) / chunk).cast("int").alias("part"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "id"))), lambda s: s["id"]).alias("duplicates"))
    )
    out = heads.join(lists.withColumnRenamed("key", "_k"), F.col("key").eqNullSafe(F.col("_k")), "left").drop("_k")
    return out.withColumn("part", F.coalesce("part", F.lit(0)))


def cross_matches(a: DataFrame, b: DataFrame, key: str, ident: str) -> DataFrame:
    """Every row of both lists with the number of rows in the other list that share its key.

    Matching ids are the rows of ``match_lists`` with the same key; they are not
    repeated per row, which would be quadratic for a common key.
    """
    def side(d: DataFrame, other: DataFrame, origin: str) -> DataFrame:
        found = other.groupBy(key).agg(F.count(F.lit(1)).alias("n_matches"), F.min(ident).alias("first_match"))
        return d.select(key, ident).join(found, key, "left").select(
            F.lit(origin).alias("file_origin"), ident, key,
            F.coalesce("n_matches", F.lit(0)).cast("bigint").alias("n_matches"), "first_match")
    return side(a, b, "a").unionByName(side(b, a, "b"))


def match_lists(a: DataFrame, b: DataFrame, key: str, ident: str, chunk: int = LIST_CHUNK) -> DataFrame:
    """Ids per (file_origin, key) for keys present in both lists, in chunks."""
    shared = a.select(key).distinct().join(b.select(key).distinct(), key)
    both = a.select(F.lit("a").alias("file_origin"), key, ident).unionByName(
        b.select(F.lit("b").alias("file_origin"), key, ident)).join(shared, key, "left_semi")
    o = ordered(both, ["file_origin", key], [ident]).row_number("_rn").result()
    return o.groupBy("file_origin", key, F.floor((F.col("_rn") - 1) / chunk).cast("int").alias("part")).agg(
        F.sort_array(F.collect_list(ident)).alias("ids"))


def route(df: DataFrame, tranche: Column, shard_map: DataFrame, fallback: str = "fake") -> DataFrame:
    """Attach the shard of a tranche; shard_map: (tranche, shard), one row per tranche.

    The map has at most 62 x 61 rows by construction of the tranche name, so
    broadcasting it is bounded.
    """
    m = shard_map.select(F.col("tranche").alias("_t"), F.col("shard"))
    return df.join(F.broadcast(m), tranche == F.col("_t"), "left").drop("_t").withColumn(
        "shard", F.coalesce("shard", F.lit(fallback)))


def lookup_ids(ids: DataFrame, substances: DataFrame, keep: tuple[str, ...] = ("smiles",), ident: str = "id") -> DataFrame:
    """Every input id once per match, missing fields ``_null_``.

    substances: (tranche, sub_id, …). The tranche is derived on the id side and
    joined on, so a table partitioned by tranche is pruned at run time.
    """
    keyed = ids.select(F.col(ident), tranche_of(F.col(ident)).alias("tranche"), number_of(F.col(ident)).alias("sub_id"))
    hits = keyed.join(substances.select("tranche", "sub_id", *keep), ["tranche", "sub_id"], "left")
    return hits.select(ident, F.coalesce("tranche", F.lit(MISSING)).alias("tranche"),
                       *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in keep])


def split_codes(codes: DataFrame, supplier_codes: DataFrame, supplier_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of supplier codes resolved to content ids in two left joins."""
    d = (codes.select("supplier_code").join(supplier_codes, "supplier_code", "left")
         .join(supplier_map, F.col("sup_id") == F.col("sup_id_fk"), "left"))
    miss = F.col("cat_content_id").isNull()
    return d.filter(~miss).select("supplier_code", "cat_content_id", "machine_id_fk"), d.filter(miss).select("supplier_code")


def with_dimensions(
    results: DataFrame, tranches: DataFrame, catalog: DataFrame,
    map_3d: DataFrame | None = None, tarballs: DataFrame | None = None,
) -> DataFrame:
    """Left joins to tranche and catalog names, and to archive paths when given."""
    d = results.join(tranches, "tranche_id", "left").join(catalog, "cat_id", "left")
    if map_3d is not None and tarballs is not None:
        d = d.join(map_3d, "sub_id", "left").join(tarballs, "tarball_id", "left")
    return d


def vendor_lookup(codes: DataFrame, supplier_codes: DataFrame, supplier_map: DataFrame, content: DataFrame,
                  keep: tuple[str, ...] = ("smiles",)) -> DataFrame:
    """code -> content id -> substance; codes without a result are appended with ``_null_``."""
    hits, misses = split_codes(codes, supplier_codes, supplier_map)
    found = hits.join(content.select("cat_content_id", *keep), "cat_content_id", "left").select("supplier_code", *keep)
    empty = misses.select("supplier_code", *[F.lit(None).cast("string").alias(c) for c in keep])
    return found.select("supplier_code", *[F.col(c).cast("string").alias(c) for c in keep]).unionByName(empty).select(
        "supplier_code", *[F.coalesce(c, F.lit(MISSING)).alias(c) for c in keep])


def new_registry_rows(batch: DataFrame, registry: DataFrame | None, key: str, order: str, required: str) -> DataFrame:
    """Insert-or-ignore: first row per unseen key, a null key being one key; rows without the required value are skipped."""
    cols = [c for c in batch.columns if c != key]
    first = batch.filter(F.col(required).isNotNull()).groupBy(key).agg(
        F.min_by(F.struct(*cols), F.col(order)).alias("_r")).select(key, "_r.*")
    if registry is None:
        return first
    return first.join(registry.select(F.col(key).alias("_known")), F.col(key).eqNullSafe(F.col("_known")), "left_anti")


def find(df: DataFrame, column: str, value) -> DataFrame:
    """Point lookup; the comparison reaches the parquet scan."""
    return df.filter(F.col(column) == F.lit(value))


def find_many(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    return df.join(keys.select(column).distinct(), column, "left_semi")
