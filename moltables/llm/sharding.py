"""Sharding by fixed virtual slots and a versioned map from slot to shard.

A record's slot comes from a hash and never changes. Bytes are added up for
each slot, and a map table (one row for each slot and version) says which
shard holds it. Rebalancing and growing edit the map: a new version moves
some slots and leaves the others where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltables.llm.common import documents, query
from moltables.session import stable

#: Virtual slots. Fixed for the life of a data set; the map and the totals have so many rows at most.
SLOTS = 4096
SHARDS = 24


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot): the slot is a hash of id and text, so rows without an id spread too."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(slots)).alias("vslot"))


def slot_totals(records: DataFrame) -> DataFrame:
    """Bytes and rows of each slot that has any: at most ``SLOTS`` rows."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _least(loads: Column) -> Column:
    return F.array_position(loads, F.array_min(loads)).cast("int")


def first_map(totals: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the map: slots from the largest down, each to the shard with the least bytes so far.

    The slots of the whole table (a fixed number) are walked in one row.
    """
    slots = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot")))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("to"))

    def put(acc: Column, slot: Column) -> Column:
        return F.transform(F.array(_least(acc["loads"])), lambda at: F.struct(
            F.transform(acc["loads"], lambda v, i: F.when(i == at - 1, v - slot["less"]).otherwise(v)).alias("loads"),
            F.concat(acc["to"], F.array(at - 1)).alias("to")))[0]

    d = totals.agg(slots.alias("s")).select("s", F.aggregate("s", start, put, lambda acc: acc["to"]).alias("to"))
    d = d.select(F.explode(F.arrays_zip(F.col("s.vslot").alias("vslot"), F.col("to").alias("shard"))).alias("x"))
    return d.select(F.lit(1).alias("version"), F.col("x.vslot").alias("vslot"), F.col("x.shard").alias("shard"))


def grown_map(slot_map: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """Next version with one more shard: each old shard gives slots up to what it has over the new mean; none move between old shards."""
    d = slot_map.join(totals, "vslot")
    by = Window.partitionBy("shard")
    upto = by.orderBy(F.xxhash64("vslot"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    spare = F.sum("bytes").over(by) - F.sum("bytes").over(Window.partitionBy()) / (shards + 1)
    return d.select((F.col("version") + 1).alias("version"), "vslot", F.when(F.sum("bytes").over(upto) <= spare, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def rebalanced_map(slot_map: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """Next version after sizes changed: shards over the mean give slots up to the surplus, which go to the shards under it.

    The given slots, largest first, are dealt by the running sum of the room
    that the other shards have; a slot goes where its middle byte falls.
    """
    every = totals.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    d = slot_map.join(totals, "vslot", "left").fillna(0, ["bytes"])
    load = every.join(d.groupBy("shard").agg(F.sum("bytes").alias("load")), "shard", "left").fillna(0, ["load"])
    mean = F.sum("load").over(Window.partitionBy()) / shards
    load = load.select("shard", "load", mean.alias("mean"))
    by = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(load, "shard").withColumn("gives", (F.col("bytes") > 0) & (F.sum("bytes").over(by) <= F.col("load") - F.col("mean")))
    one = Window.partitionBy().orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    given = d.filter("gives").select("vslot", (F.sum("bytes").over(one) - F.col("bytes") / 2).alias("mid"))
    room = load.filter("load < mean").withColumn("room", F.col("mean") - F.col("load"))
    room = room.select(F.col("shard").alias("dest"), F.sum("room").over(Window.partitionBy().orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)).alias("hi"), "room")
    moved = given.join(F.broadcast(room), (F.col("mid") <= F.col("hi")) & (F.col("mid") > F.col("hi") - F.col("room")), "left")
    moved = moved.groupBy("vslot").agg(F.min("dest").alias("dest"))
    return d.join(moved, "vslot", "left").select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("dest", "shard").cast("int").alias("shard"))


def placed(records: DataFrame, slot_map: DataFrame, totals: DataFrame) -> DataFrame:
    """Records with their shard and their place in it (``slot``: 0, 1, 2, … without gaps).

    A virtual slot's first place is the number of rows in the lower slots of
    its shard; rows are numbered inside their virtual slot only, so no task
    gets a whole shard. Map and totals have a fixed number of rows and are broadcast.
    """
    d = slot_map.join(totals, "vslot")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.select("vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    at = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return records.withColumn("at", at).join(F.broadcast(starts), "vslot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"), "vslot")


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed records, version 1 of the map, slot totals).

    Null and empty texts have 8 bytes. Null ids are records like others.
    Repeated rows share a slot and get places of their own. An empty table
    gives empty results. Other columns are not read.
    """
    records = stable(with_slots(docs, id_col, text_col, slots))
    totals = stable(slot_totals(records))
    slot_map = stable(first_map(totals, shards))
    return placed(records, slot_map, totals), slot_map, totals


@query()
def op4_virtual_slot_shards(spark, sf_dir):
    """All documents in 24 shards of near equal bytes."""
    d, _, _ = sharded(documents(spark, sf_dir))
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
