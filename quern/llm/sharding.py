"""Sharding by fixed virtual slots; DataFrame operations only.

A record is hashed to one of SLOTS virtual slots. Bytes and rows are summed per slot, and a versioned map gives each slot its
shard. Rebalancing makes a new version by editing the last one: slots are visited from the heaviest on and stay where they
are while their shard has room up to the mean; otherwise they move to the lightest shard. The number of
slots is fixed, so the map and the sums per slot are small at every input size: broadcasting them and folding over them is
bounded by SLOTS rows. Law: `bytes` (sizes near equal).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, shared_table

SLOTS = 4096
SHARDS = 16


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, copy, virtual_slot) per row.

    The slot comes from the id, the text's checksum and the row's number among the rows that agree in these, so that copies
    of a text, repeated ids, null ids and repeated rows all spread.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    hashed = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"), F.col("copy").cast("string")))
    return numbered(rows, "copy").withColumn("virtual_slot", F.conv(F.substring(hashed, 1, 3), 16, 10).cast("int"))


def initial_map(spark: SparkSession, shards: int = SHARDS) -> DataFrame:
    """Version 0: slots dealt in turn."""
    return spark.range(SLOTS).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of a map, edited for the loads (virtual_slot, bytes). A fold over the SLOTS rows of the map."""
    last = slot_map.join(F.broadcast(slot_map.agg(F.max("version").alias("version"))), "version")
    weighed = last.join(F.broadcast(loads.select("virtual_slot", "bytes")), "virtual_slot", "left").select(
        "version", "virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes")
    )
    items = weighed.agg(
        F.max("version").alias("version"),
        F.ceil(F.sum("bytes") / shards).alias("mean"),
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "shard"))).alias("items"),
    )
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("placed"))

    def step(acc, x):
        stays = F.when((x["shard"] < shards) & (F.get(acc["loads"], x["shard"]) - x["less"] <= F.col("mean")), x["shard"])
        chosen = F.coalesce(stays, (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int"))
        return F.struct(
            F.transform(acc["loads"], lambda v, i: F.when(i == chosen, v - x["less"]).otherwise(v)).alias("loads"),
            F.concat(acc["placed"], F.array(chosen)).alias("placed"),
        )

    placed = items.select("version", "items", F.aggregate("items", start, step, lambda acc: acc["placed"]).alias("placed"))
    return placed.select("version", F.explode(F.arrays_zip(F.col("items.virtual_slot").alias("virtual_slot"), "placed")).alias("z")).select(
        (F.col("version") + 1).alias("version"), F.col("z.virtual_slot").alias("virtual_slot"), F.col("z.placed").alias("shard")
    )


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot (position in its shard), grown_shard (null), virtual_slot, map_version.

    The map's versions 0 and 1 are stored in the shared folder. Positions are made of the slots' row counts and a
    window within one virtual slot, so no window holds a whole shard. Null and empty texts have size 1 and checksum 0; null ids and
    repeated rows are placed like any other, each row on its own. A text of any length counts whole and stays in one shard, so sizes
    are as near as the largest texts allow. Columns besides the two change nothing. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = shared_table(spark, slotted(docs, id_col, text_col), "slot-rows")
    loads = shared_table(spark, rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).coalesce(1), "slot-loads")
    first = initial_map(spark, shards)
    maps = shared_table(spark, first.unionByName(rebalance(first, loads, shards)).coalesce(1), "slot-map")
    last = maps.filter("version = 1")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = last.join(F.broadcast(loads), "virtual_slot").select(
        "virtual_slot", "shard", F.col("version").alias("map_version"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy")
    return rows.withColumn("n", F.row_number().over(within)).join(F.broadcast(placed), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("n") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
