"""Sharding by fixed virtual slots (native).

Records are hashed into a fixed number of virtual slots; bytes are added up per slot, and a versioned table maps slots
to shards. Placing a record needs only its slot and the current map; rebalancing edits the map, never the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.llm.common import ids_unique, write_table

SLOTS = 4096


def _deal(slots: DataFrame, shards: int, loads: Column) -> DataFrame:
    """Give each (vslot, bytes, rows), largest first, to the shard with the fewest bytes. One row per slot: bounded."""
    pick = lambda acc: F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1

    def step(acc: Column, x: Column) -> Column:
        at = pick(acc)
        return F.struct(
            F.transform(acc["loads"], lambda v, i: v + F.when(i == at, x["bytes"]).otherwise(F.lit(0))).alias("loads"),
            F.concat(acc["picks"], F.array(at)).alias("picks"),
        )

    start = F.struct(loads.alias("loads"), F.expr("cast(array() as array<int>)").alias("picks"))
    table = slots.agg(F.sort_array(F.collect_list(F.struct("bytes", F.negative("vslot").alias("order"), "vslot", "rows")), asc=False).alias("a"))
    table = table.select("a", F.aggregate("a", start, step, lambda acc: acc["picks"]).alias("picks"))
    return table.select(F.inline(F.arrays_zip("a", "picks"))).select(F.col("a.vslot").alias("vslot"), F.col("picks").alias("shard"), F.col("a.bytes").alias("bytes"), F.col("a.rows").alias("rows"))


def slot_stats(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty ones included, from rows (vslot, size)."""
    seen = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(seen, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def new_map(stats: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: (version, vslot, shard, bytes, rows)."""
    return _deal(stats, shards, F.array_repeat(F.lit(0).cast("long"), shards)).select(F.lit(1).alias("version"), "vslot", "shard", "bytes", "rows")


def rebalance(old: DataFrame, stats: DataFrame, shards: int) -> DataFrame:
    """The next version for new sizes or another number of shards. A slot stays on its shard while the shard's slots,
    largest first, add up to no more than an even share; only the rest (and slots of removed shards) move."""
    limit = stats.agg(F.ceil(F.sum("bytes") / shards)).first()[0]
    version = old.agg(F.max("version")).first()[0] + 1
    run = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot"))
    both = stats.join(old.select("vslot", "shard"), "vslot").withColumn("stays", (F.col("shard") < shards) & (run <= limit))
    stay = both.where("stays").select("vslot", "shard", "bytes", "rows")
    held = {r["shard"]: r["held"] for r in stay.groupBy("shard").agg(F.sum("bytes").alias("held")).collect()}  # one row per shard
    loads = F.array(*[F.lit(held.get(k, 0)).cast("long") for k in range(shards)])
    fresh = _deal(both.where("not stays").select("vslot", "bytes", "rows"), shards, loads).select("vslot", "shard", "bytes", "rows")
    return stay.unionByName(fresh).select(F.lit(version).alias("version"), "vslot", "shard", "bytes", "rows")


def shard_records(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(placed rows, slot map). Rows: doc_id, size, text_crc32, vslot, version, shard, slot (place in the shard).

    Size is the text's UTF-8 bytes plus 8; null texts count as empty. Rows with a null or repeated id are hashed by a
    running number too, so that they spread over the slots. Equal rows are interchangeable. An empty table gives an
    empty result and a full map. Extra columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    salt = F.lit(0).cast("long") if ids_unique(docs.select(id_col), id_col) else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), salt.alias("salt"))
    rows = write_table(rows.select("doc_id", "size", "text_crc32", F.pmod(F.xxhash64("doc_id", "salt"), F.lit(slots)).cast("int").alias("vslot")), "shard-rows")
    chart = write_table(new_map(slot_stats(rows, slots), shards), "slot-map")
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    begins = chart.select("vslot", "version", "shard", F.coalesce(before, F.lit(0)).alias("begins"))  # one row per slot
    nth = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = rows.withColumn("nth", nth).join(F.broadcast(begins), "vslot")
    return placed.select("doc_id", "size", "text_crc32", "vslot", "version", "shard", (F.col("begins") + F.col("nth")).cast("long").alias("slot")), chart


def op8_virtual_slots(spark, sf_dir: str) -> DataFrame:
    placed, _ = shard_records(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.col("version").alias("map_version"))
