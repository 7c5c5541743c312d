"""Sharding by fixed virtual slots (DataFrame and SQL functions only).

A record's slot is a hash of its id and text, one of ``SLOTS``.  Bytes are
added up per slot, and the slot-to-shard map, a table of SLOTS rows with a
version, gives the largest slot next to the shard with the fewest bytes.
Growing or rebalancing edits the map (a new version), never the records' slots.

What is gathered is bounded by SLOTS: one row of the map is folded in one
array.  Places in a shard need no sort by shard: a record is numbered inside
its slot, and the map says where the slot begins.

Nulls: a null text has no bytes (checksum 0); a null id hashes as an empty one.  Repeated rows
share a slot and get places of their own.  Empty input gives no rows.  A very
long text is read whole for its size and checksum.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import documents, written

SLOTS, SHARDS, OVERHEAD = 4096, 24, 8


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(F.encode(text, "UTF-8"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), crc.cast("long").alias("text_crc32")).withColumn("virtual_slot", F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32"), 256), 1, 12), 16, 10).cast("long"), F.lit(slots)).cast("int"))


def _fold(load: Column, shards: int) -> Column:
    """Largest slot first, each to the least loaded shard: array of (slot, shard)."""
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("owners"))

    def place(state, slot):
        least = F.array_position(state["loads"], F.array_min(state["loads"]))
        loads = F.transform(state["loads"], lambda x, i: F.when(i == least - 1, x + slot["bytes"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(state["owners"], F.array((least - 1).cast("int"))).alias("owners"))

    return F.aggregate(load, start, place, lambda s: s["owners"])


def slot_map(slotted: DataFrame, shards: int = SHARDS, version: int = 1) -> DataFrame:
    """version, slot, shard, bytes, rows, begins (place of the slot's first row in its shard)."""
    load = slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    listed = load.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), F.col("virtual_slot").alias("slot"), "bytes", "rows"))).alias("load"))
    pairs = listed.select(F.explode(F.arrays_zip("load", _fold(F.col("load"), shards).alias("shard"))).alias("e"))
    found = pairs.select(F.lit(version).alias("version"), "e.load.slot", F.col("e.shard").alias("shard"), "e.load.bytes", "e.load.rows")
    return _begins(found)


def _begins(found: DataFrame) -> DataFrame:
    earlier = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return found.drop("begins").withColumn("begins", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).cast("long"))


def add_shard(mapped: DataFrame) -> DataFrame:
    """The map's next version with one more shard: every old shard hands over the slots beyond its new fair share, to the new shard only."""
    old = mapped.agg((F.max("shard") + 1).alias("new"), F.sum("bytes").alias("total"), F.max("version").alias("was"))
    upto = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot").rowsBetween(Window.unboundedPreceding, 0)
    kept = F.sum("bytes").over(upto) <= F.col("total") / (F.col("new") + 1)
    moved = mapped.crossJoin(F.broadcast(old)).withColumn("shard", F.when(kept, F.col("shard")).otherwise(F.col("new")).cast("int")).withColumn("version", F.col("was") + 1)
    return _begins(moved.drop("new", "total", "was"))


def assign(slotted: DataFrame, mapped: DataFrame) -> DataFrame:
    """Each row's shard and its place there; the map has SLOTS rows at most, so it is broadcast."""
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32"))
    table = F.broadcast(mapped.select(F.col("slot").alias("virtual_slot"), "shard", "begins", "version"))
    return slotted.withColumn("place", place).join(table, "virtual_slot").withColumn("slot", (F.col("begins") + F.col("place") - 1).cast("long")).drop("place", "begins")


def op7_virtual_slot_sharding(spark, sf_dir):
    slotted = with_slots(documents(spark, sf_dir))
    mapped = written(slot_map(slotted), "slot-map")  # the stored, versioned map
    out = assign(slotted, mapped)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))


#: The same in plain SQL: the checksum bit by bit, the greedy fold by recursion.
ORACLE = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS crc),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + {OVERHEAD} AS size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1]))) AS text_crc32 FROM documents, t),
s AS (SELECT *, (('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '') || ':' || text_crc32), 1, 12))::BIGINT % {SLOTS})::INT AS virtual_slot FROM d),
l AS (SELECT virtual_slot, sum(size)::BIGINT AS bytes, count(*) AS n, row_number() OVER (ORDER BY sum(size) DESC, virtual_slot) AS i FROM s GROUP BY virtual_slot),
f AS (SELECT 0::BIGINT AS i, -1 AS virtual_slot, -1::BIGINT AS shard, list_transform(range({SHARDS}), lambda x: 0::BIGINT) AS loads
  UNION ALL SELECT l.i, l.virtual_slot, list_position(f.loads, list_min(f.loads)) - 1, list_transform(f.loads, lambda x, k: CASE WHEN k = list_position(f.loads, list_min(f.loads)) THEN x + l.bytes ELSE x END) FROM f JOIN l ON l.i = f.i + 1),
m AS (SELECT f.virtual_slot, shard::INT AS shard, coalesce(sum(n) OVER (PARTITION BY shard ORDER BY f.virtual_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM f JOIN l USING (virtual_slot))
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, (begins + row_number() OVER (PARTITION BY virtual_slot ORDER BY doc_id, text_crc32) - 1)::BIGINT AS slot, NULL::INT AS grown_shard, virtual_slot, 1 AS map_version
FROM s JOIN m USING (virtual_slot)
"""
