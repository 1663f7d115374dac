"""Sharding by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a prime-sized table; the shards take turns, each
claiming the first free slot that it prefers. A row's key is hashed to a slot, and the broadcast table gives the
shard in constant time. Adding or removing a shard moves few keys besides those that must move.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Production parameters: shard names and table size (a prime, about 100 slots for each shard).
SHARDS, SLOTS = 48, 5003


def preference(name: str, slots: int) -> tuple[int, int]:
    """Offset and step of a shard's walk through the table."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:8], 16) % slots, int(digest[8:16], 16) % (slots - 1) + 1


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's index for each slot; bounded by the parameters, not by the data.

    :raises ValueError: without shards, with repeated names, or if slots is no prime of at least their number.
    """
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need distinct names")
    if slots < max(2, len(names)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards")
    walks = [preference(x, slots) for x in names]
    owner, turn, step = [-1] * slots, 0, [0] * len(names)
    for _ in range(slots):
        offset, stride = walks[turn]
        while owner[slot := (offset + step[turn] * stride) % slots] >= 0:
            step[turn] += 1
        owner[slot] = turn
        turn = (turn + 1) % len(names)
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The key's slot: the first 32 bits of its md5; a null key counts as an empty one."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign_shards(df: DataFrame, key: str, names: list[str], slots: int = SLOTS, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """df with its rows' slot and shard index added. Equal keys share a shard; no row moves and none is dropped.

    Columns of df with the names of the added ones are replaced.
    """
    owner = lookup_table(names, slots)
    spark = df.sparkSession
    out = df.drop(slot_col, shard_col)
    # the table as a DataFrame of one row a slot, made from a literal: at most `slots` rows, so safe to broadcast
    shard = F.element_at(F.split(F.lit(",".join(map(str, owner))), ","), (F.col("id") + 1).cast("int")).cast("int")
    places = spark.range(slots).select(F.col("id").cast("int").alias(slot_col), shard.alias(shard_col))
    return out.withColumn(slot_col, slot_of(F.col(key), slots)).join(F.broadcast(places), slot_col).select(*out.columns, slot_col, shard_col)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i}" for i in range(n)]


def write_shards(df: DataFrame, key: str, path: str, names: list[str], slots: int = SLOTS) -> None:
    """Write one folder a shard. Tasks follow the data's size: adaptive execution joins small shards and splits large ones."""
    assign_shards(df, key, names, slots).hint("rebalance", F.col("shard")).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", shard_names())


SQL = f"""
WITH RECURSIVE walks AS (
  SELECT i, CAST('0x' || substr(md5('shard-' || i), 1, 8) AS BIGINT) % {SLOTS} AS offs,
         CAST('0x' || substr(md5('shard-' || i), 9, 8) AS BIGINT) % {SLOTS - 1} + 1 AS step
  FROM range({SHARDS}) r(i)
), fill AS (
  SELECT CAST(0 AS BIGINT) AS turn, list_transform(range({SLOTS}), lambda x: CAST(-1 AS BIGINT)) AS owner
  UNION ALL
  SELECT turn + 1, list_transform(owner, lambda x, k: CASE WHEN k = slot + 1 THEN turn % {SHARDS} ELSE x END)
  FROM (
    SELECT turn, owner, list_transform(list_filter(range({SLOTS}), lambda j: owner[(offs + j * step) % {SLOTS} + 1] < 0)[1:1], lambda j: (offs + j * step) % {SLOTS})[1] AS slot
    FROM fill JOIN walks ON walks.i = turn % {SHARDS} WHERE turn < {SLOTS}
  ) s
), places AS (
  SELECT unnest(range({SLOTS})) AS slot, unnest(owner) AS shard FROM fill WHERE turn = {SLOTS}
)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST(shard AS INTEGER) AS shard
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {SLOTS} AS at FROM documents) d
JOIN places ON places.slot = d.at
"""
