"""Shards by fixed virtual slots: records hash into slots, and a small versioned map
says which shard holds which slot. Only the map is edited when shards are rebalanced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path

#: Fixed number of virtual slots; it never changes, so neither does a record's slot.
SLOTS = 8192
#: Bytes a record takes besides its text.
OVERHEAD = 16

MAP = "version INT, virtual_slot INT, shard INT, bytes BIGINT, records BIGINT, base BIGINT"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot``. A null text is empty; records
    without a ``doc_id`` are spread by their text."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    d = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.col("text_crc32").cast("string")))
    return d.withColumn("virtual_slot", F.pmod(F.xxhash64(key), F.lit(slots)).cast("int"))


def rebalance(shard_of: list[int], load: list[int], shards: int) -> list[int]:
    """Move slots from the fullest to the emptiest shard while that narrows the gap.

    Works on the map alone: one number per virtual slot.
    """
    shard_of = list(shard_of)
    own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    total = [0] * shards
    for slot, s in enumerate(shard_of):
        if load[slot]:
            own[s].append((load[slot], slot))
            total[s] += load[slot]
    for x in own:
        x.sort()
    full, empty = [(-t, s) for s, t in enumerate(total)], [(t, s) for s, t in enumerate(total)]
    heapq.heapify(full)
    heapq.heapify(empty)
    while True:
        while -full[0][0] != total[full[0][1]]:
            heapq.heappop(full)
        while empty[0][0] != total[empty[0][1]]:
            heapq.heappop(empty)
        a, b = full[0][1], empty[0][1]
        gap = total[a] - total[b]
        fits = [i for i, (n, _) in enumerate(own[a]) if n < gap]
        if not fits:
            return shard_of
        # the slot that comes nearest to half the gap
        i = min(fits, key=lambda i: abs(2 * own[a][i][0] - gap))
        n, slot = own[a].pop(i)
        own[b].append((n, slot))
        own[b].sort()
        shard_of[slot] = b
        for s, d in ((a, -n), (b, n)):
            total[s] += d
            heapq.heappush(full, (-total[s], s))
            heapq.heappush(empty, (total[s], s))


def grow(shard_of: list[int], load: list[int], shards: int) -> list[int]:
    """One more shard, filled with slots of the others until it holds its part."""
    goal, held, out = sum(load) / (shards + 1), 0, list(shard_of)
    for slot in sorted(range(len(load)), key=lambda s: (-load[s], s)):
        if held + load[slot] <= goal and load[slot]:
            out[slot], held = shards, held + load[slot]
    return out


class SlotMap:
    """Versions of the slot map, kept as a table under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, version: int, shard_of: list[int], load: list[tuple[int, int]]) -> None:
        """``load``: bytes and records per slot. ``base`` is where the slot's records start in their shard."""
        seen: dict[int, int] = {}
        rows = []
        for slot, (shard, (n, count)) in enumerate(zip(shard_of, load, strict=True)):
            rows.append((version, slot, shard, n, count, seen.get(shard, 0)))
            seen[shard] = seen.get(shard, 0) + count
        self.spark.createDataFrame(rows, MAP).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version:06d}")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP).parquet(f"{self.path}/version={version:06d}")


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot, map_version, shard, slot``.

    Version 0 of the map deals slots evenly, version 1 is version 0 rebalanced by
    the bytes that each slot holds. ``slot`` numbers a shard's records from 0.

    * Null text: empty. Null ``doc_id``: placed by its text.
    * Repeated rows share a virtual slot and get places of their own.
    * Copies of one text are different records; no group is kept together.
    * An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    r = records(docs, slots)
    # one row per virtual slot at most
    held = {x.virtual_slot: (x.n, x.c) for x in r.groupBy("virtual_slot").agg(F.sum("size").alias("n"), F.count("*").alias("c")).collect()}
    load = [held.get(s, (0, 0)) for s in range(slots)]
    maps = SlotMap(spark, path or scratch_path(spark, "slot-map"))
    even = [s * shards // slots for s in range(slots)]
    maps.write(0, even, load)
    maps.write(1, rebalance(even, [n for n, _ in load], shards), load)
    current = maps.read(1).select("virtual_slot", "shard", "base", F.col("version").alias("map_version"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (
        r.withColumn("_place", place)
        .join(F.broadcast(current), "virtual_slot")  # one row per virtual slot, a fixed number
        .withColumn("slot", F.col("base") + F.col("_place") - 1)
        .drop("_place", "base")
    )


def op2_sharding(spark, sf_dir):
    s = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return s.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
