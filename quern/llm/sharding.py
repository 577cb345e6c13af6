"""Sharding by fixed virtual slots (operator 10), with DataFrame functions only.

A record's slot is a hash of its id and text, modulo a fixed number of slots; bytes are added up by slot,
and a versioned map gives each slot a shard. Only the map is edited to rebalance or to add a shard: slots
move, records keep their slot. The law is `bytes`: the map is made from the slots' bytes, largest first to
the lightest shard, so shards' sizes are near equal. It has SLOTS entries, whatever the data, so the driver
can hold it. Null text: no bytes, CRC of the empty text. A null doc_id is hashed with its text.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS, SHARDS, OVERHEAD = 8192, 40, 16


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each record; the text itself is not shuffled."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_bytes(found: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of the slots in use: at most as many as there are slots."""
    return [tuple(r) for r in found.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()]


def build_map(loads: list[tuple[int, int, int]], slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    """slot -> shard: the largest slot goes to the lightest shard, and so on; ties by number."""
    out, heap = [0] * slots, [(0, s) for s in range(shards)]
    size = {s: b for s, b, _ in loads}
    for slot in sorted(range(slots), key=lambda s: (-size.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + size.get(slot, 0), shard))
    return out


def rebalance(slot_map: list[int], loads: list[tuple[int, int, int]], shards: int, tolerance: float = 0.02) -> list[int]:
    """The next version of a map: moves slots from the heaviest to the lightest shard until all are within tolerance."""
    size, out = {s: b for s, b, _ in loads}, list(slot_map)
    load = [0] * shards
    members: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        load[shard] += size.get(slot, 0)
        members[shard].append(slot)
    mean = sum(load) / shards
    for _ in range(len(out)):
        heavy, light = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[heavy] - load[light]
        fits = [s for s in members[heavy] if 0 < size.get(s, 0) < gap]
        if load[heavy] <= mean * (1 + tolerance) and load[light] >= mean * (1 - tolerance) or not fits:
            break
        slot = min(fits, key=lambda s: (abs(size[s] - gap / 2), s))
        members[heavy].remove(slot)
        members[light].append(slot)
        load[heavy] -= size[slot]
        load[light] += size[slot]
        out[slot] = light
    return out


def map_frame(spark: SparkSession, slot_map: list[int], version: int) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, slot_map))), ",")).alias("slot", "shard")).select(F.lit(version).alias("version"), "slot", F.col("shard").cast("int").alias("shard"))


def save_map(spark: SparkSession, path: str, slot_map: list[int], version: int) -> None:
    """Each version is a folder of its own, written once; readers of older versions are not disturbed."""
    map_frame(spark, slot_map, version).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    found = spark.read.parquet(path)
    if version is None:
        version = found.agg(F.max("version")).first()[0]
    rows = found.filter(F.col("version") == version).orderBy("slot").select("shard").collect()
    return version, [r[0] for r in rows]


def shard_of(slot_map: list[int], slot: Column) -> Column:
    """The map as a constant array, looked up by slot: no join."""
    return F.element_at(F.split(F.lit(",".join(map(str, slot_map))), ",").cast("array<int>"), slot + 1)


def assign(found: DataFrame, slot_map: list[int], loads: list[tuple[int, int, int]]) -> DataFrame:
    """Records with shard and slot: the place within the shard, from 0 and without gaps.

    Places are counted within a virtual slot, then shifted by the rows of the shard's slots before it, so no
    task sees more than one virtual slot at a time.
    """
    rows = {s: n for s, _, n in loads}
    start, shift = [0] * (max(slot_map, default=0) + 1), []
    for slot, shard in enumerate(slot_map):
        shift.append(start[shard])
        start[shard] += rows.get(slot, 0)
    before = F.element_at(F.split(F.lit(",".join(map(str, shift))), ",").cast("array<bigint>"), F.col("virtual_slot") + 1)
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return found.select("*", shard_of(slot_map, F.col("virtual_slot")).alias("shard"), (before + place - 1).alias("slot"))
