"""Shards of near-equal size through a fixed number of virtual slots.

A record's slot is a hash of the record and never changes. Bytes are added up
per slot, and a versioned map says which shard holds a slot. The first version
deals the slots by size; a later one is an edit of the one before, which moves
few slots: from the fullest shards to the emptiest, or into an added shard.
The map has ``SLOTS`` rows, whatever the data, so it is made on the driver.

The law is "bytes": the sizes of the shards are near equal. A slot that many
copies of one record make larger than a quarter of a shard is dealt out in
parts by row; there are fewer than four such slots a shard.

Size is the UTF-8 length plus 1; null and empty texts have size 1 and CRC 0.
Rows without an id take part. Equal rows are kept, each with a place of its own.
An empty table gives an empty map of slots and no rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.plans.ordered import rank_rows
from threadloom.session import scratch_path, written

SHARDS = 16
SLOTS = 4096
#: A slot above this part of a shard's share is dealt out in parts.
LARGE = 4

Slot = tuple[int, int]  # number, part


def first_map(sizes: dict[Slot, int], shards: int) -> dict[Slot, int]:
    """Largest slots first, each to the emptiest shard."""
    heap = [(0, 0, s) for s in range(shards)]
    out = {}
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        filled, n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (filled + sizes[slot], n + 1, shard))
    return out


def edited_map(before: dict[Slot, int], sizes: dict[Slot, int], shards: int, tolerance: float = 0.01) -> dict[Slot, int]:
    """The map with few slots moved so that every shard is within ``tolerance`` of the mean, if slots allow.

    Slots that the map before lacks go to the emptiest shard.
    """
    out = {s: before[s] for s in sizes if before.get(s, shards) < shards}
    held: dict[int, list[Slot]] = defaultdict(list)
    filled = dict.fromkeys(range(shards), 0)
    for slot, shard in out.items():
        held[shard].append(slot)
        filled[shard] += sizes[slot]
    for slot in sorted(sizes.keys() - out.keys(), key=lambda s: (-sizes[s], s)):
        shard = min(filled, key=lambda s: (filled[s], s))
        out[slot] = shard
        held[shard].append(slot)
        filled[shard] += sizes[slot]
    mean = sum(sizes.values()) / shards
    while True:
        full, empty = max(filled, key=filled.get), min(filled, key=filled.get)
        gap = filled[full] - filled[empty]
        if gap <= tolerance * mean:
            return out
        small = [s for s in held[full] if 0 < sizes[s] < gap]
        if not small:
            return out
        slot = min(small, key=lambda s: (abs(gap - 2 * sizes[s]), s))
        held[full].remove(slot)
        held[empty].append(slot)
        filled[full] -= sizes[slot]
        filled[empty] += sizes[slot]
        out[slot] = empty


def save_map(spark: SparkSession, path: str, version: int, shard_of: dict[Slot, int], sizes: dict[Slot, int]) -> DataFrame:
    """Store one version beside the earlier ones and return it as a table."""
    rows = [(slot, part, shard, sizes[slot, part]) for (slot, part), shard in sorted(shard_of.items())]
    df = spark.createDataFrame(rows, "virtual_slot int, part int, shard int, bytes long")
    df.coalesce(1).write.parquet(f"{path}/version={version}")
    return load_map(spark, path, version)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, part int, shard int, bytes long").parquet(f"{path}/version={version}")


def measured(df: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, no), written."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
                     F.crc32(body.cast("binary")).alias("text_crc32"))
    slot = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int")
    return written(rows.withColumn("virtual_slot", slot).withColumn("no", F.monotonically_increasing_id()), "sizes")


def slot_sizes(rows: DataFrame, shards: int) -> tuple[dict[Slot, int], dict[int, int]]:
    """Bytes of every slot part, and the number of parts of the slots that are dealt out."""
    sums = {r["virtual_slot"]: r["bytes"] for r in
            rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()}  # at most SLOTS rows
    most = max(1, sum(sums.values()) // (LARGE * shards))
    parts = {slot: -(-size // most) for slot, size in sums.items() if size > most}
    sizes = {}
    for slot, size in sums.items():
        n = parts.get(slot, 1)
        for part in range(n):
            sizes[slot, part] = size // n
    return sizes, parts


def with_parts(rows: DataFrame, parts: dict[int, int]) -> DataFrame:
    if not parts:
        return rows.withColumn("part", F.lit(0))
    dealt = rows.sparkSession.createDataFrame(sorted(parts.items()), "virtual_slot int, parts int")
    out = rows.join(F.broadcast(dealt), "virtual_slot", "left")  # fewer rows than LARGE x shards
    return out.withColumn("part", F.pmod(F.xxhash64("no"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def shard(
    df: DataFrame, shards: int = SHARDS, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text",
    map_path: str | None = None, before: dict[Slot, int] | None = None, version: int = 1,
) -> DataFrame:
    """Every row with its shard and its place there; the map used is stored as ``version``.

    With ``before``, the map of the version before, the stored map is an edit of it.
    """
    rows = measured(df, doc_id, text, slots)
    sizes, parts = slot_sizes(rows, shards)
    shard_of = first_map(sizes, shards) if before is None else edited_map(before, sizes, shards)
    table = save_map(df.sparkSession, map_path or scratch_path(df.sparkSession, "slot-map"), version, shard_of, sizes)
    placed = with_parts(rows, parts).join(  # the map has at most SLOTS + LARGE x LARGE x shards rows
        F.broadcast(table.select("virtual_slot", "part", "shard")), ["virtual_slot", "part"])
    ranked = rank_rows(placed, ["shard"], ["no"], "rank")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
