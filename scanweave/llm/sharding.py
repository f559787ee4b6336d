"""Sharding by fixed virtual slots and a versioned map from slots to shards.

A record's slot is a hash of its id and text and never changes.  Bytes and rows are
aggregated per slot; the map, one row per slot, says which shard holds it.  Version 0 deals
slots in turn; rebalancing edits the map, moving or swapping as few slots as bring the
shards' bytes together, and growing moves slots only to the new shard.  Each version is a
table, so any older layout can be read again.  The map has as many entries as there are
slots, whatever the corpus, so editing it on the driver is bounded.

Defined cases: a null text counts as empty; null ids are hashed like any other value; rows
equal in id and text share a slot, and a slot with more than its share of rows is numbered
in parts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import new_folder, store, text_of

SLOTS = 4096
SHARDS = 8
TOLERANCE = 0.001


def hashed_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Stored small rows, without texts: id, ``size`` (bytes plus 1), ``text_crc32``, ``virtual_slot``."""
    rows = docs.select(F.col(id_col), text_of(text_col).alias("_text")).select(
        id_col, (F.octet_length("_text") + 1).cast("long").alias("size"), F.crc32(F.col("_text").cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"),
    )
    slot = F.pmod(F.xxhash64(F.col(id_col), "text_crc32", "size"), F.lit(slots)).cast("int")
    return store(rows.withColumn("virtual_slot", slot))


def slot_sizes(records: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """``(bytes, rows)`` of each slot: at most ``slots`` entries."""
    sizes = [(0, 0)] * slots
    for slot, size, rows in records.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect():
        sizes[slot] = (size, rows)
    return sizes


def rebalance(shard_of: list[int], sizes: list[int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """Edit a map until the shards' sizes differ by at most ``tolerance`` of their mean.

    Each edit moves one slot from the largest shard to the smallest, or swaps two slots of
    them, choosing what leaves them most alike; it ends when no edit helps.
    """
    shard_of, loads = list(shard_of), [0] * shards
    for slot, shard in enumerate(shard_of):
        loads[shard] += sizes[slot]
    allowed = tolerance * sum(loads) / shards
    while True:
        high, low = loads.index(max(loads)), loads.index(min(loads))
        gap = loads[high] - loads[low]
        if gap <= allowed:
            return shard_of
        given = [(sizes[s], s) for s, shard in enumerate(shard_of) if shard == high and sizes[s]]
        taken = sorted([(sizes[s], s) for s, shard in enumerate(shard_of) if shard == low] + [(0, -1)])
        best = _closest(given, taken, gap)
        if best is None:
            return shard_of
        moved, out, back = best
        shard_of[out] = low
        if back >= 0:
            shard_of[back] = high
        loads[high] -= moved
        loads[low] += moved


def _closest(given: list[tuple[int, int]], taken: list[tuple[int, int]], gap: int) -> tuple[int, int, int] | None:
    """``(size moved, slot out, slot back)`` whose net size is closest to half of ``gap``."""
    from bisect import bisect_left

    best, wanted, sizes = None, gap / 2, [t[0] for t in taken]
    for size, out in given:
        at = bisect_left(sizes, size - wanted)
        for i in (at - 1, at):
            if 0 <= i < len(taken):
                net = size - sizes[i]
                if 0 < net < gap and (best is None or abs(net - wanted) < abs(best[0] - wanted)):
                    best = (net, out, taken[i][1])
    return best


def grow(shard_of: list[int], sizes: list[int], shards: int) -> list[int]:
    """The map with one more shard, which takes slots from the largest ones up to an equal share."""
    shard_of, loads = list(shard_of), [0] * (shards + 1)
    for slot, shard in enumerate(shard_of):
        loads[shard] += sizes[slot]
    share = sum(loads) / (shards + 1)
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        shard = shard_of[slot]
        if loads[shard] - sizes[slot] / 2 >= share and loads[shards] + sizes[slot] / 2 <= share:
            shard_of[slot] = shards
            loads[shard] -= sizes[slot]
            loads[shards] += sizes[slot]
    return shard_of


def _fixed(values: list[int]) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def write_map(spark: SparkSession, versions: list[list[int]], folder: str | None = None) -> DataFrame:
    """The map's table ``(version, virtual_slot, shard)``, one row per version and slot."""
    folder = folder or new_folder(spark)
    for version, shard_of in enumerate(versions):
        shard = F.get(_fixed(shard_of), F.col("id").cast("int"))
        rows = spark.range(0, len(shard_of), 1, 1).select(F.col("id").cast("int").alias("virtual_slot"), shard.alias("shard"))
        rows.write.mode("overwrite").parquet(f"{folder}/version={version}")
    return spark.read.parquet(folder)


def shard_records(records: DataFrame, shard_map: DataFrame, rows_per_slot: list[int], id_col: str = "doc_id") -> DataFrame:
    """Add ``shard`` and ``slot``, the record's place in its shard, counted from 0.

    Records are numbered inside their virtual slot, and a slot starts where the slots
    before it in the same shard end.  A slot with over four times the mean number of rows
    is cut into parts that are numbered by themselves, so no task gets a large share.
    """
    limit = max(1000, 4 * sum(rows_per_slot) // max(1, len(rows_per_slot)))
    large = {s: -(-n // limit) for s, n in enumerate(rows_per_slot) if n > limit}
    part = F.lit(0)
    if large:
        parts = F.get(_fixed([large.get(s, 1) for s in range(len(rows_per_slot))]), F.col("virtual_slot"))
        part = F.pmod(F.xxhash64("_row"), parts).cast("int")
    # One row per slot: a table of fixed size.
    placed = records.join(F.broadcast(shard_map), "virtual_slot").withColumn("_part", part)
    counts = placed.groupBy("shard", "virtual_slot", "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("virtual_slot", "_part").rowsBetween(W.unboundedPreceding, -1)
    # At most twice as many rows as there are slots.
    starts = counts.select("virtual_slot", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("virtual_slot", "_part").orderBy(id_col, "text_crc32", "size", "_row")
    numbered = placed.withColumn("_at", F.row_number().over(inside))
    return (
        numbered.join(F.broadcast(starts), ["virtual_slot", "_part"])
        .withColumn("slot", F.col("_start") + F.col("_at") - 1)
        .drop("_start", "_at", "_part", "_row")
    )


def assign_shards(
    docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """``(records, versions of the map)``; the records follow the newest version, balanced by bytes."""
    records = hashed_records(docs, id_col, text_col, slots)
    sizes = slot_sizes(records, slots)
    first = [slot % shards for slot in range(slots)]
    balanced = rebalance(first, [size for size, _ in sizes], shards)
    versions = write_map(docs.sparkSession, [first, balanced])
    newest = versions.where("version = 1").drop("version")
    return shard_records(records, newest, [rows for _, rows in sizes], id_col), versions
