"""A broadcast filter, for finding few rows among many without moving them."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Bits for each member; a filter has at most MAX_BITS, 16 MB, held as 2 million rows.
MEMBER_BITS = 12
MIN_BITS, MAX_BITS = 1 << 14, 1 << 27


def filter_shape(members: int) -> tuple[int, int]:
    """``(words of 64 bits, bits set per member)`` for so many members."""
    bits = MIN_BITS
    while bits < min(MEMBER_BITS * members, MAX_BITS):
        bits *= 2
    return bits // 64, 3 if bits >= 6 * members else 2 if bits >= 3 * members else 1


def pass_rate(members: int) -> float:
    """The share of rows that are no members and are let through: 2 % or less up to 11 million
    members, for which the largest filter has 12 bits each; then it grows, to a half at 10^8."""
    words, per_member = filter_shape(members)
    load = members / words
    term, rate = exp(-load), 0.0
    for k in range(int(load + 20 * load**0.5 + 20)):
        rate += term * (1 - (1 - 1 / 64) ** (k * per_member)) ** per_member
        term *= load / (k + 1)
    return rate


def maybe_member(rows: DataFrame, keys: list[Column], members: DataFrame, member_keys: list[Column], name: str) -> DataFrame:
    """Add boolean ``name``: false only where the row's keys are surely not in ``members``.

    The members, counted first, become an array of words of 64 bits, sized by their number and
    never larger than 16 MB.  It is broadcast, so the rows, with all they carry, stay where they
    are.  See :func:`pass_rate` for how many others pass; what follows tests those exactly.
    """
    hashes = materialize(members.select(F.xxhash64(*member_keys).alias("_mm_hash")))
    words, per_member = filter_shape(hashes.count())

    def word(key: Column) -> Column:
        return F.pmod(key, F.lit(words)).alias("_mm_word")

    def mask(key: Column) -> Column:
        spread = F.xxhash64(key)
        bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(per_member)]
        out = bits[0]
        for bit in bits[1:]:
            out = out.bitwiseOR(bit)
        return out.alias("_mm_mask")

    key = F.col("_mm_hash")
    filled = hashes.select(word(key), mask(key)).groupBy("_mm_word").agg(F.bit_or("_mm_mask").alias("_mm_bits"))
    # A written table: its size is known, and no later step repeats the work behind it.
    filled = materialize(filled)
    found = rows.withColumn("_mm_hash", F.xxhash64(*keys)).withColumns({"_mm_word": word(key), "_mm_mask": mask(key)})
    found = found.join(F.broadcast(filled), "_mm_word", "left")
    hit = F.col("_mm_bits").bitwiseAND(F.col("_mm_mask")) == F.col("_mm_mask")
    return found.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_mm_hash", "_mm_word", "_mm_mask", "_mm_bits")
