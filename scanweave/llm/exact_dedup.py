"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

The first pass takes nothing but lengths.  The second hashes the beginnings of texts whose
length occurs again, the third hashes whole texts whose length and beginning occur again.
Texts are never moved: what occurs again travels to the texts as a filter, and what the
filter lets through by chance turns out to be alone in the next grouping.

Defined cases: a null text counts as empty; empty texts are one group; of equal texts the
row with the largest id stays, a null id counts as smallest; of rows that share text and
id one stays, whichever; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_facts, maybe_member, store, text_of

PREFIX_CHARS = 256


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest_all: bool = False
) -> DataFrame:
    """One row per row of ``docs``: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``text_sha256`` is null for texts whose length or beginning is unique, unless
    ``digest_all`` asks for every digest.
    """
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    sized = texts.withColumn("_length", F.octet_length("_text"))
    lengths = store(sized.groupBy("_length").agg(F.count("*").alias("_n")).where("_n > 1").select("_length"))
    sized = maybe_member(sized, [F.col("_length")], lengths, [F.col("_length")], "_sized")

    marked = sized.withColumn("_prefix", F.when(F.col("_sized"), F.xxhash64(F.substring("_text", 1, prefix_chars))))
    begins = marked.where("_sized").groupBy("_length", "_prefix").agg(F.count("*").alias("_n"))
    repeated = store(begins.where("_n > 1").select("_length", "_prefix"))
    keys = [F.col("_length"), F.col("_prefix")]
    seen = maybe_member(marked, keys, repeated, keys, "_again").withColumn("_again", F.col("_again") & F.col("_sized"))
    digest = F.sha2("_text", 256)
    hashed = seen.select(
        F.col("_id"), F.col("_again"), F.monotonically_increasing_id().alias("_row"),
        (digest if digest_all else F.when(F.col("_again"), digest)).alias("text_sha256"),
    )
    hashed = store(hashed.withColumn("_full", F.when(F.col("_again"), F.unhex("text_sha256"))))
    candidates = hashed.where("_full IS NOT NULL")
    groups = store(
        candidates.groupBy("_full")
        .agg(F.count("*").alias("group_size"), F.max(F.struct("_id", "_row")).alias("_best"))
        .where("group_size > 1")
    )
    grouped = join_facts(candidates, groups, ["_full"], "group_size").select(
        F.col("_id").alias(id_col),
        F.when(F.col("_best").isNull(), F.col("_id")).otherwise(F.col("_best._id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_row") == F.col("_best._row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
    alone = hashed.where("_full IS NULL").select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    return grouped.unionByName(alone)
