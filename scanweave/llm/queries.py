"""Registered queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, line_dedup, mixing, periodic_runs, secret_scan, sharding, simhash, suffix_dedup, token_alignment, toxicity, warc
from .common import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    lines = line_dedup.line_rows(docs)
    dropped = line_dedup.dropped_lines(docs, lines=lines)
    entry = F.concat_ws(":", "line", "kind", "first_id", "first_line")
    per_text = dropped.groupBy("id", "hash").agg(
        F.count_if(F.col("kind") == "exact").alias("n_exact"), F.count_if(F.col("kind") == "near").alias("n_near"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", entry.alias("e")))), lambda x: x["e"]), ",").alias("dropped"),
    )
    counts = lines.groupBy("id", "hash").agg(F.count("*").alias("n_lines"))
    same = counts["id"].eqNullSafe(per_text["id"]) & (counts["hash"] == per_text["hash"])
    return counts.join(per_text, same, "left").select(
        counts["id"].alias("doc_id"), "n_lines", F.coalesce("n_exact", F.lit(0)).alias("n_exact"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("dropped", F.lit("")).alias("dropped"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"), digest_all=True)
    return decided.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["ord"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["ord"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("stop").alias("stop_word"), F.col("first_id").alias("first_doc_id"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(warc.planned(read(spark, sf_dir, "pages")))
    records = warc.read_archives(archives)
    # The archives are the query's own: bytes that cannot be read would be lost pages.
    unreadable = F.raise_error(F.concat(F.lit("gap in "), "archive", F.lit(": "), "reason"))
    records = records.where(F.when(F.col("kind") == "gap", unreadable.cast("boolean")).otherwise(True))
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "item_words", "distance", "position")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = sharding.assign_shards(read(spark, sf_dir, "documents"))
    return records.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_rows(docs, model)


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; ``TOKENIZERS_DIR`` names another folder with them."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.run_digests(read(spark, sf_dir, "documents"), plant_tails=True)
    return found.withColumnRenamed("id", "doc_id")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.link_statistics(
        read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    )
    return found.withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_exact_dedup, op3_secrets, op4_suffix_dedup, op5_warc, op6_decontamination, op7_mixing, op8_simhash, op9_sharding, op10_toxicity,
        op11_bpe, op12_periodic_runs, op13_token_alignment,
    )
}

ORACLE: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op5_warc": """
        WITH payloads AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
                   row_number() OVER same AS place, first_value(page_id) OVER same AS first_id
            FROM pages WINDOW same AS (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST)
        ), fives AS (
            SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::BIGINT) AS five FROM payloads
        )
        SELECT page_id, payload_bytes,
               array_to_string(flatten(list_transform(five, lambda v: list_transform([15, 10, 5, 0],
                   lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)))), '') AS payload_digest,
               CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN place > 1 THEN first_id END AS refers_to
        FROM fives
    """,
}
