"""Repeated passages by a sparse suffix array.

Suffixes are retained at content-selected minimiser positions, about one in thirteen words
at most, such that every passage of 50 words has one.  Suffixes with the same first 25 words
are neighbours; Spark brings them together by their hash.  Neighbours are compared over
their stretches, which extend left and right as far as the suffix speaks for passages: if
all of a neighbourhood have equal stretches, all passages in them are repeated.  Otherwise
an end of a repeated passage lies inside, and the neighbourhood is compared passage by
passage.  Passages that overlap are joined, so a match extends as far as texts agree.

Words are what is between white space, compared exactly.  A passage counts if it is in two
or more documents; one that only recurs inside its document does not.  A text's rows leave the tasks
only for suffixes that may be repeated, and everything after works on hashes: neighbourhoods
are aggregates, however large.

Defined cases: a null text has no words; texts with fewer than 50 words have no passage;
equal texts of different ids repeat each other; rows that share id and text are one
document; a null id is an id of its own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import line_hashes, suffixes
from .common import join_facts, map_batches, maybe_member, ship, store, text_hash, text_of

ship(line_hashes, suffixes)

_ROWS = "prefix long, doc long, id long, start int, passages int, stretch long, hashes array<long>"


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, doc, start, stop, first_id)``: stretches of words, at least 50, that other documents have too.

    ``start`` and ``stop`` count words from 0, ``stop`` exclusive; ``first_id`` is the smallest
    id of a document that has some passage of the stretch.
    """
    texts = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), text_hash(text_col)).alias("doc"),
        text_of(text_col).cast("binary").alias("text"),
    )
    several = F.col("low") < F.col("high")
    seen = map_batches(texts, suffixes.suffix_batches(False), "prefix long, doc long")
    shared = seen.groupBy("prefix").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where(several).select("prefix")
    shared = store(shared)

    rows = map_batches(texts, suffixes.suffix_batches(True), _ROWS)
    rows = store(maybe_member(rows, [F.col("prefix")], shared, [F.col("prefix")], "_in").where("_in").drop("_in"))
    neighbours = rows.groupBy("prefix").agg(
        F.count("*").alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("id").alias("first_id"),
        (F.min("stretch") == F.max("stretch")).alias("alike"),
    )
    neighbours = store(neighbours.where(several).select("prefix", "n", "first_id", "alike"))
    compared = store(join_facts(rows, neighbours, ["prefix"], "n", "inner"))
    length = suffixes.PASSAGE
    spans = compared.where("alike").select(
        "id", "doc", "start", (F.col("start") + F.col("passages") - 1 + length).alias("stop"), "first_id"
    )

    different = compared.where("NOT alike").select("id", "doc", "start", "stretch", "hashes")
    # One row for each stretch: equal ones have equal passages.
    stretches = different.groupBy("stretch").agg(
        F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("id").alias("first_id"), F.count("*").alias("rows"), F.first("hashes").alias("hashes")
    )
    passages = stretches.select("low", "high", "first_id", "rows", F.explode("hashes").alias("h")).groupBy("h").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("first_id").alias("first_id"), F.sum("rows").alias("n")
    )
    passages = store(passages.where(several).select("h", "n", "first_id"))
    placed = store(different.select("id", "doc", "start", F.posexplode("hashes").alias("i", "h")))
    placed = join_facts(placed, passages, ["h"], "n", "inner").withColumn("start", F.col("start") + F.col("i"))
    spans = spans.unionByName(placed.select("id", "doc", "start", (F.col("start") + length).alias("stop"), "first_id"))
    return _joined(store(spans))


def _joined(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a document as one; a document's spans are as many as its words at most."""
    spans = spans.groupBy("id", "doc", "start").agg(F.max("stop").alias("stop"), F.min("first_id").alias("first_id"))
    in_order = W.partitionBy("doc").orderBy("start")
    reach = F.max("stop").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum("new").over(in_order.rowsBetween(W.unboundedPreceding, 0))
    marked = spans.withColumn("new", (F.col("start") >= F.coalesce(reach, F.lit(0))).cast("int")).withColumn("island", island)
    return marked.groupBy("id", "doc", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first_id").alias("first_id")
    ).drop("island")
