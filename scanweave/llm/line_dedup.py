"""Line deduplication: exact copies, and lines within one word edit, by a deletion neighbourhood.

Lines are sequences of words between white space.  Of equal lines the earliest stays, by
document id, then line.  A line of ``MIN_WORDS`` or more is also dropped if an earlier one
is within one word inserted, deleted or replaced (so at least 0.8 of the words agree).

Every line emits itself and all lines left by deleting one word, as hashes.  Lines that
share such a hash at the same place differ in the word there; a line that equals what
another leaves has one word less.  The earliest line of each shared hash is an aggregate, so
a passage in a third of all lines costs what any other does, and no pairs are listed.  The
chosen links are verified on the texts.

So that lines without any partner emit nothing, only distinct lines that share a half with
another, as two lines within one edit do, take part; this loses no link.

Defined cases: a null text has no lines; lines without words are kept and never compared;
null ids come last; rows that share id and text are one row, so their lines are no copies of
each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import line_hashes
from .common import join_facts, map_batches, maybe_member, packed, ship, store, text_hash, text_of

MIN_WORDS = 5

ship(line_hashes)

_HALVES = ["half1", "half2", "half3"]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("hash"), text_of(text_col).cast("binary").alias("text")
    )


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "hash", "line")


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored rows of all lines, without their texts."""
    schema = "id long, hash long, line int, words int, h long, half1 long, half2 long, half3 long"
    return store(map_batches(_texts(docs, id_col, text_col), line_hashes.line_batches, schema))


def near_links(docs: DataFrame, distinct: DataFrame, text_col: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """``(h, first)``: distinct lines with an earlier line within one edit, and the place of the earliest."""
    halves = store(distinct.where(F.col("words") >= least - 1).select("h", F.explode(F.array(*_HALVES)).alias("half")).distinct())
    shared = store(halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1"))
    some = store(join_facts(halves, shared, ["half"], "n", "inner").select("h").distinct())

    texts = docs.where(F.col(text_col).isNotNull()).select(text_of(text_col).cast("binary").alias("text"))
    lines = map_batches(texts, line_hashes.text_batches(least - 1), "h long, text binary")
    lines = maybe_member(lines, [F.col("h")], some, [F.col("h")], "_in").where("_in").groupBy("h").agg(F.first("text").alias("text"))
    lines = store(lines.join(distinct.select("h", "first"), "h"))

    variants = map_batches(lines.select("h", "text"), line_hashes.variant_batches(least), "key long, deleted int, h long")
    again = store(variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    variants = maybe_member(variants, [F.col("key")], again, [F.col("key")], "_in").where("_in").drop("_in")
    variants = store(variants.join(lines.select("h", "first"), "h"))

    whole = F.col("deleted") < 0
    by_key = variants.groupBy("key").agg(
        F.count("*").alias("n"), F.min(F.when(whole, F.col("first"))).alias("shorter"), F.min(F.when(~whole, F.col("first"))).alias("longer")
    )
    by_place = variants.where(~whole).groupBy("key", "deleted").agg(F.count("*").alias("n"), F.min("first").alias("replaced"))
    inserted = join_facts(variants, store(by_key.where("shorter IS NOT NULL AND longer IS NOT NULL")), ["key"], "n", "inner")
    inserted = inserted.select("h", "first", F.when(whole, F.col("longer")).otherwise(F.col("shorter")).alias("other"))
    replaced = join_facts(variants.where(~whole), store(by_place.where("n > 1")), ["key", "deleted"], "n", "inner")
    replaced = replaced.select("h", "first", F.col("replaced").alias("other"))
    earlier = inserted.unionByName(replaced).where("other < first").groupBy("h").agg(F.min("other").alias("other"))

    partner = lines.select(F.col("first").alias("other"), F.col("text").alias("b"))
    pairs = store(earlier).join(partner, "other").join(lines.select("h", F.col("text").alias("a")), "h")
    pairs = pairs.select("h", F.col("other").alias("first"), "a", "b")
    schema = "h long, first struct<no_id: boolean, id: long, hash: long, line: int>"
    return store(map_batches(pairs, line_hashes.verified_batches, schema))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: DataFrame | None = None) -> DataFrame:
    """``(id, hash of the text, line, kind, first_id, first_line)`` of every line to drop."""
    lines = line_rows(docs, id_col, text_col) if lines is None else lines
    distinct = store(
        lines.where("words > 0").withColumn("place", _place()).groupBy("h").agg(
            F.min("place").alias("first"), F.count("*").alias("n"), F.min("words").alias("words"), *[F.min(c).alias(c) for c in _HALVES]
        )
    )
    near = near_links(docs, distinct, text_col).withColumnRenamed("first", "near")
    facts = distinct.select("h", "first", "n").join(near, "h", "left").where("n > 1 OR near IS NOT NULL")
    known = join_facts(lines.where("words > 0").select("id", "hash", "line", "h"), store(facts), ["h"], "n", "inner")
    copy = _place() != F.col("first")
    kept = F.when(copy, F.col("first")).otherwise(F.col("near"))
    return known.where(copy | F.col("near").isNotNull()).select(
        "id", "hash", "line", F.when(copy, "exact").otherwise("near").alias("kind"), kept["id"].alias("first_id"), kept["line"].alias("first_line")
    )


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text of every row rewritten without its dropped lines."""
    dropped = dropped_lines(docs, id_col, text_col).groupBy("id", "hash").agg(F.collect_set("line").alias("lines"))
    dropped = store(dropped)
    rows = packed(docs, _id=F.col(id_col).cast("long"), _hash=text_hash(text_col))
    same = rows["_id"].eqNullSafe(dropped["id"]) & (rows["_hash"] == dropped["hash"])
    text = F.array_join(
        F.filter(F.split(F.col(f"_row.{text_col}"), "\n"), lambda _, i: ~F.array_contains(F.coalesce("lines", F.array().cast("array<int>")), i)), "\n"
    )
    return rows.join(dropped, same, "left").select(F.col("_row").withField(text_col, text).alias("_row")).select("_row.*")
