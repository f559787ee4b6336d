"""Tokens of two vocabularies aligned over the bytes of each text, and counts of the links.

Both token sequences of a text are intervals over its bytes.  Sorted by start, with a running
maximum of their ends, they fall into groups: a group breaks where a start reaches that
maximum, which is where both sequences have a token that ends.  Overlaps are expanded inside.
This happens in the text's row; what is stored per text are its distinct id pairs.

Counts of pairs over the corpus are an aggregate.  Back at the texts, the frequent pairs are
broadcast: more than one in 2^18 links, so there are fewer than 2^18 of them however large
the corpus is; the links of all others meet their counts in an ordinary join, where no pair has
more than that share of the rows.  The greatest count per id of B is one number per entry of
the vocabulary.

Defined cases: a null or empty text, and one whose tokens do not spell a blank and the text,
has no tokens: zeros and an empty digest; repeated rows and null ids are rows of their own and
count each time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_spans
from .common import map_batches, ship, store, text_of

FREQUENT = 1 << 18

ship(token_spans)

_KINDS = {
    "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "groups": "string",
    "pairs": "array<long>", "times": "array<int>",
}
SUMMARY = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def aligned(
    docs: DataFrame, vocabulary_a: str, vocabulary_b: str, id_col: str = "doc_id", text_col: str = "text",
    made: list[str] | None = None,
) -> DataFrame:
    """``id`` and the columns ``made``, of those in ``_KINDS``, per row of ``docs``.

    ``groups`` lists the ids of each group, ``a1,a2|b1;a3|b2``; ``pairs`` and ``times`` are the
    distinct id pairs (A times 2^20 plus B) that a link joins, and how many links do.
    """
    made = made or list(_KINDS)
    context = docs.sparkSession.sparkContext
    with open(vocabulary_a, encoding="utf-8") as a, open(vocabulary_b, "rb") as b:
        sources = context.broadcast(a.read()), context.broadcast(b.read())  # vocabularies: a few megabytes
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    schema = ", ".join(["id long", *(f"{name} {_KINDS[name]}" for name in made)])
    return map_batches(texts, token_spans.align_batches(*sources, made), schema)


def _links(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", "l.pairs", "l.times").withColumnRenamed("pairs", "pair")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``(pair, n, best)`` for all pairs of stored rows: links in the corpus, and whether no pair with its id of B has more."""
    counts = store(_links(rows).groupBy("pair").agg(F.sum("times").alias("n")))
    of_b = F.col("pair") % token_spans.PAIR_BASE
    greatest = counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))
    # One row per entry of vocabulary B.
    joined = counts.withColumn("b", of_b).join(F.broadcast(greatest), "b")
    return joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_statistics(docs: DataFrame, vocabulary_a: str, vocabulary_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``SUMMARY``, ``n_best`` and ``count_sum`` per row of ``docs``."""
    made = aligned(docs, vocabulary_a, vocabulary_b, id_col, text_col, [*SUMMARY, "pairs", "times"])
    # Numbers given once and written with the rows: what reads the table finds the same ones.
    rows = store(made.withColumn("row", F.monotonically_increasing_id()))
    counts = store(pair_counts(rows))
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") > max(total // FREQUENT, 1)
    known = _links(rows).join(F.broadcast(counts.where(frequent)), "pair", "left")
    best = F.when(F.col("best"), F.col("times")).otherwise(0)
    sums = [F.sum(best).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    common = known.where("n IS NOT NULL").groupBy("row").agg(*sums)
    rest = known.where("n IS NULL").select("pair", "row", "times").join(counts.where(~frequent), "pair").groupBy("row").agg(*sums)
    both = common.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return rows.drop("pairs", "times").join(both, "row", "left").select("id", *SUMMARY, *filled)
