"""Near-duplicates by SimHash, with links found through a Golay code.

A fingerprint is cut into four segments.  A key is one whole segment and one of the one to
six codewords near the next segment; two fingerprints within 3 bits share a key.  Equal
fingerprints are one node.  Nodes that share a key meet in one group, their distances are
compared, and only links that connect something leave the task.  A key with more than 4096
nodes is cut into blocks, and every pair of blocks is a group of its own.

Defined cases: a null text counts as empty; a text without words has fingerprint 0 and is
linked like any other; rows with a null id connect nothing, and belong to the component of
the rows with their fingerprint, to none (null) if there is no such row; a repeated row
gives its result again; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fingerprints, golay
from .common import join_facts, map_batches, maybe_member, packed, ship, store, text_hash, text_of, without
from .components import connected_components

BLOCK = 4096

ship(fingerprints)


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, hash of the text, fp)`` of every row, as a stored table."""
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("text"), text_hash(text_col).alias("hash")
    )
    return store(map_batches(texts, fingerprints.fingerprint_batches, "id long, hash long, fp long"))


def fingerprint_links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links ``(u, v)`` that connect what is within 3 bits among ``nodes(node, fp)``."""
    codewords = golay.segment_keys(fingerprints.SEGMENT_BITS)
    keyed = map_batches(nodes.select("node", "fp"), fingerprints.key_batches(codewords), "key long, node long, fp long")
    heavy = store(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block))
    whole = [F.lit(0).alias("a"), F.lit(0).alias("b")]
    if heavy.isEmpty():
        grouped = keyed.select("key", *whole, "node", "fp")
    else:
        marked = maybe_member(keyed, [F.col("key")], heavy, [F.col("key")], "_heavy")
        large = join_facts(store(marked.where("_heavy").drop("_heavy")), heavy, ["key"], "n")
        blocks = F.ceil(F.coalesce("n", F.lit(1)) / block)
        own = F.pmod(F.xxhash64("fp"), blocks)
        large = large.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        large = large.select(
            "key", F.least("_own", "_other").cast("int").alias("a"), F.greatest("_own", "_other").cast("int").alias("b"), "node", "fp"
        )
        grouped = marked.where("NOT _heavy").select("key", *whole, "node", "fp").unionByName(large)
    together = grouped.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "fp")
    return map_batches(together, fingerprints.link_batches, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``hash``, ``fp`` and ``component_id``, the smallest id of its component."""
    prints = fingerprint_rows(docs, id_col, text_col)
    nodes = store(prints.groupBy("fp").agg(F.min("id").alias("node"), F.count("*").alias("n")))
    roots = connected_components(fingerprint_links(nodes.where("node IS NOT NULL")))
    known = nodes.join(roots, "node", "left").select("fp", "n", F.coalesce("root", "node").alias("component_id"))
    return join_facts(prints, store(known), ["fp"], "n").select("id", "hash", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id.

    Rows without an id stay.  Of rows that share this id, those with the smallest text hash
    stay; if they are repeated, one of them.
    """
    found = store(near_duplicates(docs, id_col, text_col).where("id IS NOT NULL"))
    leads = F.col("id") == F.col("component_id")
    leaders = found.where(leads).groupBy("id").agg(F.min("hash").alias("hash"), F.count("*").alias("n"))
    dropped = store(found.select("id", "hash").distinct().join(leaders, ["id", "hash"], "left_anti"))
    kept = without(docs, dropped, id_col, text_col)
    again = store(leaders.where("n > 1").select("id", "hash"))
    if again.isEmpty():
        return kept
    repeated = packed(kept, _id=F.col(id_col).cast("long")).join(again, F.col("_id") == F.col("id"))
    return without(kept, again, id_col, text_col).unionByName(repeated.dropDuplicates(["id"]).select("_row.*"))
