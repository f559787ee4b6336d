"""Connected components by alternating large-star and small-star steps.

Each step points neighbours at the smallest node seen; the table of links never grows and
after a few steps is one star per component.  Nothing of a component is gathered: a node's
smallest neighbour is an aggregate, and nodes with very many links are joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_facts, store


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(u, v)`` but the roots, which are the smallest nodes."""
    edges = store(
        links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        edges = _small_star(_large_star(edges))


def _with_least(edges: DataFrame) -> DataFrame:
    least = store(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    return join_facts(edges, least, ["u"], "n").select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = store(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    return store(_with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return store(_with_least(edges).select(F.inline(pairs)).where("u != v").distinct())
