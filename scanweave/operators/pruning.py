"""What need not be matched: domains a repository has switched off, and files it ignores.

Both are known from paths and settings, before any content is read.  Per repository they are
one narrow row, a bit per active domain and a pattern of ignored paths, which is broadcast if
its measured size allows; beyond that, files are matched against all rules, and the filters
after the match decide alone, as they do in any case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules.catalog import CORE_DOMAINS, DOMAINS
from ..session import materialize
from .file_filters import ignore_patterns

# Rows and bytes of text up to which facts are broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1 << 18, 32 << 20
ALL_DOMAINS = (1 << len(DOMAINS)) - 1


def active_masks(facts: DataFrame, ignores: DataFrame | None = None) -> DataFrame:
    """``(repo_id, mask, _ignored)`` from profiles ``(repo_id, security_domains)`` and ignore globs.

    A repository without any domain is scanned with the core ones.
    """
    core = sum(1 << DOMAINS.index(d) for d in CORE_DOMAINS)
    listed = " | ".join(f"IF(array_contains(security_domains, '{d}'), {1 << i}L, 0L)" for i, d in enumerate(DOMAINS))
    masks = facts.select("repo_id", F.expr(f"IF(size(security_domains) > 0, {listed}, {core}L)").alias("mask"))
    if ignores is None:
        return masks.withColumn("_ignored", F.lit(None).cast("string"))
    return masks.join(ignore_patterns(ignores), "repo_id", "left")


def with_active(
    files: DataFrame, facts: DataFrame, ignores: DataFrame | None = None, max_rows: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Add ``active``: the domains whose rules are to be tried on a file, none for an ignored one."""
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    max_bytes = BROADCAST_BYTES if max_bytes is None else max_bytes
    masks = materialize(active_masks(facts, ignores))
    rows, bytes_, patterns = masks.agg(
        F.count("*"), F.sum(F.octet_length("repo_id") + 16), F.sum(F.coalesce(F.octet_length("_ignored"), F.lit(0)))
    ).first()
    if rows > max_rows or (bytes_ or 0) > max_bytes:
        return files.withColumn("active", F.lit(ALL_DOMAINS).cast("bigint"))
    if (patterns or 0) > max_bytes:
        masks = masks.withColumn("_ignored", F.lit(None).cast("string"))
    known = files.join(F.broadcast(masks), "repo_id", "left")  # measured above
    ignored = F.coalesce(F.rlike("path", F.col("_ignored")), F.lit(False))
    active = F.when(ignored, 0).otherwise(F.coalesce("mask", F.lit(ALL_DOMAINS))).cast("bigint")
    return known.withColumn("active", active).drop("mask", "_ignored")
