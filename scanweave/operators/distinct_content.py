"""Each distinct content is matched once, however many paths it has.

What the rules see of a file is its content, the suffixes and names they are bound to, and the
active domains.  Files that agree in these have equal hits.  A narrow pass gives every file a
key of its own content digest and those facts; of each key the file with the smallest place
stands for all.  Representatives are marked where they are by a broadcast filter: only narrow
rows are shuffled, never content.  The filter may let others pass, which costs a match more;
their hits are dropped by an exact join.  Hits return to all paths by a join on the key, in
which keys with very many paths are dealt out over measured shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name, suffix
from ..functions.regex import java_name_pattern
from ..rules.catalog import Rule, builtin_rules
from ..session import materialize
from .matching import scan_lines
from .membership import maybe_member

# A key with more than one in so many files is dealt out; fewer than this many keys can be.
HOT_SHARE = 1024


def content_key(rules: tuple[Rule, ...], active: str | None = None) -> Column:
    """32 hexadecimal digits and the facts that decide which rules see the content."""
    name, ext = file_name(F.col("path")), suffix(file_name(F.col("path")))
    suffixes = sorted({s for r in rules for s in r.suffixes})
    names = sorted({n for r in rules for n in r.names})
    by_name = [r for r in rules if r.file_check]
    checks = [F.rlike(name, F.lit(java_name_pattern(r.pattern))).cast("int").cast("string") for r in by_name]
    seen = [F.when(of.isin(bound), of).otherwise("") for of, bound in ((ext, suffixes), (name, names)) if bound]
    bits = [F.col(active).cast("string")] if active else []
    digest = F.substring(F.sha2(F.coalesce("content", F.lit("")), 256), 1, 32)
    known = F.col("content").isNotNull().cast("string")  # a file that could not be read is not an empty one
    return F.concat_ws("/", digest, known, *seen, *checks, *bits)


def scan_distinct(
    files: DataFrame, rules: tuple[Rule, ...] | None = None, active: str | None = None, max_line_chars: int | None = None, multiline: bool = False
) -> DataFrame:
    """The rows of :func:`~scanweave.operators.matching.scan_lines`, each distinct content matched once.

    ``files(repo_id, path, content)`` is a stored table: it is read twice, once for the digests.
    Repeated rows give their hits as often as they occur, null paths none.
    """
    rules = builtin_rules() if rules is None else rules
    keyed = files.withColumn("key", content_key(rules, active))
    paths = materialize(keyed.where("path IS NOT NULL").select("key", "repo_id", "path"))
    groups = materialize(paths.groupBy("key").agg(F.min(F.struct("repo_id", "path")).alias("first"), F.count("*").alias("n")))
    firsts = groups.select(F.col("first.repo_id").alias("repo_id"), F.col("first.path").alias("path"), "key")
    same = [F.col("key"), F.coalesce("repo_id", F.lit("")), F.col("path")]
    marked = maybe_member(keyed, same, firsts, same, "_first").where("_first")
    keep = ["repo_id", "path", "key"]
    found = materialize(scan_lines(marked.drop("_first"), rules, keep, max_line_chars=max_line_chars, multiline=multiline, active=active))
    hit = ["rule_no", "line", "code", "context"]
    # One representative per key, even if its row is repeated or its path has two contents.
    exact = found.join(firsts.withColumnsRenamed({"repo_id": "f_repo", "path": "f_path"}), "key")
    exact = exact.where(F.col("repo_id").eqNullSafe(F.col("f_repo")) & (F.col("path") == F.col("f_path")))
    per_key = materialize(exact.select("key", *hit).dropDuplicates(["key", "rule_no", "line"]))
    return _to_paths(paths, groups, per_key).select("repo_id", "path", *hit)


def _to_paths(paths: DataFrame, groups: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits at all paths of their key; a key's paths are dealt out if they are more than a share of all."""
    total, most = groups.agg(F.sum("n"), F.max("n")).first()
    share = max((total or 0) // HOT_SHARE, 1)
    hot = groups.where(F.col("n") > share).select("key")
    if not most or most <= share:
        return paths.join(hits, "key")
    deals = -(-most // share)  # at most HOT_SHARE and one
    hot = F.broadcast(hot)  # fewer than HOT_SHARE rows
    dealt = paths.join(hot, "key").withColumn("_deal", F.pmod(F.xxhash64("repo_id", "path"), F.lit(deals)))
    spread = hits.join(hot, "key").withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(deals - 1).cast("bigint"))))
    rest = paths.join(hot, "key", "left_anti").join(hits, "key")
    return rest.unionByName(dealt.join(spread, ["key", "_deal"]).drop("_deal"))
