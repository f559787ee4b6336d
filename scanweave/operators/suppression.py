"""Joins of hits with what is known per repository, and the filters on findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.severity import SEVERITIES, finding_key, severity_rank
from ..schemas import FINDING, SEQ

# One repository may hold a large part of all rows, so its rows are dealt out over
# this many join keys; the narrow per-repository side is repeated as often.
SALTS = 32
# Fixed value: the rule that reports missing tests.
MISSING_TESTS = "CQ-050"


def join_repo_facts(rows: DataFrame, facts: DataFrame, spread_by: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join rows with one-row-per-repository facts without gathering a repository."""
    salted = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.hash(*spread_by), F.lit(salts)))
    return dealt.join(salted, ["repo_id", "_salt"], how).drop("_salt")


def active_findings(hits: DataFrame, rules: DataFrame, facts: DataFrame, *extra: str) -> DataFrame:
    """Hits of rules whose domain is active in the repository, as findings.

    ``facts`` has ``repo_id, security_domains, has_tests``.  The rules are a fixed
    list that is part of the plan, hence the broadcast.
    """
    known = join_repo_facts(hits, facts.select("repo_id", "security_domains", "has_tests"), ["path", "line"])
    described = known.join(F.broadcast(rules), known["rule_no"] == rules["rule_order"])
    untested = ~((F.col("rule_id") == MISSING_TESTS) & F.col("has_tests"))
    return as_findings(described.where(F.expr("array_contains(security_domains, domain)") & untested), *extra)


def as_findings(described: DataFrame, *extra: str) -> DataFrame:
    return described.withColumnsRenamed({"rule_id": "id", "path": "file"}).withColumns(
        {"phase": F.lit(0), "item_no": F.lit(0).cast("bigint")}
    ).select(*extra, *FINDING, *[c for c in SEQ if c not in FINDING])


def first_of_each(hits: DataFrame) -> DataFrame:
    """One hit per rule, file and line; of different contents the smallest.

    A file handed in several times gives equal hits.  They are merged before the
    shuffle, so any number of copies costs little."""
    kept = hits.groupBy("repo_id", "path", "rule_no", "line").agg(F.min(F.struct("code", "context")).alias("f"))
    return kept.select("repo_id", "path", "rule_no", "line", "f.code", "f.context")


def drop_ignored(hits: DataFrame, ignored: DataFrame) -> DataFrame:
    """Remove hits in ignored files; ``ignored`` is ``(repo_id, path)``."""
    return hits.join(ignored, ["repo_id", "path"], "left_anti")


def _keyed(findings: DataFrame) -> DataFrame:
    return findings.withColumn("finding_key", finding_key(F.col("id"), F.col("file"), F.col("line")))


def drop_accepted(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    keys = baseline.select("repo_id", "finding_key")
    return _keyed(findings).join(keys, ["repo_id", "finding_key"], "left_anti").select(findings.columns)


def accepted_counts(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """``(repo_id, suppressed)``: how many findings the baseline takes out."""
    keys = baseline.select("repo_id", "finding_key")
    return _keyed(findings).join(keys, ["repo_id", "finding_key"], "left_semi").groupBy("repo_id").agg(
        F.count("*").alias("suppressed")
    )


def at_least(findings: DataFrame, severity: str = "LOW") -> DataFrame:
    """Findings of the given severity or a higher one; unknown severities are dropped."""
    limit = SEVERITIES.index(severity) if severity in SEVERITIES else 3
    return findings.where(severity_rank(F.col("severity")) <= limit)
