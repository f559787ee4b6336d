"""Report tables: every section of a report is an aggregate or a list over findings.

All functions take the findings of many repositories; materialise them first when
several sections are wanted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import SEVERITIES, cwe_link, severity_rank
from ..operators.ranking import first_rows, number_within
from ..schemas import FINDING, SEQ

# The OWASP Top 10 of 2021.
OWASP_TOP_10 = {
    "A01:2021": "Broken Access Control",
    "A02:2021": "Cryptographic Failures",
    "A03:2021": "Injection",
    "A04:2021": "Insecure Design",
    "A05:2021": "Security Misconfiguration",
    "A06:2021": "Vulnerable and Outdated Components",
    "A07:2021": "Identification and Authentication Failures",
    "A08:2021": "Software and Data Integrity Failures",
    "A09:2021": "Security Logging and Monitoring Failures",
    "A10:2021": "Server-Side Request Forgery (SSRF)",
}


def _counts(weight: str | None = None) -> list[Column]:
    """Findings per severity; ``weight`` names a column that says how many a row stands for."""
    of = lambda s: F.col("severity") == s
    if weight is None:
        return [F.count_if(of(s)).alias(s.lower()) for s in SEVERITIES]
    return [F.sum(F.when(of(s), F.col(weight)).otherwise(0)).alias(s.lower()) for s in SEVERITIES]


def _count(weight: str | None = None) -> Column:
    return F.count("*") if weight is None else F.sum(weight)


def severity_counts(findings: DataFrame, repos: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """Findings per repository and severity, as columns, and their total.  With
    ``repos``, repositories without findings are listed too."""
    counted = findings.groupBy("repo_id").agg(*_counts(weight), _count(weight).alias("total"))
    if repos is None:
        return counted
    return repos.select("repo_id").join(counted, "repo_id", "left").na.fill(0)


def risk_levels(counts: DataFrame) -> DataFrame:
    level = (
        F.when(F.col("critical") > 0, "CRITICAL")
        .when(F.col("high") > 3, "HIGH")
        .when((F.col("high") > 0) | (F.col("medium") > 5), "MEDIUM")
        .otherwise("LOW")
    )
    return counts.withColumn("risk_level", level)


def category_matrix(findings: DataFrame, weight: str | None = None) -> DataFrame:
    """Category by severity; the total leaves INFO out."""
    levels = [s.lower() for s in SEVERITIES[:4]]
    counted = findings.groupBy("repo_id", "category").agg(*_counts(weight)).drop("info")
    return counted.withColumn("total", reduce(lambda a, b: a + b, map(F.col, levels)))


def owasp_coverage(findings: DataFrame, repos: DataFrame, weight: str | None = None) -> DataFrame:
    """Findings per repository and OWASP class, classes without findings included."""
    classes = F.array(*[F.struct(F.lit(k).alias("owasp"), F.lit(v).alias("name")) for k, v in OWASP_TOP_10.items()])
    grid = repos.select("repo_id", F.inline(classes))
    counted = findings.where(F.col("owasp") != "").groupBy("repo_id", "owasp").agg(_count(weight).alias("c"))
    n = F.coalesce("c", F.lit(0))
    status = F.when(n > 0, F.concat(F.lit("⚠️ "), n.cast("string"), F.lit(" issue(s) found")))
    return grid.join(counted, ["repo_id", "owasp"], "left").select(
        "repo_id", "owasp", "name", n.alias("findings"), status.otherwise(F.lit("✅ No issues detected")).alias("status")
    )


def by_rank() -> list[Column]:
    return [severity_rank(F.col("severity")), *map(F.col, SEQ)]


def top_of_severity(findings: DataFrame, severity: str, k: int = 10) -> DataFrame:
    """The first findings of one severity in output order, their fixes cut short."""
    rows = findings.where(F.col("severity") == severity)
    rows = first_rows(rows, ["repo_id"], SEQ, k, "n")
    return rows.select("repo_id", "n", "id", "file", "line", "name", F.substring("fix", 1, 100).alias("fix"))


def top_findings(findings: DataFrame, k: int = 20) -> DataFrame:
    """The first findings by severity, then output order."""
    return first_rows(findings, ["repo_id"], by_rank(), k, "n").select(
        "repo_id", "n", "severity", "name", "file", "line"
    )


def review_queue(findings: DataFrame) -> DataFrame:
    """All findings, numbered i of N per repository, highest severity first, and
    numbered within their severity."""
    ranked = findings.withColumn("rank", severity_rank(F.col("severity")))
    sizes = findings.groupBy("repo_id").agg(*_counts(), F.count("*").alias("total"))
    before, higher = F.lit(0), F.lit(0)
    for i, s in enumerate(SEVERITIES):
        before = F.when(F.col("rank") == i, higher).otherwise(before)
        higher = higher + F.col(s.lower())
    before = F.when(F.col("rank") > 4, higher).otherwise(before)
    numbered = number_within(ranked, ["repo_id"], ["rank", *SEQ], "position", sizes)
    return numbered.withColumn("ordinal", F.col("position") - before).select(
        *FINDING, *[c for c in SEQ if c not in FINDING], "rank", "position", "total", "ordinal"
    )


def gate(counts: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Pass or fail per repository: does it have findings at or above its threshold?

    ``counts`` comes from :func:`severity_counts`.  An unknown threshold counts as
    CRITICAL."""
    if configs is not None:
        counts = counts.join(configs.select("repo_id", "fail_threshold"), "repo_id", "left")
    else:
        counts = counts.withColumn("fail_threshold", F.lit(None).cast("string"))
    counts = counts.withColumn("fail_threshold", F.coalesce("fail_threshold", F.lit("CRITICAL")))
    limit = severity_rank(F.col("fail_threshold"), unknown=0)
    parts = [
        F.when((F.col(s.lower()) > 0) & (F.lit(i) <= limit), F.concat(F.col(s.lower()).cast("string"), F.lit(f" {s}")))
        for i, s in enumerate(SEVERITIES)
    ]
    details = F.array_join(F.array(*parts), ", ")
    message = F.concat(F.lit("Security gate failed at "), F.col("fail_threshold"), F.lit(": "), details)
    return counts.select(
        "repo_id",
        "fail_threshold",
        (details == "").alias("passed"),
        F.when(details == "", F.lit("")).otherwise(message).alias("details"),
    )


def cards(queue: DataFrame) -> DataFrame:
    """One text block per finding, from :func:`review_queue`."""
    row = lambda label, value: F.concat(F.lit(f"\n| **{label}** | "), value, F.lit(" |"))
    tick = F.lit("`")
    place = F.concat(tick, "file", F.lit(":"), F.col("line").cast("string"), tick)
    link = F.concat(F.lit("["), "cwe", F.lit("]("), cwe_link(F.col("cwe")), F.lit(")"))
    none = F.lit("")
    text = F.concat(
        F.lit("### "), F.col("ordinal").cast("string"), F.lit(". "), F.col("name"),
        F.lit("\n\n| Field | Value |\n|-------|-------|"),
        row("ID", F.concat(tick, "id", tick)), row("File", place), row("Category", F.col("category")),
        F.when(F.col("cwe") != "", row("CWE", link)).otherwise(none),
        F.when(F.col("owasp") != "", row("OWASP", F.col("owasp"))).otherwise(none),
        F.lit("\n\n**Description:**\n"), F.col("description"),
        F.lit("\n\n**Vulnerable Code:**\n```\n"), F.col("context"),
        F.lit("\n```\n\n**Remediation:**\n"), F.col("fix"), F.lit("\n\n---"),
    )
    return queue.select("repo_id", "severity", "ordinal", "rank", text.alias("text"))


def category_listing(findings: DataFrame) -> DataFrame:
    """Findings under their category, most severe first: one row each, with a
    ``position`` that grows in that order within the repository."""
    queue = review_queue(findings)
    return queue.select("repo_id", "category", "position", "severity", "id", "name", "file", "line")
