"""Severity order, finding keys and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity order, and the spellings audit tools use.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
AUDIT_SEVERITY = {"critical": "CRITICAL", "high": "HIGH", "moderate": "MEDIUM", "medium": "MEDIUM", "low": "LOW"}


def severity_rank(severity: Column, unknown: int = 5) -> Column:
    rank = F
    for i, name in enumerate(SEVERITIES):
        rank = rank.when(severity == name, F.lit(i))
    return rank.otherwise(F.lit(unknown))


def audit_severity(value: Column) -> Column:
    out = F
    for spelled, name in AUDIT_SEVERITY.items():
        out = out.when(F.lower(value) == spelled, F.lit(name))
    return out.otherwise(F.lit("HIGH"))


def finding_key(rule_id: Column, file: Column, line: Column) -> Column:
    return F.concat_ws(":", rule_id, file, line.cast("string"))


def cwe_link(cwe: Column) -> Column:
    number = F.replace(cwe, F.lit("CWE-"), F.lit(""))
    return F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), number, F.lit(".html"))
