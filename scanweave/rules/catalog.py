"""The rule catalogue: built-in rules, user rules, validation."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..functions.ambiguity import slow_pattern
from ..functions.regex import java_line_pattern, java_name_pattern
from ..functions.severity import SEVERITIES
from ..schemas import REJECTED, RULES as RULES_SCHEMA
from .secrets import SECRET_RULES
from .table import RULES
from .texts import TEXTS

# Domain order decides rule order.
CORE_DOMAINS = ["core", "secrets", "code_quality"]
OPTIONAL_DOMAINS = ["web", "mobile", "embedded", "pipeline", "ai_ml"]
DOMAINS = CORE_DOMAINS + OPTIONAL_DOMAINS


@dataclass(frozen=True)
class Rule:
    rule_id: str
    domain: str
    category: str
    name: str
    severity: str
    pattern: str
    negative_pattern: str | None
    description: str
    fix: str
    langs: tuple[str, ...] | None  # None: every file; empty: no file
    owasp: str = ""
    cwe: str = ""
    file_check: bool = False

    @property
    def suffixes(self) -> list[str]:
        return [x for x in self.langs or () if x.startswith(".")]

    @property
    def names(self) -> list[str]:
        return [x for x in self.langs or () if not x.startswith(".")]


@lru_cache(maxsize=1)
def builtin_rules() -> tuple[Rule, ...]:
    """All built-in rules in rule order."""
    groups = {**RULES, "secrets": SECRET_RULES}
    return tuple(_from_row(domain, row) for domain in DOMAINS for row in groups[domain])


def _from_row(domain: str, row: tuple) -> Rule:
    rule_id, severity, category, name, owasp, cwe, langs, pattern, negative, *file_check = row
    description, fix = TEXTS[rule_id]
    return Rule(
        rule_id, domain, category, name, severity, pattern, negative, description, fix,
        None if langs == "all" else tuple(langs.split()), owasp, cwe, bool(file_check),
    )


def merge_rules(spark: SparkSession, extra: list[dict], base: tuple[Rule, ...] | None = None):
    """Add user rules to the catalogue.

    ``extra`` holds dicts with the columns of the rules table.  Returns the merged
    rules and a DataFrame of the rejected ones: missing fields, an unknown domain or
    severity, suffixes that are no list, an id already taken, a pattern that one of the two regex engines
    refuses, or one that takes exponential or high polynomial time on some lines.
    """
    rules, rejected = list(builtin_rules() if base is None else base), []
    taken = {r.rule_id for r in rules}
    for i, row in enumerate(extra):
        rule, reason = _read(row)
        reason = reason or _bad_pattern(spark, rule)
        if not reason and rule.rule_id in taken:
            reason = "id already in use"
        if reason:
            rejected.append((i, str(row.get("rule_id", "")), reason))
        else:
            taken.add(rule.rule_id)
            rules.append(rule)
    ordered = sorted(rules, key=lambda r: DOMAINS.index(r.domain))
    return tuple(ordered), spark.createDataFrame(rejected, REJECTED)


def _read(row: dict):
    need = ("rule_id", "domain", "category", "name", "severity", "pattern", "description", "fix")
    missing = [k for k in need if not row.get(k)]
    if missing:
        return None, "missing " + ", ".join(missing)
    if row["domain"] not in DOMAINS:
        return None, f"unknown domain {row['domain']}"
    if row["severity"] not in SEVERITIES:
        return None, f"unknown severity {row['severity']}"
    langs = row.get("langs", "all")
    if langs not in ("all", None) and (isinstance(langs, str) or not all(isinstance(x, str) and x for x in langs)):
        return None, "langs is not a list of suffixes and file names"
    return Rule(
        **{k: row[k] for k in need},
        negative_pattern=row.get("negative_pattern"),
        langs=None if langs in ("all", None) else tuple(langs),
        owasp=row.get("owasp") or "",
        cwe=row.get("cwe") or "",
        file_check=bool(row.get("file_check")),
    ), None


def _bad_pattern(spark: SparkSession, rule: Rule | None) -> str | None:
    if rule is None:
        return None
    for pattern in filter(None, (rule.pattern, rule.negative_pattern)):
        try:
            re.compile(pattern, re.IGNORECASE | re.MULTILINE)
            jvm = java_name_pattern(pattern) if rule.file_check else java_line_pattern(pattern)
            spark._jvm.java.util.regex.Pattern.compile(jvm)
        except re.error as error:
            return f"bad pattern: {error}"
        except (Py4JJavaError, PySparkException) as error:
            return f"pattern not portable: {str(error).splitlines()[0]}"
        slow = slow_pattern(pattern)
        if slow:
            return f"slow pattern: {slow}"
    return None


def rules_frame(spark: SparkSession, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """The rules as a dimension table, one row each, numbered in rule order."""
    rows = [
        (
            r.rule_id, r.domain, r.category, r.name, r.severity, r.pattern, r.negative_pattern, r.description,
            r.fix, list(r.langs) if r.langs is not None else None, r.owasp, r.cwe, r.file_check, i,
        )
        for i, r in enumerate(builtin_rules() if rules is None else rules)
    ]
    return spark.createDataFrame(rows, RULES_SCHEMA)
