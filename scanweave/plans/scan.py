"""The whole scan: files in, profile and findings out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.file_filters import not_ignored, project_files, scannable
from ..operators.matching import PARITY_LINE_CHARS, scan_lines
from ..operators.profile import profile as build_profile
from ..operators.pruning import with_active
from ..operators.suppression import active_findings, at_least, drop_accepted, first_of_each
from ..rules.catalog import CORE_DOMAINS, Rule, builtin_rules, rules_frame
from ..session import configure, deal_splits, materialize
from ..sources.audits import audit_findings, selected_audits


@dataclass(frozen=True)
class Scan:
    profile: DataFrame
    findings: DataFrame


def scan(
    files: DataFrame,
    rules: tuple[Rule, ...] | None = None,
    configs: DataFrame | None = None,
    ignores: DataFrame | None = None,
    parity: bool = False,
    max_line_chars: int | None = None,
    max_file_bytes: int | None = None,
    multiline: bool = False,
) -> Scan:
    """Profile every repository and match the rules of its active domains.

    The content is read once, by the matching, which is a narrow pass, and the hits are
    written to the shared folder: nothing after that repeats the pass, whatever fails.
    What domains and ignore lists rule out is not matched; they are applied to the hits too, which
    are small, and so is deduplication: the corpus itself is never shuffled.  Everything is scanned; the limits leave out
    longer lines and larger files, and ``parity`` sets both to 2000 and 500,000.
    ``multiline`` also matches the rules written for several lines, which are silent
    otherwise; with ``parity`` they stay silent.
    """
    deal_splits(configure(files.sparkSession))
    rules = builtin_rules() if rules is None else rules
    # One row per repository, used by the findings and by every report.
    about = materialize(build_profile(files, configs))
    if parity and max_line_chars is None:
        max_line_chars = PARITY_LINE_CHARS
    scanned = project_files(files).where(scannable(F.col("path"), F.col("size"), parity, max_file_bytes))
    # Rules of inactive domains are not tried, and ignored files not looked at.
    scanned = with_active(scanned, about, ignores)
    found = scan_lines(scanned, rules, max_line_chars=max_line_chars, multiline=multiline and not parity, active="active")
    hits = first_of_each(materialize(found))
    if ignores is not None:
        hits = not_ignored(hits, ignores)
    # A repository left without any domain is scanned with the core ones.
    domains = F.when(F.size("security_domains") > 0, F.col("security_domains")).otherwise(F.array(*map(F.lit, CORE_DOMAINS)))
    facts = about.withColumn("security_domains", domains)
    # The rules' texts are attached last, so they are not carried through the joins.
    findings = active_findings(hits, rules_frame(files.sparkSession, rules), facts)
    return Scan(about, findings)


def full_scan(
    files: DataFrame,
    rules: tuple[Rule, ...] | None = None,
    configs: DataFrame | None = None,
    ignores: DataFrame | None = None,
    audits: DataFrame | None = None,
    baseline: DataFrame | None = None,
    severity: str = "LOW",
    multiline: bool = False,
) -> Scan:
    """The scan, plus dependency findings, minus accepted and less severe findings."""
    static = scan(files, rules, configs, ignores, multiline=multiline)
    findings = static.findings
    if audits is not None:
        # Stored: the findings of every tool read them, and none of these repeats the selection.
        findings = findings.unionByName(audit_findings(materialize(selected_audits(audits, configs, files))))
    if baseline is not None:
        findings = drop_accepted(findings, baseline)
    return Scan(static.profile, at_least(findings, severity))
