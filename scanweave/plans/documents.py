"""Report documents.

A report can be as long as a repository has findings, so it is a table of text
blocks, ordered by ``section``, ``part`` and ``block``; joined by line breaks, they
are the report.  Nothing gathers a repository's findings into one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import SEVERITIES
from ..operators.ranking import number_within
from ..schemas import FINDING, SEQ
from .report import (
    cards, category_matrix, owasp_coverage, review_queue, risk_levels, severity_counts, top_findings, top_of_severity,
)

# Marks, headings and closing texts of the report format.
MARK = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🔵", "INFO": "⚪"}
PRACTICES = """
### Standing Advice

By the domains of the rules that were tried:

- `core`: fix one class of findings across the whole repository before taking up the next.
- `secrets`: a value that was ever committed counts as known; replace it, then remove it.
- `code_quality`: give an error handler something to do, or let the error pass on.
- `web`: decide at the entrance of a request who may do what, not in every page.
- `mobile`: take it that an app's files and traffic can be read by whoever holds the device.
- `embedded`: bound every copy and every wait; a device in the field cannot be restarted by hand.
- `pipeline`: give a job only the rights it uses, and name what it runs by digest.
- `ai_ml`: treat what a model says, and the files it is loaded from, as input from outside."""
NOTICE = """Findings come from patterns matched against source lines, so some will be wrong: look at each before acting on it.

**References:**
- [OWASP Top 10 2021](https://owasp.org/Top10/)
- [CWE List](https://cwe.mitre.org/data/index.html)
- [NIST Cybersecurity Framework](https://www.nist.gov/cyberframework)
- [OWASP Mobile Top 10](https://owasp.org/www-project-mobile-top-10/)
- [OWASP IoT Top 10](https://owasp.org/www-project-internet-of-things/)"""

# Sections in report order; the four severity lists take the places from 5 on.
HEADER, SUMMARY, OVERVIEW, MATRIX, LISTS, LISTING, OWASP, ADVICE, FOOTER = 1, 2, 3, 4, 5, 9, 10, 11, 12


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _joined(order: list[str], text: str, sep: str = "\n") -> Column:
    """Aggregate a short list of lines into one text."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text)))
    return F.array_join(F.transform(rows, lambda r: r[text]), sep)


def _ticked(names: Column, empty: str) -> Column:
    listed = F.array_join(F.transform(names, lambda n: _text("`", n, "`")), ", ")
    return F.when(listed == "", F.lit(empty)).otherwise(listed)


def report_blocks(
    profile: DataFrame,
    findings: DataFrame,
    configs: DataFrame | None = None,
    clock: Column | None = None,
    tool: str = "scanweave",
) -> DataFrame:
    """``(repo_id, section, part, block, text)`` for every repository in ``profile``."""
    when = F.date_format(F.current_timestamp() if clock is None else clock, "yyyy-MM-dd HH:mm:ss")
    repos = profile.select("repo_id")
    counts = risk_levels(severity_counts(findings, repos))
    queue = review_queue(findings)

    def section(no: int, rows: DataFrame, text: Column, lead: str = "\n") -> DataFrame:
        return _block(rows, no, F.lit(""), F.lit(0), _text(lead, text))

    blocks = [
        section(HEADER, counts, _header(when, tool), ""),
        section(SUMMARY, counts, _summary()),
        section(OVERVIEW, _with_config(profile, configs), _overview()),
        section(MATRIX, _matrix(findings), F.col("text")),
        *_severity_lists(queue),
        *_listing(queue),
        section(OWASP, _owasp(findings, repos), F.col("text")),
        section(ADVICE, _advice(findings, repos), F.col("text")),
        section(FOOTER, repos, _footer(when, tool)),
    ]
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block)
    return out


def _block(rows: DataFrame, no: int | Column, part: Column, block: Column, text: Column) -> DataFrame:
    no = F.lit(no) if isinstance(no, int) else no
    return rows.select(
        "repo_id", no.cast("int").alias("section"), part.alias("part"), block.cast("bigint").alias("block"), text.alias("text")
    )


def _header(when: Column, tool: str) -> Column:
    return _text(
        "# Security & Code Review Report\n\n> **Project:** `", F.col("repo_id"), "`\n> **Scan Date:** ", when,
        f"\n> **Agent:** {tool}\n> **Total Findings:** ", F.col("total"), "\n\n---",
    )


def _summary() -> Column:
    rows = [x for s in SEVERITIES[:4] for x in (f"| {MARK[s]} {s} | ", F.col(s.lower()), " |\n")]
    urgent = _text(
        "\n\n> ⚠️ **", F.col("critical"), " CRITICAL issue(s) require immediate attention before any deployment.**"
    )
    return _text(
        "## Executive Summary\n\n| Severity | Count |\n|----------|-------|\n", *rows, "| **Total** | **", F.col("total"),
        "** |\n\n**Overall Risk Level: ", F.col("risk_level"), "**",
        F.when(F.col("critical") > 0, urgent).otherwise(F.lit("")),
    )


def _with_config(profile: DataFrame, configs: DataFrame | None) -> DataFrame:
    if configs is None:
        return profile.withColumns(
            {"config_path": F.lit(None).cast("string"), "fail_threshold": F.lit(None).cast("string")}
        )
    return profile.join(configs.select("repo_id", "config_path", "fail_threshold"), "repo_id", "left")


def _overview() -> Column:
    languages = F.transform(
        F.slice("languages", 1, 6), lambda x: _text("`", x["lang"], "` (", x["n"], " files)")
    )
    rows = {
        "Project Name": F.col("repo_id"),
        "Total Files Scanned": F.col("total_files"),
        "Primary Language": _text("`", F.col("primary_language"), "`"),
        "Languages": F.array_join(languages, ", "),
        "Frameworks": _ticked(F.slice("frameworks", 1, 8), "None detected"),
        "Architecture Types": _ticked(F.col("arch_types"), ""),
        "Active Scan Domains": _ticked(F.col("security_domains"), "None"),
        "Skipped Domains": _ticked(F.col("skipped_domains"), "None"),
        "Config": F.coalesce("config_path", F.lit("Default config")),
        "Fail Threshold": _text("`", F.coalesce("fail_threshold", F.lit("CRITICAL")), "`"),
    }
    lines = [x for label, value in rows.items() for x in (f"\n| **{label}** | ", value, " |")]
    return _text("## Project Overview\n\n| Property | Value |\n|----------|-------|", *lines)


def _matrix(findings: DataFrame) -> DataFrame:
    c = F.col
    line = _text(
        "| ", c("category"), " | ", c("critical"), " | ", c("high"), " | ", c("medium"), " | ", c("low"), " | **",
        c("total"), "** |",
    )
    lines = category_matrix(findings).select("repo_id", "category", line.alias("line"))
    head = "## Findings by Category\n\n| Category | Critical | High | Medium | Low | Total |\n|----------|----------|------|--------|-----|-------|\n"
    return lines.groupBy("repo_id").agg(_text(head, _joined(["category"], "line")).alias("text"))


def _severity_lists(queue: DataFrame) -> list[DataFrame]:
    shown = cards(queue).where(F.col("severity") != "INFO").where("rank < 4")
    mark = F.create_map(*[F.lit(x) for pair in MARK.items() for x in pair])
    no = F.col("rank") + F.lit(LISTS)
    heads = shown.select("repo_id", "severity", "rank").distinct()
    title = _text("\n## ", F.element_at(mark, F.col("severity")), " ", F.col("severity"), " Severity Findings\n")
    return [
        _block(heads, no, F.lit(""), F.lit(0), title),
        _block(shown, no, F.lit(""), F.col("ordinal"), F.col("text")),
    ]


def _listing(queue: DataFrame) -> list[DataFrame]:
    mark = F.create_map(*[F.lit(x) for pair in MARK.items() for x in pair])
    c = F.col
    row = _text(
        "| ", F.coalesce(F.element_at(mark, c("severity")), F.lit("")), " ", c("severity"), " | `", c("id"), "` | ",
        c("name"), " | `", c("file"), "` | ", c("line"), " |",
    )
    repos = queue.select("repo_id").distinct()
    categories = queue.select("repo_id", "category").distinct()
    first = categories.groupBy("repo_id").agg(F.min("category").alias("first"))
    titled = categories.join(first, "repo_id")
    gap = F.when(c("category") == c("first"), F.lit("")).otherwise(F.lit("\n"))
    title = _text(
        gap, "### ", c("category"), "\n\n| Severity | ID | Name | File | Line |\n|----------|-----|------|------|------|"
    )
    last = F.lit("\U0010ffff")
    return [
        _block(repos, LISTING, F.lit(""), F.lit(0), F.lit("\n## All Findings by Category\n")),
        _block(titled, LISTING, c("category"), F.lit(0), title),
        _block(queue, LISTING, c("category"), c("position"), row),
        _block(repos, LISTING, last, F.lit(0), F.lit("")),
    ]


def _owasp(findings: DataFrame, repos: DataFrame) -> DataFrame:
    c = F.col
    line = _text("| ", c("owasp"), " | ", c("name"), " | ", c("findings"), " | ", c("status"), " |")
    head = "## OWASP Top 10 (2021) Coverage\n\n| # | Category | Findings | Status |\n|---|----------|----------|--------|\n"
    lines = owasp_coverage(findings, repos).select("repo_id", "owasp", line.alias("line"))
    return lines.groupBy("repo_id").agg(_text(head, _joined(["owasp"], "line")).alias("text"))


def _advice(findings: DataFrame, repos: DataFrame) -> DataFrame:
    c = F.col
    place = [c("id"), "]** `", c("file"), ":", c("line"), "` — ", c("name")]
    now = top_of_severity(findings, "CRITICAL").select("repo_id", "n", _text("- **[", *place, ": ", c("fix"), "...").alias("line"))
    soon = top_of_severity(findings, "HIGH").select("repo_id", "n", _text("- **[", *place).alias("line"))
    now = now.groupBy("repo_id").agg(_joined(["n"], "line").alias("now"))
    soon = soon.groupBy("repo_id").agg(_joined(["n"], "line").alias("soon"))
    none = F.lit("")
    text = _text(
        "## Recommendations\n",
        F.coalesce(_text("\n### Immediate Actions (Before Next Deploy)\n\n", c("now")), none),
        F.coalesce(_text("\n\n### Short-term Actions (This Sprint)\n\n", c("soon")), none),
        "\n", PRACTICES,
    )
    return repos.join(now, "repo_id", "left").join(soon, "repo_id", "left").select("repo_id", text.alias("text"))


def _footer(when: Column, tool: str) -> Column:
    return _text(f"---\n\n## About This Report\n\nGenerated by **{tool}** on ", when, ".\n\n", NOTICE)


def job_summary(profile: DataFrame, findings: DataFrame, tool: str = "scanweave") -> DataFrame:
    """``(repo_id, text)``: the counts and the twenty first findings, a bounded text."""
    c = F.col
    counts = severity_counts(findings, profile)
    line = _text("| ", c("severity"), " | ", c("name"), " | `", c("file"), ":", c("line"), "` |")
    top = top_findings(findings).select("repo_id", "n", line.alias("text_line"))
    top = top.groupBy("repo_id").agg(_joined(["n"], "text_line").alias("top"))
    joined = (
        profile.select("repo_id", "security_domains", "skipped_domains").join(counts, "repo_id").join(top, "repo_id", "left")
    )

    def names(column: str) -> Column:
        listed = F.array_join(column, ", ")
        return F.when(listed == "", F.lit("none")).otherwise(listed)

    rows = [x for s in SEVERITIES for x in (f"\n| {s} | ", c(s.lower()), " |")]
    found = _text("\n\n### Top Findings\n\n| Severity | Finding | Location |\n|---|---|---|\n", c("top"))
    text = _text(
        f"## {tool}\n\nTotal findings: **", c("total"), "**\nActive domains: `", names("security_domains"),
        "`\nSkipped domains: `", names("skipped_domains"), "`\n\n| Severity | Count |\n|---|---:|", *rows,
        F.coalesce(found, F.lit("")), "\n",
    )
    return joined.select("repo_id", text.alias("text"))


def json_blocks(profile: DataFrame, findings: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """The findings document as text blocks ``(repo_id, section, block, text)``; joined
    without separator in that order they are one JSON document per repository."""
    c = F.col
    keep_nulls = {"ignoreNullFields": "false"}
    info = [
        F.col("repo_id").alias("name"), F.map_from_entries("languages").alias("languages"), "primary_language",
        "frameworks", "arch_types", "security_domains", "skipped_domains", "total_files",
    ]
    rows, config = profile, F.lit("{}")
    if configs is not None:
        shown = F.struct(*[n for n in configs.columns if n not in ("repo_id", "ignore_patterns")])
        rows = profile.join(configs.select("repo_id", shown.alias("security_config")), "repo_id", "left")
        info.append("security_config")
        config = F.coalesce(F.to_json("security_config", keep_nulls), F.lit("{}"))
    head = rows.select(
        "repo_id", F.lit(1).alias("section"), F.lit(0).cast("bigint").alias("block"),
        _text('{"project_info":', F.to_json(F.struct(*info), keep_nulls), ',"config":', config, ',"findings":[').alias("text"),
    )
    numbered = number_within(findings, ["repo_id"], SEQ, "block")
    comma = F.when(c("block") == 1, F.lit("")).otherwise(F.lit(","))
    body = numbered.select(
        "repo_id", F.lit(2).alias("section"), "block",
        _text(comma, F.to_json(F.struct(*[n for n in FINDING if n != "repo_id"]))).alias("text"),
    )
    by_severity = F.struct(*[c(s.lower()).alias(s) for s in SEVERITIES])
    tail = severity_counts(findings, profile).select(
        "repo_id", F.lit(3).alias("section"), F.lit(0).cast("bigint").alias("block"),
        _text('],"total":', c("total"), ',"by_severity":', F.to_json(by_severity), "}").alias("text"),
    )
    return head.unionByName(body).unionByName(tail)
