import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scanweave.functions.severity import audit_severity, severity_rank
from scanweave.operators.ranking import first_rows, number_within
from scanweave.operators.suppression import join_repo_facts
from scanweave.plans import documents, report, sinks
from scanweave.schemas import AUDIT_RAW, SEQ
from scanweave.sources import audits as au

SCHEMA = (
    "repo_id STRING, id STRING, category STRING, name STRING, severity STRING, description STRING, fix STRING, file STRING, "
    "line INT, code STRING, context STRING, owasp STRING, cwe STRING, phase INT, rule_order INT, item_no LONG"
)


def make(spark, counts, repo="r"):
    rows = []
    for severity, n in counts.items():
        for i in range(n):
            rows.append((repo, f"{severity[0]}-{i}", f"Cat {i % 2}", f"name {i}", severity, "text", "fix " * 40, f"f{i}.py", i + 1, "c",
                         ">>>    1: c", "A03:2021" if i % 2 else "", "CWE-79" if i % 2 else "", 0, i, 0))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("counts,level", [
    ({"CRITICAL": 1}, "CRITICAL"), ({"HIGH": 4}, "HIGH"), ({"HIGH": 3}, "MEDIUM"), ({"MEDIUM": 6}, "MEDIUM"), ({"MEDIUM": 5}, "LOW"), ({"INFO": 9}, "LOW"),
])
def test_risk_level_limits(spark, counts, level):
    row = report.risk_levels(report.severity_counts(make(spark, counts))).collect()[0]
    assert row.risk_level == level and row.total == sum(counts.values())


@pytest.mark.parametrize("threshold,details", [
    (None, "2 CRITICAL"), ("CRITICAL", "2 CRITICAL"), ("HIGH", "2 CRITICAL, 1 HIGH"), ("LOW", "2 CRITICAL, 1 HIGH, 3 LOW"),
    ("INFO", "2 CRITICAL, 1 HIGH, 3 LOW, 1 INFO"), ("odd", "2 CRITICAL"),
])
def test_gate(spark, threshold, details):
    configs = spark.createDataFrame([("r", threshold)], "repo_id STRING, fail_threshold STRING")
    counts = report.severity_counts(make(spark, {"CRITICAL": 2, "HIGH": 1, "LOW": 3, "INFO": 1}))
    row = report.gate(counts, configs).collect()[0]
    assert not row.passed and row.details == f"Security gate failed at {threshold or 'CRITICAL'}: {details}"


def test_gate_passes_without_findings(spark):
    repos = spark.createDataFrame([("r",), ("empty",)], "repo_id STRING")
    rows = {r.repo_id: r for r in report.gate(report.severity_counts(make(spark, {"LOW": 1}), repos)).collect()}
    assert rows["r"].passed and rows["empty"].passed and rows["empty"].details == ""


def test_matrix_leaves_info_out(spark):
    rows = {r.category: r for r in report.category_matrix(make(spark, {"HIGH": 3, "INFO": 2})).collect()}
    assert (rows["Cat 0"].high, rows["Cat 0"].total, rows["Cat 1"].total) == (2, 2, 1)


def test_numbering_equals_row_number_on_a_hot_group(spark):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
        F.hash("id").alias("k"), "id",
    )
    expected = rows.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    got = number_within(rows, ["g"], ["k", "id"], "n")
    assert {(r.id, r.n) for r in got.collect()} == {(r.id, r.n) for r in expected.collect()}


def test_salted_join_keeps_every_row(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("repo_id"), "id")
    facts = spark.createDataFrame([("hot", 1), ("cold", 2), ("none", 3)], "repo_id STRING, v INT")
    got = join_repo_facts(rows, facts, ["id"]).collect()
    assert len(got) == 1000 and all(r.v == (1 if r.repo_id == "hot" else 2) for r in got)


def test_top_rows_are_limited_before_the_shuffle(spark):
    top = first_rows(make(spark, {"HIGH": 15}), ["repo_id"], SEQ, 10, "n")
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    rows = report.top_of_severity(make(spark, {"HIGH": 15, "LOW": 2}), "HIGH").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 11)) and all(len(r.fix) == 100 for r in rows)


def test_review_queue(spark):
    rows = report.review_queue(make(spark, {"LOW": 2, "CRITICAL": 2, "HIGH": 1})).orderBy("position").collect()
    assert [(r.position, r.total, r.severity, r.ordinal) for r in rows] == [
        (1, 5, "CRITICAL", 1), (2, 5, "CRITICAL", 2), (3, 5, "HIGH", 1), (4, 5, "LOW", 1), (5, 5, "LOW", 2),
    ]


@pytest.fixture(scope="module")
def profile(spark):
    return spark.createDataFrame(
        [("r", [("Python", 3)], "Python", ["Django"], ["web"], ["core", "web"], ["mobile"], 3, False), ("empty", [], "Unknown", [], ["cli"], [], [], 0, False)],
        "repo_id STRING, languages ARRAY<STRUCT<lang: STRING, n: LONG>>, primary_language STRING, frameworks ARRAY<STRING>, "
        "arch_types ARRAY<STRING>, security_domains ARRAY<STRING>, skipped_domains ARRAY<STRING>, total_files LONG, has_tests BOOLEAN",
    )


def test_report_document(spark, profile, tmp_path):
    blocks = documents.report_blocks(profile, make(spark, {"CRITICAL": 1, "HIGH": 2, "INFO": 1}), clock=F.lit("2024-01-02 03:04:05").cast("timestamp"))
    rows = blocks.orderBy("section", "part", "block").collect()
    text = "\n".join(r.text for r in rows if r.repo_id == "r")
    headings = [line for line in text.split("\n") if line.startswith("## ")]
    assert headings == [
        "## Executive Summary", "## Project Overview", "## Findings by Category", "## 🔴 CRITICAL Severity Findings",
        "## 🟠 HIGH Severity Findings", "## All Findings by Category", "## OWASP Top 10 (2021) Coverage", "## Recommendations", "## About This Report",
    ]
    assert "> **Total Findings:** 4\n\n---\n\n## Executive Summary" in text
    assert "| **CWE** | [CWE-79](https://cwe.mitre.org/data/definitions/79.html) |\n| **OWASP** | A03:2021 |" in text
    assert "### 2. name 1" in text and "| ⚪ INFO | `I-0` |" in text and "\n\n\n\n" not in text
    assert "## Recommendations\n\n### Immediate Actions (Before Next Deploy)\n\n- **[C-0]** `f0.py:1` — name 0: fix" in text
    empty = "\n".join(r.text for r in rows if r.repo_id == "empty")
    assert "Findings by Category" not in empty and "✅ No issues detected" in empty and "Immediate" not in empty
    sinks.write_documents(blocks, str(tmp_path / "doc"))
    folder = tmp_path / "doc" / "repo_id=r"
    written = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
    assert written.rstrip("\n") == text.rstrip("\n")


def test_json_document(spark, profile):
    blocks = documents.json_blocks(profile, make(spark, {"HIGH": 3})).orderBy("section", "block").collect()
    whole = json.loads("".join(r.text for r in blocks if r.repo_id == "r"))
    assert whole["total"] == 3 and whole["by_severity"] == {"CRITICAL": 0, "HIGH": 3, "MEDIUM": 0, "LOW": 0, "INFO": 0}
    assert [f["id"] for f in whole["findings"]] == ["H-0", "H-1", "H-2"] and whole["project_info"]["languages"] == {"Python": 3}
    assert json.loads("".join(r.text for r in blocks if r.repo_id == "empty"))["findings"] == []


def test_job_summary_lists_twenty(spark, profile):
    text = {r.repo_id: r.text for r in documents.job_summary(profile, make(spark, {"LOW": 25})).collect()}
    assert text["r"].count("| LOW | name") == 20 and "Total findings: **25**" in text["r"] and "Active domains: `core, web`" in text["r"]
    assert "Top Findings" not in text["empty"] and "Skipped domains: `none`" in text["empty"]


def test_sinks(spark, tmp_path):
    findings = make(spark, {"HIGH": 2, "LOW": 1})
    sinks.write_findings(findings, str(tmp_path / "facts"))
    sinks.write_json_lines(findings, str(tmp_path / "lines"))
    assert (tmp_path / "facts" / "severity=HIGH").is_dir() and spark.read.json(str(tmp_path / "lines")).count() == 3


def test_audit_shapes(spark):
    npm = {"vulnerabilities": {
        "a": {"via": ["x"], "title": "t", "severity": "Moderate", "fixAvailable": "take 2"},
        "b": {"via": [{"source": 7, "name": "y"}], "severity": "critical", "fixAvailable": True},
        "c": {"via": "direct", "fixAvailable": {"name": "z"}}, "d": {"via": []}, "e": {"via": [{"name": "y"}]},
    }}
    osv = {"results": [{"packages": [{"package": {"name": "p", "version": "3"}, "vulnerabilities": [{"id": "O"}]}, {"package": {}, "version": "4", "vulnerabilities": [{}]}]}]}
    pip = {"dependencies": [{"name": "p", "version": "1", "vulns": [{"id": "A", "fix_versions": ["2", "3"]}, {"fix_versions": []}]}, {"vulns": []}]}
    rows = [("r", "npm-audit", "ok", json.dumps(npm), ""), ("r", "osv-scanner", "ok", json.dumps(osv), ""), ("r", "pip-audit", "ok", json.dumps(pip), ""),
            ("e", "pip-audit", "ok", "", ""), ("m", "npm-audit", "missing", "", ""), ("m", "osv-scanner", "missing", "", ""), ("b", "osv-scanner", "ok", "{oops", "x" * 600)]
    got = {}
    for r in au.audit_findings(spark.createDataFrame(rows, AUDIT_RAW)).orderBy(*SEQ).collect():
        got.setdefault((r.repo_id, r.id), []).append(r)
    n = got["r", "DEP-NPM-AUDIT"]
    assert [(r.code, r.severity, r.fix) for r in n] == [
        ("a", "MEDIUM", "take 2"), ("b", "CRITICAL", au.NPM_FIX), ("c", "HIGH", au.NPM_FIX), ("d", "HIGH", au.NPM_FIX), ("e", "HIGH", au.NPM_FIX)]
    assert n[0].description == "t (x, installed: unknown)" and "(7, installed" in n[1].description and "(unknown," in n[2].description
    assert [r.context for r in got["r", "DEP-OSV-SCANNER"]] == ["osv-scanner reported p 3: O", "osv-scanner reported unknown 4: unknown"]
    assert [(r.fix, r.description) for r in got["r", "DEP-PIP-AUDIT"]] == [
        ("2, 3", f"{au.PIP_TEXT} (A, installed: 1)"), (au.PIP_FIX, f"{au.PIP_TEXT} (unknown, installed: 1)")]
    assert got["m", "DEP-TOOL-MISSING-NPM-AUDIT"][0].severity == "INFO" and ("m", "DEP-TOOL-MISSING-OSV-SCANNER") not in got
    assert len(got["b", "DEP-TOOL-ERROR-OSV-SCANNER"][0].context) == 500 and len(got) == 5


def test_severity_words(spark):
    df = spark.createDataFrame([("CRITICAL", "Moderate"), ("INFO", "LOW"), ("odd", None)], "s STRING, a STRING")
    rows = df.select("s", severity_rank(F.col("s")).alias("r"), audit_severity(F.col("a")).alias("m")).collect()
    assert [(r.r, r.m) for r in rows] == [(0, "MEDIUM"), (4, "LOW"), (5, "HIGH")]
