"""Whole scans of small repositories."""

import pytest

from scanweave import full_scan, scan
from scanweave.operators.file_filters import ignored_paths, project_files, scannable
from scanweave.operators.profile import profile
from scanweave.rules.examples import EXAMPLES
from scanweave.schemas import AUDIT_RAW, BASELINE, CONFIGS, IGNORES
from scanweave.sources import settings
from scanweave.sources.settings import accepted_keys, baseline_from_files, configs_from_files, ignores_from_files
from pyspark.sql import functions as F

REPOS = [
    ("cli", "main.py", 'print("hello")\n'),
    ("web", "package.json", '{"dependencies":{"express":"4.18.0"}}\n'),
    ("web", "src/server.js", 'const express = require("express");\n'),
    ("config", "package.json", "{}\n"),
    ("config", ".security-agent.yml", "include_domains:\n  - ai_ml\nexclude_domains:\n  - web\n"),
    ("ignored", "ignored.py", "eval(user_input)\n"),
    ("ignored", ".securityignore", "ignored.py\n"),
    ("terminal", "main.py", "class TerminalReporter:\n    pass\n"),
    ("terminal", ".security-agent.json", '{"include_domains": ["ai_ml"], "dependency_audit": {"enabled": false}}'),
    ("tested", "app.py", "def normalize_name(value):\n    return value.strip().lower()\n"),
    ("tested", "tests/test_app.py", "from app import normalize_name\n\n\ndef test_normalize_name():\n    assert normalize_name(' Alice ') == 'alice'\n"),
    ("untested", "app.py", "def normalize_name(value):\n    return value.strip().lower()\n"),
]


@pytest.fixture(scope="module")
def scanned(make_files):
    files = make_files(REPOS)
    configs = configs_from_files(files)
    result = scan(files, configs=configs, ignores=ignores_from_files(files, configs))
    profiles = {r.repo_id: r for r in result.profile.collect()}
    found = {}
    for r in result.findings.collect():
        found.setdefault(r.repo_id, []).append((r.id, r.file, r.line, r.severity))
    return profiles, found


def test_cli_repository_skips_other_domains(scanned):
    profiles, found = scanned
    assert profiles["cli"].arch_types == ["cli"]
    assert profiles["cli"].security_domains == ["core", "secrets", "code_quality"]
    assert profiles["cli"].skipped_domains == ["web", "mobile", "embedded", "pipeline", "ai_ml"]
    assert found["cli"] == [("CQ-003", "main.py", 1, "LOW")]


def test_web_repository(scanned):
    profiles, found = scanned
    assert "web" in profiles["web"].security_domains and "web" not in profiles["web"].skipped_domains
    assert profiles["web"].frameworks == ["Node.js"]
    assert {(x.lang, x.n) for x in profiles["web"].languages} == {("JSON", 1), ("JavaScript", 1)}
    assert "web" not in found


def test_settings_force_domains(scanned):
    profiles, _ = scanned
    assert "ai_ml" in profiles["config"].security_domains
    assert "web" in profiles["config"].skipped_domains


def test_ignored_file_gives_nothing(scanned, make_files):
    assert "ignored" not in scanned[1]
    alone = scan(make_files([r for r in REPOS if r[1] == "ignored.py"])).findings.collect()
    assert {(r.id, r.severity, r.line) for r in alone} == {("A03-003", "CRITICAL", 1), ("A03-004", "CRITICAL", 1)}


def test_terminal_is_no_tool(scanned):
    profiles, found = scanned
    assert "ai_ml" in profiles["terminal"].security_domains
    assert "terminal" not in found


def test_tests_silence_the_missing_tests_rule(scanned):
    _, found = scanned
    assert "tested" not in found
    assert [f[0] for f in found["untested"]] == ["CQ-050"]


def test_file_filters(spark):
    rows = [
        ("src/a.py", 10, True, True, True), ("node_modules/a.py", 10, False, False, False), (".hidden/a.py", 10, False, True, True),
        (".github/a.yml", 10, True, True, True), ("migrations/a.py", 10, True, False, False), (".env", 10, True, True, False),
        ("a.PNG", 10, True, False, False), ("a.py", 500_000, True, True, True), ("a.py", 500_001, True, True, False),
        ("x/build", 10, True, True, False),
    ]
    df = spark.createDataFrame([("r", p, s) for p, s, *_ in rows], "repo_id STRING, path STRING, size LONG")
    for p, s, kept, ours, parity in rows:
        one = df.where((F.col("path") == p) & (F.col("size") == s))
        got = (project_files(one).count() == 1, one.where(scannable(F.col("path"), F.col("size"))).count() == 1,
               one.where(scannable(F.col("path"), F.col("size"), True)).count() == 1)
        assert got == (kept, ours, parity), p


def test_ignore_globs(spark):
    paths = ["generated/a.py", "generated.py", "docs/x/y.md", "a.md", "docs", "lib/ab/c", "x/lib/ab", "acb", "other.py"]
    files = spark.createDataFrame([("r", p) for p in paths] + [("s", "a.md")], "repo_id STRING, path STRING")
    ignores = spark.createDataFrame([("r", g) for g in ["generated/", "*.md", "/docs", "lib/a?", "a*b", "/", ""]], IGNORES)
    got = {(r.repo_id, r.path) for r in ignored_paths(files, ignores).collect()}
    assert got == {("r", p) for p in ["generated/a.py", "docs/x/y.md", "a.md", "docs", "lib/ab/c", "acb"]}


def test_architecture_signals(make_files):
    rows = [
        ("a", "x/App.KT", ""), ("b", "my_app.py", ""), ("c", "lib/watchos_view.c", ""), ("d", "x/.gitlab-ci.yml", ""), ("e", "nb.ipynb", ""),
        ("f", "app.m", ""), ("g", "k8s/x.txt", ""), ("h", "MyModel.xcodeproj/p", ""), ("i", "docs/kubernetes/a.txt", ""),
        ("j", "requirements.txt", "Torch"), ("k", "sub/requirements.txt", "torch"), ("l", "pages/x.css", ""),
    ]
    p = {r.repo_id: r for r in profile(make_files(rows)).collect()}
    assert p["a"].arch_types == ["android"] and "mobile" in p["a"].security_domains
    assert p["b"].arch_types == ["web"]  # a signal may be part of a name
    assert p["c"].arch_types == ["wearable"]
    assert p["d"].arch_types == ["devops"] and p["d"].frameworks == ["GitLab CI"]
    assert p["e"].arch_types == ["ai_ml"] and p["f"].arch_types == ["ios"] and p["h"].arch_types == ["ios"]
    assert p["g"].frameworks == ["Kubernetes"] and "pipeline" not in p["g"].security_domains
    assert p["i"].frameworks == ["Kubernetes"] and "pipeline" in p["i"].security_domains
    assert "ai_ml" in p["j"].security_domains and "ai_ml" not in p["k"].security_domains
    assert p["l"].arch_types == ["cli"] and "web" in p["l"].security_domains
    assert p["g"].primary_language == "Unknown" and p["g"].languages == []


def test_settings_files(make_files):
    yaml = (
        "# c\nfail_threshold: \"MEDIUM\"\nnot a pair\ninclude_domains: [web, 'ai_ml']\nexclude_domains: []\nignore_patterns:\n"
        "  - docs/\n  # note\n  - *.md\nbaseline_file: null\ndependency_audit:\n  enabled: FALSE\n  tools: [pip-audit]\n"
    )
    files = make_files([
        ("y", ".security-agent.yaml", yaml), ("j", ".security-agent.yml", "fail_threshold: LOW"),
        ("j", ".security-agent.json", '{"fail_threshold": "INFO", "dependency_audit": {"tools": []}}'), ("n", "a", ""),
        ("j", "other.json", '{"fail_threshold": "HIGH"}'),
    ])
    c = {r.repo_id: r for r in configs_from_files(files).collect()}
    assert (c["y"].config_path, c["y"].fail_threshold, c["y"].baseline_file) == (".security-agent.yaml", "MEDIUM", None)
    assert c["y"].include_domains == ["web", "ai_ml"] and c["y"].exclude_domains == [] and c["y"].ignore_patterns == ["docs/", "*.md"]
    assert c["y"].dependency_audit.enabled is False and c["y"].dependency_audit.tools == ["pip-audit"]
    assert c["j"].fail_threshold == "INFO" and len(c["j"].dependency_audit.tools) == 3
    assert c["n"].config_path is None and c["n"].fail_threshold == "CRITICAL" and c["n"].dependency_audit.enabled
    named = {r.repo_id: r.fail_threshold for r in configs_from_files(files, "other.json").collect()}
    assert named == {"y": "CRITICAL", "j": "HIGH", "n": "CRITICAL"}


def test_baselines(spark, make_files):
    texts = {
        '{"accepted_findings": ["A03-005:main.py:1", {"id": "X", "file": "a b.py", "line": 3}]}': ["A03-005:main.py:1", "X:a b.py:3"],
        '["k:1:2"]': ["k:1:2"], "broken {": [], "{}": [], '{"accepted_findings": [{"id": "X"}]}': ["X:None:None"],
    }
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", accepted_keys(F.col("t")).alias("k"))
    assert {r.t: r.k for r in df.collect()} == texts
    files = make_files([
        ("r", ".security-agent.json", '{"baseline_file": "b.json"}'), ("r", "b.json", next(iter(texts))), ("s", "b.json", next(iter(texts))),
    ])
    got = {(r.repo_id, r.finding_key) for r in baseline_from_files(files, configs_from_files(files)).collect()}
    assert got == {("r", "A03-005:main.py:1"), ("r", "X:a b.py:3")}


def test_full_scan(spark, make_files):
    files = make_files([("r", "main.py", "eval(x)\nprint(x)\n"), ("r", "requirements.txt", "flask")])
    audits = spark.createDataFrame([
        ("r", "pip-audit", "ok", '{"dependencies": [{"name": "flask", "version": "1", "vulns": [{"id": "V"}]}]}', ""),
        ("r", "npm-audit", "missing", "", ""), ("r", "osv-scanner", "missing", "", ""),
    ], AUDIT_RAW)
    baseline = spark.createDataFrame([("r", "A03-004:main.py:1"), ("q", "CQ-003:main.py:2")], BASELINE)
    found = full_scan(files, audits=audits, baseline=baseline).findings
    assert {(r.id, r.severity) for r in found.collect()} == {("A03-003", "CRITICAL"), ("CQ-003", "LOW"), ("DEP-PIP-AUDIT", "HIGH")}
    high = full_scan(files, audits=audits, baseline=baseline, severity="CRITICAL").findings
    assert {r.id for r in high.collect()} == {"A03-003"}


def test_excluding_every_domain_falls_back_to_the_core_ones(spark, make_files):
    everything = ["core", "secrets", "code_quality", "web", "mobile", "embedded", "pipeline", "ai_ml"]
    configs = spark.createDataFrame([("r", None, "LOW", [], everything, [], None, None)], CONFIGS)
    found = scan(make_files([("r", "main.py", "eval(x)")]), configs=configs).findings
    assert {r.id for r in found.collect()} == {"A03-003", "A03-004"}


def test_repeated_file_gives_a_finding_once(make_files):
    path, hit = "a" + EXAMPLES["A02-006"][0], EXAMPLES["A02-006"][1]
    found = scan(make_files([("r", path, hit), ("r", path, hit), ("q", path, hit)])).findings
    assert sorted((r.repo_id, r.id) for r in found.collect()) == [("q", "A02-006"), ("r", "A02-006")]


def test_profile_reads_no_content(spark, make_files, tmp_path):
    make_files(REPOS).write.parquet(str(tmp_path / "files"))
    plan = profile(spark.read.parquet(str(tmp_path / "files")))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    with_content = [line for line in scans if "content" in line.split("ReadSchema")[1]]
    assert scans and with_content and all("In(path" in line for line in with_content)  # manifests only
    assert len(with_content) < len(scans)
