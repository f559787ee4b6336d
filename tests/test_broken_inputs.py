"""Inputs that are damaged, odd or unreadable."""

import json
import os

import pytest

from scanweave.operators.matching import scan_lines
from scanweave.rules.catalog import Rule, merge_rules, rules_frame
from scanweave.schemas import AUDIT_RAW
from scanweave.sources.audits import audit_findings
from scanweave.sources.files import read_directory, unread
from scanweave.sources.settings import config_problems, configs_from_files


def test_broken_settings_are_reported(spark, make_files):
    files = make_files([
        ("bad", ".security-agent.json", '{"fail_threshold": "LOW", oops}'), ("type", ".security-agent.json", '{"include_domains": 7}'),
        ("single", ".security-agent.json", "{'fail_threshold': 'LOW'}"), ("good", ".security-agent.json", '{"fail_threshold": "LOW"}'),
        ("tab", ".security-agent.yml", 'fail_threshold: LOW\nbaseline_file: a\tb.json\nexclude_domains: [web]\nnote: "q\\"x"\n'), ("none", "a.py", ""),
    ])
    assert {(r.repo_id, r.path) for r in config_problems(files).collect()} == {
        ("bad", ".security-agent.json"), ("type", ".security-agent.json"), ("single", ".security-agent.json"),
    }
    got = {r.repo_id: r for r in configs_from_files(files).collect()}
    assert got["bad"].fail_threshold == "CRITICAL" and got["good"].fail_threshold == "LOW"
    assert (got["tab"].fail_threshold, got["tab"].baseline_file, got["tab"].exclude_domains) == ("LOW", "a\tb.json", ["web"])


def test_one_configuration_for_all_repositories(spark, make_files):
    files = make_files([("a", "x.py", ""), ("b", ".security-agent.json", '{"fail_threshold": "LOW"}')])
    got = {r.repo_id: (r.fail_threshold, r.exclude_domains) for r in configs_from_files(files, shared='{"fail_threshold": "HIGH", "exclude_domains": ["web"]}').collect()}
    assert got == {"a": ("HIGH", ["web"]), "b": ("HIGH", ["web"])}
    with pytest.raises(ValueError):
        configs_from_files(files, shared="{oops")


def test_tool_output_is_judged_as_json(spark):
    package = {"name": "flask", "version": "1", "vulns": [{"id": "V"}]}
    large = json.dumps({"dependencies": [package], "note": ["x" * 1000] * 20_000})
    repeated = '{"a": 1, "a": 2, "dependencies": [' + json.dumps(package) + "]}"
    texts = {"large": large, "repeated": repeated, "list": "[1, 2]", "cut": large[:-1], "more": "{} {}", "closed": "1}", "word": "no { json", "empty": ""}
    audits = spark.createDataFrame([(k, "pip-audit", "ok", v, "") for k, v in texts.items()], AUDIT_RAW)
    got = {(r.repo_id, r.id) for r in audit_findings(audits).select("repo_id", "id").collect()}
    assert got == {("large", "DEP-PIP-AUDIT"), ("repeated", "DEP-PIP-AUDIT")} | {(k, "DEP-TOOL-ERROR-PIP-AUDIT") for k in ("cut", "more", "closed", "word")}


def test_rules_for_no_file_and_odd_rules(spark, make_files):
    base = dict(domain="core", category="c", name="n", severity="LOW", pattern="eval", description="d", fix="f")
    extra = [
        dict(base, rule_id="N-1", langs=[]), dict(base, rule_id="N-2", langs=".py"), dict(base, rule_id="N-3", severity="GRAVE"),
        dict(base, rule_id="N-4", langs=[".py"]), dict(base, rule_id="N-5", langs=[1]),
    ]
    rules, rejected = merge_rules(spark, extra, ())
    assert [r.rule_id for r in rules] == ["N-1", "N-4"]
    assert {r.rule_id for r in rejected.collect()} == {"N-2", "N-3", "N-5"}
    hits = scan_lines(make_files([("r", "a.py", "eval(x)"), ("r", "b.rb", "eval(x)")]), rules).collect()
    assert [(h.path, rules[h.rule_no].rule_id) for h in hits] == [("a.py", "N-4")]
    assert rules_frame(spark, ()).collect() == []
    assert isinstance(rules[0], Rule)


def test_directories_with_links_and_unreadable_files(spark, tmp_path):
    repo = tmp_path / "repos" / "one"
    (repo / "src" / "deep").mkdir(parents=True)
    (repo / "a.py").write_text("eval(x)")
    (repo / "src" / "deep" / "b.py").write_text("print(x)")
    os.symlink("..", repo / "src" / "loop")
    os.symlink(repo / "a.py", repo / "linked.py")
    os.symlink(repo / "nowhere", repo / "dead.py")
    big = repo / "big.py"
    big.write_bytes(b"x" * 700_000)
    files = read_directory(spark, f"file://{tmp_path}/repos", tasks=3)
    assert {(r.path, r.size) for r in files.collect()} == {("a.py", 7), ("src/deep/b.py", 8), ("big.py", 700_000)}
    assert unread(files).collect() == []
    limited = read_directory(spark, f"file://{tmp_path}/repos", max_bytes=500_000, tasks=3)
    assert [(r.path, r.size) for r in unread(limited).collect()] == [("big.py", 700_000)]
