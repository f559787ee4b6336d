"""Rules of inactive domains and ignored files are not matched."""

from dataclasses import replace

import pytest
from pyspark.sql import Row

from scanweave import scan
from scanweave.operators import pruning
from scanweave.operators.matching import _line_numbers, scan_lines
from scanweave.rules.catalog import CORE_DOMAINS, DOMAINS, builtin_rules
from scanweave.rules.examples import EXAMPLES
from scanweave.schemas import IGNORES

RULES = builtin_rules()


@pytest.fixture(scope="module")
def corpus(make_files, spark):
    rows = [(repo, f"{folder}/{rule_id}{tail}", f"first\n{hit}\n") for repo in ("core", "all", "unknown")
            for folder in ("src", "generated") for rule_id, (tail, hit, *_) in EXAMPLES.items()]
    facts = spark.createDataFrame([("core", CORE_DOMAINS[:1]), ("all", DOMAINS), ("none", [])], "repo_id STRING, security_domains ARRAY<STRING>")
    return make_files(rows), facts, spark.createDataFrame([("core", "generated/"), ("all", "*.js")], IGNORES)


def kept(hits, facts, ignored):
    domains = {r.repo_id: r.security_domains for r in facts.collect()}
    out = set()
    for r in hits:
        rule = RULES[r.rule_no]
        if rule.domain in domains.get(r.repo_id, DOMAINS) and not ignored(r.repo_id, r.path):
            out.add((r.repo_id, r.path, rule.rule_id, r.line))
    return out


@pytest.mark.parametrize("automaton", [True, False])
def test_equal_to_filtering_afterwards(corpus, automaton):
    """The search in SQL is tried with the rules of two domains: all words of all rules make a large plan."""
    files, facts, ignores = corpus
    rules = RULES if automaton else tuple(r for r in RULES if r.domain in ("web", "secrets"))
    number = {r.rule_id: i for i, r in enumerate(RULES)}
    everything = [r for r in scan_lines(files, RULES).collect() if RULES[r.rule_no] in rules]
    pruned = scan_lines(pruning.with_active(files, facts, ignores), rules, automaton=automaton, active="active").collect()
    pruned = [Row(**{**r.asDict(), "rule_no": number[rules[r.rule_no].rule_id]}) for r in pruned]
    ignored = lambda repo, path: repo == "core" and path.startswith("generated/") or repo == "all" and path.endswith(".js")
    expected = kept(everything, facts, ignored)
    assert kept(pruned, facts, lambda *_: False) == expected and len(pruned) == len(expected) > 20


def test_too_large_for_a_broadcast(corpus):
    files, facts, ignores = corpus
    masks = {r.active for r in pruning.with_active(files, facts, ignores, max_rows=1).select("active").distinct().collect()}
    assert masks == {pruning.ALL_DOMAINS}
    ignores = ignores.union(ignores.selectExpr("repo_id", "repeat('z', 200)"))
    masks = {(r.repo_id, r.active) for r in pruning.with_active(files, facts, ignores, max_bytes=200).select("repo_id", "active").distinct().collect()}
    assert all(active for _, active in masks)


def test_every_branch_is_guarded_by_its_domain():
    sql = _line_numbers(RULES, "active")
    for no, rule in enumerate(RULES):
        if not rule.file_check:
            assert f"struct({no} AS rule_no, CASE WHEN (active & {1 << DOMAINS.index(rule.domain)}L) <> 0 AND" in sql


def test_inactive_rules_evaluate_nothing(spark, make_files):
    """A pattern that would not end in a lifetime is harmless where its domain is off, or its file ignored."""
    slow = replace(RULES[0], rule_id="X-1", domain="web", pattern=r"(a|a)*(a|a)*(a|a)*b", negative_pattern=None, langs=None)
    files = make_files([("r", "a.py", "a" * 4000 + "c"), ("s", "gen/a.py", "a" * 4000 + "c"), ("s", "b.py", "aab")])
    facts = spark.createDataFrame([("r", ["core"]), ("s", ["web"])], "repo_id STRING, security_domains ARRAY<STRING>")
    ignores = spark.createDataFrame([("s", "gen/")], IGNORES)
    hits = scan_lines(pruning.with_active(files, facts, ignores), (slow,), active="active").collect()
    assert [(r.repo_id, r.path) for r in hits] == [("s", "b.py")]


def test_scan_matches_active_domains_only(make_files, monkeypatch):
    seen = {}
    import scanweave.plans.scan as module

    plain = module.scan_lines
    monkeypatch.setattr(module, "scan_lines", lambda files, *a, **k: seen.setdefault("hits", plain(files, *a, **k)))
    result = scan(make_files([("r", f"x/{i}{t}", h) for i, (t, h, *_) in EXAMPLES.items() if t == ".py"]))
    domains = set(result.profile.collect()[0].security_domains)
    assert {RULES[r.rule_no].domain for r in seen["hits"].collect()} <= domains != set(DOMAINS)
