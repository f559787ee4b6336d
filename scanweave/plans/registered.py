"""Every operator as a query over the driver's tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import file_name, suffix
from ..functions.regex import names_line_break
from ..operators import file_filters as ff
from ..operators import profile as pr
from ..operators import suppression as sp
from ..operators.distinct_content import scan_distinct
from ..operators.matching import PARITY_LINE_CHARS, scan_lines, unscanned, with_lines
from ..operators.pruning import with_active
from ..rules.catalog import builtin_rules, merge_rules, rules_frame
from ..schemas import FINDING
from ..session import materialize, shared_dir
from ..sources import audits as au
from ..sources import settings as st
from ..sources.files import read_directory, write_tree
from ..streaming import continuous as cs
from ..streaming import current as cu
from . import corpus as co
from . import documents as docs
from . import report as rp
from . import sinks
from .scan import Scan, full_scan, scan

CLOCK = "2024-01-02 03:04:05"


def _settings(files: DataFrame):
    configs = materialize(st.configs_from_files(files))
    return configs, st.ignores_from_files(files, configs), st.baseline_from_files(files, configs)


def _everything(spark: SparkSession, sf: str) -> tuple[Scan, DataFrame]:
    files = co.files(spark, sf)
    configs, ignores, baseline = _settings(files)
    return full_scan(files, configs=configs, ignores=ignores, baseline=baseline), configs


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    return _everything(spark, sf)[0].findings


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    files = co.files(spark, sf)
    return pr.profile(files, st.configs_from_files(files))


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    return ff.project_files(co.files(spark, sf))


def _scanned(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf).where(ff.scannable(F.col("path"), F.col("size")))


def _named_hits(files: DataFrame, rules=None) -> DataFrame:
    """Hits of all domains with the rule's id."""
    hits = scan_lines(files, rules)
    names = rules_frame(files.sparkSession, rules).select(F.col("rule_order").alias("rule_no"), F.col("rule_id").alias("id"))
    return hits.join(F.broadcast(names), "rule_no")


def _list(column: str):
    return F.array_join(column, ", ").alias(column)


# --- files ------------------------------------------------------------------


def project_files(spark, sf):
    return _kept(spark, sf).select("repo_id", "path", "size")


def scannable_files(spark, sf):
    return _scanned(spark, sf).select("repo_id", "path")


def text_lines(spark, sf):
    lines = with_lines(_scanned(spark, sf))
    lengths = F.aggregate("lines", F.lit(0).cast("bigint"), lambda s, x: s + F.char_length(x))
    return lines.select("repo_id", "path", "name", "ext", F.size("lines").cast("bigint").alias("n_lines"), lengths.alias("n_chars"))


def rule_applicability(spark, sf):
    """How many files each rule applies to: files meet rules by suffix or by name."""
    files = with_lines(_scanned(spark, sf)).groupBy("name", "ext").agg(F.count("*").alias("n"))
    rules = rules_frame(spark).select("rule_id", "langs")
    named = rules.select("rule_id", F.explode("langs").alias("lang"))
    unbound = F.array(*[F.lit(r.rule_id) for r in builtin_rules() if r.langs is None])
    everywhere = files.agg(F.sum("n").alias("n")).select(F.explode(unbound).alias("rule_id"), "n")
    key = F.when(F.col("lang").startswith("."), F.lit("ext")).otherwise(F.lit("name"))
    by_ext = named.where(key == "ext").join(files.groupBy("ext").agg(F.sum("n").alias("n")), F.col("lang") == F.col("ext"))
    by_name = named.where(key == "name").join(files.groupBy("name").agg(F.sum("n").alias("n")), F.col("lang") == F.col("name"))
    found = by_ext.select("rule_id", "n").unionByName(by_name.select("rule_id", "n")).unionByName(everywhere)
    return found.groupBy("rule_id").agg(F.sum("n").alias("n_files"))


def configs(spark, sf):
    c = st.configs_from_files(co.files(spark, sf))
    lists = [_list(x) for x in ("include_domains", "exclude_domains", "ignore_patterns")]
    tools = F.array_join("dependency_audit.tools", ", ").alias("audit_tools")
    return c.select(
        "repo_id", "config_path", "fail_threshold", *lists, "baseline_file",
        F.col("dependency_audit.enabled").alias("audit_enabled"), tools,
    )


def config_problems(spark, sf):
    return st.config_problems(co.files(spark, sf))


def unscanned_parts(spark, sf):
    """What the limits of ``parity`` would leave out; without them everything is scanned."""
    kept = _kept(spark, sf).where(ff.scannable(F.col("path"), F.col("size")))
    return unscanned(kept, PARITY_LINE_CHARS, ff.PARITY_FILE_BYTES)


def ignore_globs(spark, sf):
    files = co.files(spark, sf)
    return st.ignores_from_files(files, st.configs_from_files(files))


def baseline_keys(spark, sf):
    files = co.files(spark, sf)
    return st.baseline_from_files(files, st.configs_from_files(files))


def ignored_files(spark, sf):
    files = co.files(spark, sf)
    return ff.ignored_paths(ff.project_files(files), st.ignores_from_files(files, st.configs_from_files(files))).distinct()


def tree_files(spark, sf):
    """The corpus as a directory tree, listed and read back: the files of each repository."""
    root = shared_dir(spark)
    write_tree(co.files(spark, sf), root)
    found = read_directory(spark, root)
    return found.select("repo_id", "path", "size", F.sha2("content", 256).alias("content_sha256"))


# --- profile ----------------------------------------------------------------


def language_counts(spark, sf):
    return pr.language_counts(_kept(spark, sf))


def top_languages(spark, sf):
    listed = pr.repo_languages(pr.language_counts(_kept(spark, sf)))
    rows = listed.select("repo_id", F.posexplode("languages").alias("p", "l"))
    return rows.select("repo_id", (F.col("p") + 1).cast("bigint").alias("pos"), "l.lang", "l.n")


def primary_language(spark, sf):
    return _profile(spark, sf).select("repo_id", "primary_language", "total_files")


def frameworks(spark, sf):
    return pr.repo_signals(_kept(spark, sf)).select("repo_id", _list("frameworks"))


def arch_types(spark, sf):
    return pr.repo_signals(_kept(spark, sf)).select("repo_id", _list("arch_types"))


def manifest_packages(spark, sf):
    return pr.manifest_packages(co.files(spark, sf))


def domains(spark, sf):
    return _profile(spark, sf).select("repo_id", _list("security_domains"), _list("skipped_domains"))


def test_presence(spark, sf):
    return pr.repo_signals(_kept(spark, sf)).select("repo_id", "has_tests")


# --- matching ---------------------------------------------------------------


def line_hits(spark, sf):
    """Every rule on every line, whatever the repository's domains."""
    return _named_hits(_scanned(spark, sf)).where("line > 0").select("repo_id", "path", "id", "line")


def distinct_content_hits(spark, sf):
    """:func:`line_hits` with each distinct content matched once."""
    hits = scan_distinct(_scanned(spark, sf))
    names = spark.createDataFrame([(i, r.rule_id) for i, r in enumerate(builtin_rules())], "rule_no INT, id STRING")
    return hits.join(F.broadcast(names), "rule_no").where("line > 0").select("repo_id", "path", "id", "line")


def negative_context(spark, sf):
    """Hits of rules with a cancelling pattern: how many stand and how many fell."""
    rules = tuple(r for r in builtin_rules() if r.negative_pattern)
    files = _scanned(spark, sf)
    alone = tuple(replace(r, negative_pattern=None) for r in rules)
    all_hits = _named_hits(files, alone).groupBy("id").agg(F.count("*").alias("matched"))
    left = _named_hits(files, rules).groupBy("id").agg(F.count("*").alias("kept"))
    return all_hits.join(left, "id", "left").select("id", "matched", F.coalesce("kept", F.lit(0)).alias("kept"))


def lookaround_rules(spark, sf):
    ids = set(LOOKAROUND)
    rules = tuple(r for r in builtin_rules() if r.rule_id in ids)
    return _named_hits(_scanned(spark, sf), rules).select("repo_id", "path", "id", "line")


def file_name_rules(spark, sf):
    rules = tuple(r for r in builtin_rules() if r.file_check)
    return _named_hits(_scanned(spark, sf), rules).select("repo_id", "path", "id", "line", "code", "context")


def multiline_hits(spark, sf):
    """The rules written for several lines, on whole files: hits on one line and over several."""
    rules = tuple(r for r in builtin_rules() if names_line_break(r.pattern))
    files = ff.project_files(co.multiline_files(spark, sf))
    files = files.where(ff.scannable(F.col("path"), F.col("size")))
    hits = scan_lines(files, rules, multiline=True)
    names = spark.createDataFrame([(i, r.rule_id) for i, r in enumerate(rules)], "rule_no INT, id STRING")
    return hits.join(F.broadcast(names), "rule_no").select("repo_id", "path", "id", "line", "code", "context")


def page_hits(spark, sf):
    files = co.page_files(spark, sf).withColumn("size", F.octet_length("content"))
    kept = ff.project_files(files).where(ff.scannable(F.col("path"), F.col("size")))
    return _named_hits(kept).groupBy("repo_id", "id").agg(F.count("*").alias("n"))


def secrets_hits(spark, sf):
    rules = tuple(r for r in builtin_rules() if r.domain == "secrets" and not r.file_check)
    return _named_hits(_scanned(spark, sf), rules).select("repo_id", "path", "id", "line", "code")


def context_snippets(spark, sf):
    return _named_hits(_scanned(spark, sf)).select("repo_id", "path", "id", "line", "code", "context")


EXTRA_RULES = [
    dict(rule_id="X-001", domain="core", category="Own", name="Loose word", severity="LOW",
         pattern=r"(^|\s)(the|les|und)\s+[a-z]+[.,]", description="A word.", fix="Drop it.", langs=[".py", ".js", ".java"]),
    dict(rule_id="X-002", domain="core", category="Own", name="Broken", severity="LOW", pattern="(unclosed",
         description="d", fix="f", langs=[".py", ".go"]),
    dict(rule_id="A01-001", domain="core", category="Own", name="Taken", severity="LOW", pattern="x", description="d", fix="f"),
    dict(rule_id="X-003", domain="nowhere", category="Own", name="Lost", severity="LOW", pattern="x", description="d", fix="f"),
    dict(rule_id="X-004", domain="core", category="Own", name="No file", severity="LOW", pattern=".", description="d", fix="f", langs=[]),
    dict(rule_id="X-005", domain="core", category="Own", name="Text", severity="LOW", pattern="x", description="d", fix="f", langs=".py"),
    dict(rule_id="X-006", domain="core", category="Own", name="Odd", severity="GRAVE", pattern="x", description="d", fix="f"),
    dict(rule_id="X-007", domain="core", category="Own", name="Slow", severity="LOW", pattern=r"(\w+\s?)+;$", description="d", fix="f", langs=[".js"]),
    dict(rule_id="X-008", domain="core", category="Own", name="Slower", severity="LOW", pattern=".*a.*b.*c.*d.*;", description="d", fix="f",
         langs=[".java", ".py"]),
]


def user_rules(spark, sf):
    """A rule added by the user, scanned beside the whole catalogue; bad rules are left out."""
    rules, _ = merge_rules(spark, EXTRA_RULES)
    return _named_hits(_scanned(spark, sf), rules).groupBy("id").agg(F.count("*").alias("n"))


def rejected_rules(spark, sf):
    """The user's rules that were left out, why, and how many files of each language miss them."""
    _, rejected = merge_rules(spark, EXTRA_RULES)
    # The rules are a short list; those for every file have no suffix to count.
    wanted = spark.createDataFrame([(r["rule_id"], x) for r in EXTRA_RULES for x in _list_of(r.get("langs"))], "rule_id STRING, ext STRING")
    per_suffix = _scanned(spark, sf).groupBy(suffix(file_name(F.col("path"))).alias("ext")).agg(F.count("*").alias("n"))
    missed = per_suffix.join(F.broadcast(wanted), "ext").groupBy("rule_id").agg(F.sum("n").alias("n_files"))
    return rejected.select("rule_id", "reason").join(missed, "rule_id", "left")


def _list_of(langs) -> list[str]:
    return langs if isinstance(langs, list) else []


# --- findings ---------------------------------------------------------------


def findings(spark, sf):
    files = co.files(spark, sf)
    c, ignores, _ = _settings(files)
    return scan(files, configs=c, ignores=ignores).findings.select(*FINDING)


def findings_dedup(spark, sf):
    """The corpus handed in twice gives every finding once."""
    files = co.files(spark, sf)
    c, ignores, _ = _settings(files)
    hits = materialize(scan_lines(_scanned(spark, sf)))
    ignored = ff.ignored_paths(ff.project_files(files), ignores)
    kept = sp.drop_ignored(sp.first_of_each(hits.unionAll(hits)), ignored)
    once = sp.active_findings(kept, rules_frame(spark), pr.profile(files, c))
    return once.groupBy("repo_id", "id").agg(F.count("*").alias("n"))


def missing_tests(spark, sf):
    files = co.files(spark, sf)
    rules = tuple(r for r in builtin_rules() if r.rule_id == sp.MISSING_TESTS)
    return scan(files, rules, st.configs_from_files(files)).findings.select("repo_id", "id", "file", "line")


def baseline_antijoin(spark, sf):
    return _findings(spark, sf).select("repo_id", "id", "file", "line")


def suppressed_counts(spark, sf):
    files = co.files(spark, sf)
    c, ignores, baseline = _settings(files)
    return sp.accepted_counts(scan(files, configs=c, ignores=ignores).findings, baseline)


def min_severity(spark, sf):
    high = sp.at_least(_findings(spark, sf), "HIGH")
    return high.groupBy("repo_id", "severity").agg(F.count("*").alias("n"))


# --- reports ----------------------------------------------------------------


def _reported(spark, sf):
    s, c = _everything(spark, sf)
    return s.profile, materialize(s.findings), c


def severity_counts(spark, sf):
    s, _ = _everything(spark, sf)
    return rp.severity_counts(s.findings, s.profile)


def risk_level(spark, sf):
    return rp.risk_levels(severity_counts(spark, sf)).select("repo_id", "critical", "high", "medium", "low", "total", "risk_level")


def category_matrix(spark, sf):
    return rp.category_matrix(_findings(spark, sf))


def owasp_coverage(spark, sf):
    s, _ = _everything(spark, sf)
    return rp.owasp_coverage(s.findings, s.profile)


def fail_gate(spark, sf):
    s, c = _everything(spark, sf)
    return rp.gate(rp.severity_counts(s.findings, s.profile), c)


def category_listing(spark, sf):
    return rp.category_listing(materialize(_findings(spark, sf))).withColumn("position", F.col("position").cast("bigint"))


def review_queue(spark, sf):
    queue = rp.review_queue(materialize(_findings(spark, sf)))
    return queue.select(
        "repo_id", F.col("position").cast("bigint").alias("position"), F.col("total").cast("bigint").alias("total"),
        F.col("ordinal").cast("bigint").alias("ordinal"), "severity", "id", "file", "line",
    )


def _top(df, *columns):
    return df.withColumn("n", F.col("n").cast("bigint")).select("repo_id", "n", *columns)


def top_critical(spark, sf):
    return _top(rp.top_of_severity(_findings(spark, sf), "CRITICAL"), "id", "file", "line", "name", "fix")


def top_high(spark, sf):
    return _top(rp.top_of_severity(_findings(spark, sf), "HIGH"), "id", "file", "line", "name")


def top20(spark, sf):
    return _top(rp.top_findings(_findings(spark, sf)), "severity", "name", "file", "line")


def finding_cards(spark, sf):
    queue = rp.review_queue(materialize(_findings(spark, sf)))
    return rp.cards(queue).select("repo_id", "severity", F.col("ordinal").cast("bigint").alias("ordinal"), "text")


def report_text(spark, sf):
    profile, found, c = _reported(spark, sf)
    clock = F.lit(CLOCK).cast("timestamp")
    blocks = docs.report_blocks(profile, found, c, clock)
    return blocks.where(~F.col("section").between(docs.LISTS, docs.LISTING))


def severity_heads(spark, sf):
    profile, found, c = _reported(spark, sf)
    blocks = docs.report_blocks(profile, found, c, F.lit(CLOCK).cast("timestamp"))
    heads = blocks.where(F.col("section").between(docs.LISTS, docs.LISTS + 3) & (F.col("block") == 0))
    return heads.select("repo_id", F.col("section").cast("int").alias("section"), "text")


def report_listing(spark, sf):
    profile, found, c = _reported(spark, sf)
    blocks = docs.report_blocks(profile, found, c, F.lit(CLOCK).cast("timestamp"))
    return blocks.where(F.col("section") == docs.LISTING).select("repo_id", "part", "block", "text")


def job_summary(spark, sf):
    profile, found, _ = _reported(spark, sf)
    return docs.job_summary(profile, found)


def findings_json(spark, sf):
    profile, found, c = _reported(spark, sf)
    return docs.json_blocks(profile, found, c)


def report_files(spark, sf):
    """The findings documents as finished files, read back: every volume's size and digest."""
    profile, found, c = _reported(spark, sf)
    folder = shared_dir(spark)
    sinks.write_files(docs.json_blocks(profile, found, c), folder, "findings.json", "", volume_blocks=100)
    written = sinks.read_files(spark, folder)
    return written.select(
        F.col("repository").alias("repo_id"), "volume", F.octet_length("content").cast("bigint").alias("n_bytes"), F.sha2("content", 256).alias("sha256")
    )


# --- dependency audits --------------------------------------------------------

_DEPENDENCY = ["repo_id", "id", "name", "severity", "description", "fix", "file", "code", "context", "owasp", "cwe"]


def pip_audit(spark, sf):
    return au.pip_findings(co.audits(spark, sf)).select(*_DEPENDENCY)


def npm_audit(spark, sf):
    return au.npm_findings(co.audits(spark, sf)).select(*_DEPENDENCY)


def osv_audit(spark, sf):
    return au.osv_findings(co.audits(spark, sf)).select(*_DEPENDENCY)


def audit_problems(spark, sf):
    return au.tool_problems(co.audits(spark, sf)).select(*_DEPENDENCY)


def _audit_inputs(spark, sf):
    """Audits of the document repositories: every order stands for one of them."""
    files = co.files(spark, sf)
    repos = F.concat(F.lit("src"), F.expr("substring(repo_id, 7) % 20").cast("int").cast("string"), F.lit("-"),
                     F.expr("substring(repo_id, 7) % 6").cast("int").cast("string"))
    return files, st.configs_from_files(files), co.audits(spark, sf).withColumn("repo_id", repos)


def audit_selection(spark, sf):
    files, c, audits = _audit_inputs(spark, sf)
    return au.selected_audits(audits, c, files).groupBy("repo_id", "tool").agg(F.count("*").alias("n"))


def dependency_union(spark, sf):
    """Static and dependency findings together, counted; some dependency findings are accepted."""
    files, c, audits = _audit_inputs(spark, sf)
    accepted = c.select("repo_id", F.lit("DEP-OSV-SCANNER:sub/pom.xml:0").alias("finding_key"))
    found = full_scan(files, configs=c, audits=audits, baseline=accepted, severity="INFO").findings
    return found.groupBy("repo_id", "category", "severity").agg(F.count("*").alias("n"))


# --- streams ------------------------------------------------------------------


def stream_scan(spark, sf):
    found = cs.run_once(cs.scan_stream(cs.corpus_versions(spark, sf)))
    return found.select("repo_id", "id", "file", "line", "severity")


def stream_dedup(spark, sf):
    versions = cs.corpus_versions(spark, sf, copies=2, sentinel=True)
    found = cs.run_once(cs.first_within(cs.scan_stream(versions), "2 days"))
    return found.groupBy("repo_id", "id").agg(F.count("*").alias("n"))


def stream_hourly(spark, sf):
    found = cs.scan_stream(cs.corpus_versions(spark, sf, copies=1, sentinel=True))
    per_hour = cs.run_once(cs.per_window(found, "1 hour", delay="1 day"))
    return per_hour.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "severity", "n")


def _current(spark, sf, batches=3):
    """The corpus followed on a stream to its end, under the settings of its repositories."""
    files = co.files(spark, sf)
    c, ignores, baseline = _settings(files)
    about = materialize(pr.profile(files, c))
    # Stored, so that no micro-batch reads the files for them again, and their size is known to its joins.
    ignores, baseline = materialize(ignores), materialize(baseline)
    versions = with_active(cs.corpus_history(spark, sf, batches), about, ignores)
    found = cu.version_findings(versions, facts=about, ignores=ignores, baseline=baseline, active="active")
    now = cu.CurrentFindings(spark)
    now.follow(found).awaitTermination()
    return now, about, c


def stream_gate(spark, sf):
    """The gate as the running counts give it: that of a batch scan of the last versions."""
    now, about, c = _current(spark, sf)
    return now.gate(about, c)


def stream_current(spark, sf):
    """What is open after the last micro-batch."""
    now, _, _ = _current(spark, sf)
    return now.open_findings().withColumnRenamed("path", "file")


def stream_categories(spark, sf):
    """The category matrix from the running totals."""
    return _current(spark, sf)[0].category_matrix()


def stream_owasp(spark, sf):
    """The OWASP coverage from the running totals."""
    now, about, _ = _current(spark, sf)
    return now.owasp_coverage(about)


def stream_sliding(spark, sf):
    """Findings per six hours, counted every two."""
    found = cs.scan_stream(cs.corpus_versions(spark, sf, sentinel=True))
    counts = cs.run_once(cs.per_window(found, "6 hours", "2 hours", delay="1 day"))
    return counts.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "severity", "n")


LOOKAROUND = [
    "A02-005", "A04-002", "A08-003", "CQ-012", "CQ-021", "WEB-004", "MOB-011", "EMB-031", "EMB-041", "PIPE-002", "PIPE-041",
    "AIML-010", "AIML-011",
]

QUERIES = {
    f.__name__: f
    for f in (
        severity_counts, risk_level, category_matrix, owasp_coverage, fail_gate,
        project_files, scannable_files, text_lines, rule_applicability, configs, config_problems, unscanned_parts, ignore_globs, baseline_keys,
        ignored_files, tree_files, language_counts, top_languages, primary_language, frameworks, arch_types, manifest_packages,
        domains, test_presence, line_hits, distinct_content_hits, negative_context, lookaround_rules, file_name_rules, multiline_hits, page_hits,
        secrets_hits, context_snippets, user_rules, rejected_rules, findings, findings_dedup, missing_tests, baseline_antijoin,
        suppressed_counts, min_severity, category_listing, review_queue, top_critical, top_high, top20,
        finding_cards, report_text, report_listing, job_summary, findings_json, report_files, pip_audit, npm_audit, osv_audit,
        audit_problems, audit_selection, dependency_union, stream_scan, stream_dedup, stream_hourly, stream_sliding, stream_gate, stream_current, stream_categories, stream_owasp,
        severity_heads,
    )
}
