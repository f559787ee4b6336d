"""Repositories made from the driver's text tables.

Every document and every page becomes a file that holds its whole text, followed by
example lines of one rule, so that the rules have something to find; every document
repository also gets a manifest and settings files at its root.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_lines
from ..rules.examples import EXAMPLES, MULTILINE_EXAMPLES
from ..session import configure, deal_splits, materialize, spread

DIRECTORIES = [
    "src", "src/pages", "lib", "app", "vendor", "tests", "build/out", "generated", "docs", ".github/workflows",
    ".hidden", "k8s/base", "migrations", "infra/terraform",
]
PAGE_NAMES = [
    "index.html", "manage.py", "next.config.js", "AndroidManifest.xml", "pubspec.yaml", "platformio.ini", "train.py",
    "main.tf", "Gemfile", "Podfile", "hardhat.config.js", "glasses_view.swift", "docker-compose.yml", "App.py",
    "build.gradle", "notes.m",
]
PAGE_LINES = "\nnode.innerHTML = text\nkey: AIzaABCDEFGHIJKLMNOPQRSTUVWXYZ012345678\nprivileged: true"
MANIFEST_NAMES = ["package.json", "requirements.txt", "pyproject.toml", "README.md"]
MANIFEST_TEXTS = ['{"dependencies": {"express": "*"}}', "LangChain==0.2\nrequests==2.0", "flask==3.0"]
IGNORE_TEXT = "# not ours\n\ngenerated/\n  *.rb \ndocs\n/lib/*[13579].?s\nsrc\\pages\n#docs/\n"
CONFIG_TEXTS = [
    '{"fail_threshold": "HIGH", "include_domains": ["web", "ai_ml"], "baseline_file": ".security_baseline.json"}',
    '{"exclude_domains": ["mobile", "code_quality"], "ignore_patterns": ["*.tf"], "baseline_file": ".security_baseline.json"}',
    '{"fail_threshold": "INFO", "include_domains": ["pipeline", "other"], "exclude_domains": ["web"]}',
    '{"fail_threshold": "URGENT", "dependency_audit": {"enabled": false}}',
    '{"fail_threshold": "MEDIUM", "dependency_audit": {"tools": ["pip-audit"]}, "baseline_file": ".security_baseline.json"}',
    '{"fail_threshold": "LOW", oops}',
]
YAML_TEXT = (
    "# settings\nfail_threshold: 'HIGH'\ninclude_domains:\n  - web\n  - ai_ml\n\nignore_patterns: [\"*.js\", docs/, \"a\tb.txt\"]\n"
    "dependency_audit:\n  enabled: false\nbaseline_file: .security_baseline.json\n"
)


# Files tables already written by this process: (application, input folder) -> table.
_STORED: dict[tuple[str, str], DataFrame] = {}


def example_block(no: int, rule_id: str) -> str:
    """A hit, far from it a near miss, and for rules with a cancelling pattern a hit
    with the cancelling line one to seven lines below."""
    _, hit, miss, *cancel = EXAMPLES[rule_id]
    far = "\n" * 12
    return hit + far + miss + (far + hit + "\n" * (1 + no % 7) + cancel[0] if cancel else "")


def plants() -> list[tuple[int, str, str, str]]:
    """``(no, rule_id, end of the path, text)``."""
    return [(i, r, EXAMPLES[r][0], example_block(i, r)) for i, r in enumerate(EXAMPLES)]


def multiline_plants() -> list[tuple[int, str, str, str]]:
    """As :func:`plants`: a match over several lines, a near miss, and a match that is cancelled."""
    far, rows = "\n" * 12, []
    for no, (rule_id, (tail, hit, miss, cancel)) in enumerate(MULTILINE_EXAMPLES.items()):
        cancelled = far + hit + "\n" * (1 + no % 3) + cancel if cancel else ""
        rows.append((no, rule_id, tail, hit + far + miss + cancelled))
    return rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return deal_splits(configure(spark)).read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], by: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), by.cast("int"))


def plant(docs: DataFrame, planted: list[tuple[int, str, str, str]] | None = None) -> DataFrame:
    """Place each row of ``documents``, batch or stream, in a repository."""
    planted = planted or plants()
    rows = docs.sparkSession.createDataFrame(planted, "no INT, rule_id STRING, tail STRING, planted STRING")
    repo = F.concat("source", F.lit("-"), F.expr("(doc_id div 20) % 6").cast("string"))
    path = F.concat(_pick(DIRECTORIES, F.col("doc_id") % len(DIRECTORIES)), F.lit("/"), F.col("doc_id").cast("string"), "tail")
    # The planted rows are a fixed list, one per rule.
    return docs.join(F.broadcast(rows), F.col("doc_id") % len(planted) == F.col("no")).select(
        repo.alias("repo_id"), "doc_id", "rule_id", path.alias("path"), "text",
        F.concat("text", F.lit("\n"), "planted").alias("content"),
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plant(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("repo_id", "path", "content")


def multiline_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file that ends in a block of :func:`multiline_plants`."""
    files = plant(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), multiline_plants())
    return files.select("repo_id", "path", "content", F.octet_length("content").cast("bigint").alias("size"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(spread(table(spark, sf_dir, "pages"))).drop("page_id")


def as_files(pages: DataFrame) -> DataFrame:
    """Each row of ``pages``, batch or stream, as a file of its site."""
    name = _pick(PAGE_NAMES, F.col("page_id") % len(PAGE_NAMES))
    return pages.select(
        "page_id", F.regexp_extract("url", "https?://([^/]+)", 1).alias("repo_id"),
        F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit("/"), name).alias("path"),
        F.concat("html", F.lit(PAGE_LINES)).alias("content"),
    )


def root_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest and settings files, chosen by the first document of the repository."""
    docs = _documents(spark, sf_dir)
    # Stored, so that its size decides how it is joined: texts stay where they are if there are few repositories.
    least = materialize(docs.groupBy("repo_id").agg(F.min(F.struct("doc_id", "rule_id", "path")).alias("least")))
    # Lines are counted in the first documents only, one of each repository, or more that agree in all three.
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"l.{at}")) for c, at in [("repo_id", "repo_id"), *[(c, f"least.{c}") for c in ("doc_id", "rule_id", "path")]]]
    first_line = F.min(F.struct((F.size(split_lines(F.col("d.text"))) + 1).alias("line")))
    first = docs.alias("d").join(least.alias("l"), reduce(and_, same)).groupBy("d.repo_id", "l.least").agg(first_line.alias("f"))
    first = first.select("repo_id", "least.*", "f.line")
    d = F.col("doc_id")
    key = F.concat_ws(":", "rule_id", "path", F.col("line").cast("string"))
    as_text = F.concat(F.lit('{"accepted_findings": ["'), key, F.lit('", "X-1:none.py:1"]}'))
    as_object = F.concat(
        F.lit('{"accepted_findings": [{"id": "'), "rule_id", F.lit('", "file": "'), "path", F.lit('", "line": '),
        F.col("line").cast("string"), F.lit("}]}"),
    )
    as_list = F.concat(F.lit('["'), key, F.lit('"]'))

    def entry(condition: Column, path: Column, content: Column) -> Column:
        return F.when(condition, F.struct(path.alias("path"), content.alias("content")))

    baseline = F.when(d % 3 == 0, as_text).when(d % 3 == 1, as_object).otherwise(as_list)
    entries = F.array(
        entry(F.lit(True), _pick(MANIFEST_NAMES, d % 4), _pick(MANIFEST_TEXTS, d % 3)),
        entry(d % 3 == 0, F.lit(".securityignore"), F.lit(IGNORE_TEXT)),
        entry(d % 4 == 1, F.lit(".security-agent.json"), _pick(CONFIG_TEXTS, F.expr("doc_id div 4") % len(CONFIG_TEXTS))),
        entry(d % 4 == 2, F.lit(".security-agent.yml"), F.lit(YAML_TEXT)),
        entry(d % 2 == 1, F.lit(".security_baseline.json"), baseline),
    )
    return first.select("repo_id", F.inline(F.filter(entries, lambda e: e.isNotNull())))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus as a stored files table, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = build_files(spark, sf_dir)
    return _STORED[key]


def build_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = document_files(spark, sf_dir).unionByName(page_files(spark, sf_dir))
    everything = texts.unionByName(root_files(spark, sf_dir))
    return materialize(everything.withColumn("size", F.octet_length("content").cast("bigint")))


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit tool outputs made from order lines: one output per line, one package in it,
    the tool and the shape of the output chosen by the line's columns."""
    columns = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag", "l_linestatus"]
    line = spread(table(spark, sf_dir, "lineitem").select(*columns))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    c, text = F.col, lambda x: F.col(x).cast("string")
    flag = c("l_returnflag")
    version = F.concat(text("l_linenumber"), F.lit("."), F.col("l_quantity").cast("int").cast("string"))
    count = F.round(c("l_tax") * 100).cast("int") % 3

    def vulns(prefix: str, note: str, extra: dict[str, Column]) -> Column:
        one = lambda i: F.struct(
            F.concat(F.lit(prefix), text("l_partkey"), F.lit("-"), i.cast("string")).alias("id"),
            F.when(flag != "A", F.concat(F.lit("issue in "), c("p_name"))).alias(note),
            *[v.alias(k) for k, v in extra.items()],
        )
        return F.transform(F.filter(F.array(F.lit(1), F.lit(2)), lambda i: i <= count), one)

    fixes = F.when(c("l_linestatus") == "O", F.array(version, F.lit("9.9")))
    pip = F.to_json(F.struct(F.array(F.struct(
        c("p_name").alias("name"), version.alias("version"), vulns("PYSEC-", "description", {"fix_versions": fixes}).alias("vulns"),
    )).alias("dependencies")))
    via = (
        F.when(flag == "A", F.lit('["minimist"]'))
        .when(flag == "N", F.concat(F.lit('[{"source": '), text("l_partkey"), F.lit(', "name": "x"}]')))
        .otherwise(F.lit('"direct"'))
    )
    levels = F.get(F.array(*map(F.lit, ["critical", "high", "moderate", "Medium", "low", "odd"])), c("l_linenumber").cast("int") % 6)
    npm = F.concat(
        F.lit('{"vulnerabilities": {"'), c("p_name"), F.lit('": {"via": '), via, F.lit(', "severity": "'), levels, F.lit('"'),
        F.when(flag != "A", F.concat(F.lit(', "title": "flaw in '), c("p_name"), F.lit('"'))).otherwise(F.lit("")),
        F.when(c("l_linestatus") == "O", F.lit(', "fixAvailable": "take 2.0"')).otherwise(F.lit(', "fixAvailable": true')),
        F.lit("}}}"),
    )
    osv = F.to_json(F.struct(F.array(F.struct(
        F.struct(F.when(flag == "N", F.lit("sub/pom.xml")).alias("path")).alias("source"),
        F.array(F.struct(
            F.struct(c("p_name").alias("name"), version.alias("version")).alias("package"),
            vulns("OSV-", "summary", {}).alias("vulnerabilities"),
        )).alias("packages"),
    )).alias("results")))
    which = c("l_linenumber") % 3
    output = F.when(which == 0, pip).when(which == 1, npm).otherwise(osv)
    quantity = c("l_quantity")
    return rows.select(
        F.concat(F.lit("order-"), text("l_orderkey")).alias("repo_id"),
        F.when(which == 0, "pip-audit").when(which == 1, "npm-audit").otherwise("osv-scanner").alias("tool"),
        F.when(quantity == 50, "missing").otherwise("ok").alias("status"),
        F.when(quantity == 7, F.lit("no { json")).when(quantity == 9, F.lit("")).otherwise(output).alias("stdout"),
        F.when(c("l_linestatus") == "O", F.lit("tool broke")).otherwise(F.lit("")).alias("stderr"),
    )
