"""Table schemas, as Spark DDL."""

FILES = "repo_id STRING, path STRING, content STRING, size BIGINT"

RULES = (
    "rule_id STRING, domain STRING, category STRING, name STRING, severity STRING, pattern STRING, "
    "negative_pattern STRING, description STRING, fix STRING, langs ARRAY<STRING>, owasp STRING, cwe STRING, "
    "file_check BOOLEAN, rule_order INT"
)
REJECTED = "position INT, rule_id STRING, reason STRING"

CONFIGS = (
    "repo_id STRING, config_path STRING, fail_threshold STRING, include_domains ARRAY<STRING>, "
    "exclude_domains ARRAY<STRING>, ignore_patterns ARRAY<STRING>, baseline_file STRING, "
    "dependency_audit STRUCT<enabled: BOOLEAN, tools: ARRAY<STRING>>"
)
# One repository's configuration file: the same fields without the keys.
CONFIG_JSON = (
    "fail_threshold STRING, include_domains ARRAY<STRING>, exclude_domains ARRAY<STRING>, "
    "ignore_patterns ARRAY<STRING>, baseline_file STRING, "
    "dependency_audit STRUCT<enabled: BOOLEAN, tools: ARRAY<STRING>>"
)
IGNORES = "repo_id STRING, glob STRING"
BASELINE = "repo_id STRING, finding_key STRING"
AUDIT_RAW = "repo_id STRING, tool STRING, status STRING, stdout STRING, stderr STRING"

PIP_JSON = (
    "dependencies ARRAY<STRUCT<name: STRING, version: STRING, "
    "vulns: ARRAY<STRUCT<id: STRING, description: STRING, fix_versions: ARRAY<STRING>>>>>"
)
NPM_JSON = (
    "vulnerabilities MAP<STRING, STRUCT<via: ARRAY<STRING>, title: STRING, severity: STRING, fixAvailable: VARIANT>>"
)
OSV_JSON = (
    "results ARRAY<STRUCT<source: STRUCT<path: STRING>, packages: ARRAY<STRUCT<"
    "package: STRUCT<name: STRING, version: STRING>, version: STRING, "
    "vulnerabilities: ARRAY<STRUCT<id: STRING, summary: STRING>>>>>>"
)

# The columns of a finding that a report shows, in order.
FINDING = [
    "repo_id", "id", "category", "name", "severity", "description", "fix", "file", "line", "code", "context",
    "owasp", "cwe",
]
# Where a finding stands in its repository's output: static findings by path, rule
# and line, then dependency findings by tool.
SEQ = ["phase", "file", "rule_order", "line", "item_no"]
