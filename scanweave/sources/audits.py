"""Dependency findings from the JSON three audit tools print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import audit_severity
from ..schemas import FINDING, NPM_JSON, OSV_JSON, PIP_JSON, SEQ

# Per tool, how findings name it, the manifest it needs, its place.
TOOLS = {
    "pip-audit": ("pip-audit", "requirements.txt", 1),
    "npm-audit": ("npm audit", "package.json", 2),
    "osv-scanner": ("osv-scanner", None, 3),
}
# What is reported when the tool's output leaves it out.
PIP_TEXT, PIP_FIX = "Python dependency vulnerability detected.", "Upgrade to a non-vulnerable version."
NPM_TEXT, NPM_FIX = "Node dependency vulnerability detected.", "Run npm audit fix where safe."
OSV_TEXT, OSV_FIX = "Dependency vulnerability detected by OSV.", "Upgrade to a fixed version listed by OSV."
OSV_FILE = "dependency manifest"
# What is reported when a tool is missing or fails, around the tool's and the manifest's name.
INVALID = "Invalid JSON output"
MISSING_TEXT = (" is not available, so dependency audit for ", " was skipped.")
MISSING_FIX = ("Install ", " in CI or disable it in .security-agent.yml.")
FAILED_TEXT, FAILED_FIX = " could not complete dependency audit.", "Review tool installation and manifest validity."
CATEGORY, OWASP, CWE = "Dependency Security", "A06:2021", "CWE-1104"


def selected_audits(audits: DataFrame, configs: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """The audit outputs a repository's configuration and manifests ask for."""
    if configs is not None:
        wanted = configs.where("dependency_audit.enabled").select(
            "repo_id", F.explode("dependency_audit.tools").alias("tool")
        )
        audits = audits.join(wanted.distinct(), ["repo_id", "tool"], "left_semi")
    if files is not None:
        needed = {tool: manifest for tool, (_, manifest, _) in TOOLS.items() if manifest}
        tool = F.create_map(*[F.lit(x) for pair in needed.items() for x in reversed(pair)])
        present = files.where(F.col("path").isin(list(needed.values())))
        present = present.select("repo_id", F.element_at(tool, F.col("path")).alias("tool")).distinct()
        unbound = audits.where(~F.col("tool").isin(list(needed)))
        audits = audits.where(F.col("tool").isin(list(needed))).join(present, ["repo_id", "tool"], "left_semi").unionByName(unbound)
    return audits


def audit_findings(audits: DataFrame) -> DataFrame:
    """Findings of all tools, and one INFO row where a tool is missing or failed."""
    return (
        pip_findings(audits)
        .unionByName(npm_findings(audits))
        .unionByName(osv_findings(audits))
        .unionByName(tool_problems(audits))
    )


def _output(audits: DataFrame, tool: str) -> DataFrame:
    ran = audits.where((F.col("tool") == tool) & (F.col("status") != "missing"))
    return ran.where(F.coalesce("stdout", F.lit("")) != "")


def pip_findings(audits: DataFrame) -> DataFrame:
    parsed = _output(audits, "pip-audit").select("repo_id", F.from_json("stdout", PIP_JSON)["dependencies"].alias("d"))
    deps = parsed.select("repo_id", F.posexplode("d").alias("i", "d"))
    vulns = deps.select("repo_id", "i", "d.name", "d.version", F.posexplode("d.vulns").alias("j", "v"))
    fixes = F.array_join("v.fix_versions", ", ")
    return vulns.select(
        "repo_id",
        *_finding(
            "pip-audit", F.col("name"), F.col("version"), F.col("v.id"), F.coalesce("v.description", F.lit(PIP_TEXT)),
            F.when(fixes != "", fixes).otherwise(F.lit(PIP_FIX)), F.lit("requirements.txt"),
        ),
        _item("i", "j"),
    )


def npm_findings(audits: DataFrame) -> DataFrame:
    parsed = _output(audits, "npm-audit").select("repo_id", F.from_json("stdout", NPM_JSON)["vulnerabilities"].alias("v"))
    rows = parsed.select("repo_id", F.posexplode("v").alias("i", "package", "a"))
    via = F.get("a.via", F.lit(0))
    vuln = F.coalesce(F.when(via.startswith("{"), F.get_json_object(via, "$.source")), via)
    fix = F.when(F.schema_of_variant("a.fixAvailable") == "STRING", F.variant_get("a.fixAvailable", "$", "string"))
    return rows.select(
        "repo_id",
        *_finding(
            "npm-audit", F.col("package"), F.lit("unknown"), vuln, F.coalesce("a.title", F.lit(NPM_TEXT)),
            F.coalesce(fix, F.lit(NPM_FIX)), F.lit("package.json"), audit_severity(F.col("a.severity")),
        ),
        F.col("i").cast("bigint").alias("item_no"),
    )


def osv_findings(audits: DataFrame) -> DataFrame:
    parsed = _output(audits, "osv-scanner").select("repo_id", F.from_json("stdout", OSV_JSON)["results"].alias("r"))
    results = parsed.select("repo_id", F.posexplode("r").alias("h", "r"))
    packages = results.select("repo_id", "h", F.col("r.source.path").alias("path"), F.posexplode("r.packages").alias("i", "p"))
    vulns = packages.select("repo_id", "h", "path", "i", "p", F.posexplode("p.vulnerabilities").alias("j", "v"))
    return vulns.select(
        "repo_id",
        *_finding(
            "osv-scanner", F.col("p.package.name"), F.coalesce("p.version", "p.package.version"), F.col("v.id"),
            F.coalesce("v.summary", F.lit(OSV_TEXT)), F.lit(OSV_FIX), F.coalesce("path", F.lit(OSV_FILE)),
        ),
        _item("h", "i", "j"),
    )


def _is_json(column: str) -> Column:
    """Whether the text is a JSON document, of any size, repeated keys included."""
    options = {"columnNameOfCorruptRecord": "broken", "allowSingleQuotes": "false"}
    text = F.trim(F.col(column), F.lit(" \t\r\n"))
    # Read as a member of an object, so that lists and plain values count too; the member
    # after it is lost if the text closes the object itself.
    whole = F.from_json(F.concat(F.lit('{"v":'), text, F.lit(',"after":1}')), "v STRING, after INT, broken STRING", options)
    return F.coalesce(whole["broken"].isNull() & (whole["after"] == 1), F.lit(False))


def tool_problems(audits: DataFrame) -> DataFrame:
    """INFO rows: a tool that is not installed, or whose output is not JSON."""
    title = F.create_map(*[F.lit(x) for tool, (name, _, _) in TOOLS.items() for x in (tool, name)])
    place = F.create_map(*[F.lit(x) for tool, (_, _, no) in TOOLS.items() for x in (tool, no)])
    manifest = F.create_map(*[F.lit(x) for tool, (_, m, _) in TOOLS.items() if m for x in (tool, m)])
    missing = F.col("status") == "missing"
    reported = F.col("tool").isin([t for t, (_, m, _) in TOOLS.items() if m])
    bad = (F.coalesce("stdout", F.lit("")) != "") & ~_is_json("stdout")
    rows = audits.where((missing & reported) | (~missing & bad)).withColumns(
        {"t": F.element_at(title, F.col("tool")), "m": F.element_at(manifest, F.col("tool")), "missing": missing}
    )
    error = F.when(F.coalesce("stderr", F.lit("")) != "", F.col("stderr")).otherwise(F.lit(INVALID))

    def either(if_missing: Column, if_failed: Column, name: str) -> Column:
        return F.when(F.col("missing"), if_missing).otherwise(if_failed).alias(name)

    t, tool_id, m = F.col("t"), F.replace(F.upper("t"), F.lit(" "), F.lit("-")), F.col("m")
    return rows.select(
        "repo_id",
        F.concat(either(F.lit("DEP-TOOL-MISSING-"), F.lit("DEP-TOOL-ERROR-"), "id"), tool_id).alias("id"),
        F.lit(CATEGORY).alias("category"),
        F.concat(t, either(F.lit(" not installed"), F.lit(" failed"), "name")).alias("name"),
        F.lit("INFO").alias("severity"),
        either(
            F.concat(t, F.lit(MISSING_TEXT[0]), m, F.lit(MISSING_TEXT[1])),
            F.concat(t, F.lit(FAILED_TEXT)), "description",
        ),
        either(
            F.concat(F.lit(MISSING_FIX[0]), t, F.lit(MISSING_FIX[1])),
            F.lit(FAILED_FIX), "fix",
        ),
        either(m, F.lit(OSV_FILE), "file"),
        F.lit(0).alias("line"),
        F.lit("").alias("code"),
        either(F.lit(""), F.substring(error, 1, 500), "context"),
        F.lit(OWASP).alias("owasp"),
        F.lit("").alias("cwe"),
        F.element_at(place, F.col("tool")).alias("phase"),
        F.lit(0).alias("rule_order"),
        F.lit(0).cast("bigint").alias("item_no"),
    ).select(*FINDING, *[c for c in SEQ if c not in FINDING])


def _finding(tool, package, version, vuln, text, fix, file, severity=None) -> list[Column]:
    name, _, place = TOOLS[tool]
    package, version, vuln = (F.coalesce(c, F.lit("unknown")) for c in (package, version, vuln))
    severity = F.lit("HIGH") if severity is None else severity
    return [
        F.lit("DEP-" + name.upper().replace(" ", "-")).alias("id"),
        F.lit(CATEGORY).alias("category"),
        F.concat(package, F.lit(" vulnerable dependency")).alias("name"),
        severity.alias("severity"),
        F.concat(text, F.lit(" ("), vuln, F.lit(", installed: "), version, F.lit(")")).alias("description"),
        fix.alias("fix"),
        file.alias("file"),
        F.lit(0).alias("line"),
        package.alias("code"),
        F.concat(F.lit(f"{name} reported "), package, F.lit(" "), version, F.lit(": "), vuln).alias("context"),
        F.lit(OWASP).alias("owasp"),
        F.lit(CWE).alias("cwe"),
        F.lit(place).alias("phase"),
        F.lit(0).alias("rule_order"),
    ]


def _item(*positions: str) -> Column:
    """Place of an item in a nested list, as one number that keeps the order."""
    number = F.lit(0).cast("bigint")
    for p in positions:
        number = number * (1 << 20) + F.col(p)
    return number.alias("item_no")
