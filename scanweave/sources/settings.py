"""Per-repository settings: configuration, ignore lists, accepted findings.

All three can come as tables.  The readers here take them from the repositories'
own files instead, which are found by path, so only those rows' content is read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import finding_key
from ..functions.text import LINE_BREAK, drop_last_empty, strip
from ..operators.membership import maybe_member
from ..schemas import CONFIG_JSON
from .simple_yaml import yaml_to_json

# Names of the settings files, the first that exists counts.
CONFIG_FILES = [".security-agent.json", ".security-agent.yml", ".security-agent.yaml"]
IGNORE_FILE = ".securityignore"
# Defaults.
FAIL_THRESHOLD = "CRITICAL"
AUDIT_TOOLS = ["pip-audit", "npm-audit", "osv-scanner"]


def with_defaults(configs: DataFrame) -> DataFrame:
    """Fill every missing field with its default, also inside ``dependency_audit``."""
    none = F.array().cast("array<string>")
    tools = F.array(*map(F.lit, AUDIT_TOOLS))
    asked = F.col("dependency_audit.tools")
    return configs.select(
        "repo_id",
        "config_path",
        F.coalesce("fail_threshold", F.lit(FAIL_THRESHOLD)).alias("fail_threshold"),
        *[F.coalesce(c, none).alias(c) for c in ("include_domains", "exclude_domains", "ignore_patterns")],
        "baseline_file",
        F.struct(
            F.coalesce("dependency_audit.enabled", F.lit(True)).alias("enabled"),
            F.when(F.size(asked) > 0, asked).otherwise(tools).alias("tools"),
        ).alias("dependency_audit"),
    )


def _parsed_configs(files: DataFrame, explicit_path: str | None) -> DataFrame:
    """``(repo_id, config_path, c)``: the settings file of each repository that has one."""
    names = [explicit_path] if explicit_path else CONFIG_FILES
    order = F.array_position(F.array(*map(F.lit, names)), F.col("path"))
    found = (
        files.where(F.col("path").isin(names))
        .groupBy("repo_id")
        .agg(F.min_by(F.struct("path", "content"), order).alias("file"))
        .select("repo_id", F.col("file.path").alias("config_path"), F.col("file.content").alias("content"))
    )
    as_json = F.when(F.col("config_path").endswith(".json"), F.col("content")).otherwise(yaml_to_json(F.col("content")))
    options = {"columnNameOfCorruptRecord": "broken", "allowSingleQuotes": "false"}
    return found.select("repo_id", "config_path", F.from_json(as_json, CONFIG_JSON + ", broken STRING", options).alias("c"))


def configs_from_files(files: DataFrame, explicit_path: str | None = None, shared: str | None = None) -> DataFrame:
    """One row per repository, defaults filled in; read from its settings file if any.

    ``explicit_path`` names the file (relative to the repository) to use instead.
    ``shared`` is the JSON text of a configuration for all repositories; files are not
    read then.  A file that cannot be read counts as empty: see :func:`config_problems`.
    """
    repos = files.select("repo_id").distinct()
    if shared is not None:
        json.loads(shared)  # refuses what is no JSON
        one = F.from_json(F.lit(shared), CONFIG_JSON)
        return with_defaults(repos.select("repo_id", F.lit(None).cast("string").alias("config_path"), one.alias("c")).select("repo_id", "config_path", "c.*"))
    parsed = _parsed_configs(files, explicit_path)
    return with_defaults(repos.join(parsed.select("repo_id", "config_path", "c.*").drop("broken"), "repo_id", "left"))


def config_problems(files: DataFrame, explicit_path: str | None = None) -> DataFrame:
    """``(repo_id, path, reason)``: settings files whose content could not be read as settings."""
    parsed = _parsed_configs(files, explicit_path)
    bad = parsed.where("c IS NULL OR c.broken IS NOT NULL")
    return bad.select("repo_id", F.col("config_path").alias("path"), F.lit("not valid JSON, or a value of another type").alias("reason"))


def ignores_from_files(files: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """``(repo_id, glob)`` from the ignore files and from the configurations."""
    lines = F.explode(drop_last_empty(F.split("content", LINE_BREAK, -1)))
    own = (
        files.where(F.col("path") == IGNORE_FILE)
        .select("repo_id", lines.alias("line"))
        .select("repo_id", strip(F.col("line")).alias("line"))
        .where(~F.col("line").startswith("#") & (F.col("line") != ""))
        .select("repo_id", F.replace("line", F.lit("\\"), F.lit("/")).alias("glob"))
    )
    if configs is None:
        return own
    return own.unionByName(configs.select("repo_id", F.explode("ignore_patterns").alias("glob")))


def accepted_keys(content: Column) -> Column:
    """Array of finding keys in a baseline document; empty when it cannot be read.

    Entries are keys, or objects with ``id``, ``file`` and ``line``; the list may be
    the whole document.
    """
    entries = F.coalesce(
        F.from_json(content, "accepted_findings ARRAY<STRING>")["accepted_findings"],
        F.from_json(content, "ARRAY<STRING>"),
        F.array().cast("array<string>"),
    )

    def part(entry: Column, name: str) -> Column:
        return F.coalesce(F.get_json_object(entry, f"$.{name}"), F.lit("None"))

    def key(entry: Column) -> Column:
        of_object = finding_key(part(entry, "id"), part(entry, "file"), part(entry, "line"))
        return F.when(entry.startswith("{"), of_object).otherwise(entry)

    return F.transform(F.filter(entries, lambda e: e.isNotNull()), key)


def baseline_from_files(files: DataFrame, configs: DataFrame) -> DataFrame:
    """``(repo_id, finding_key)`` from the file each configuration names.

    A filter made of the names is tested where the files are, so only contents that are
    asked for are moved.
    """
    named = configs.where("baseline_file IS NOT NULL").select("repo_id", F.col("baseline_file").alias("path"))
    keys = [F.col("repo_id"), F.col("path")]
    maybe = maybe_member(files.select("repo_id", "path", "content"), keys, named, keys, "named").where("named")
    return (
        maybe.join(named, ["repo_id", "path"], "left_semi")
        .select("repo_id", F.explode(accepted_keys(F.col("content"))).alias("finding_key"))
        .distinct()
    )
