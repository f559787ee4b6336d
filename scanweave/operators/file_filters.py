"""Which files belong to a repository, and which of them are scanned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import glob_regex, has_wildcard, normalise
from ..functions.paths import directories, file_name, prefixes, suffix

# Directories that are not part of the project.
WALK_SKIP = [
    "node_modules", ".git", "__pycache__", ".pytest_cache", "venv", "env", ".env", "dist", "build", "target",
    ".gradle", ".idea", ".vscode", "vendor", "Pods", ".dart_tool", ".pub-cache", "coverage", "htmlcov", "eggs",
    ".eggs", "site-packages", ".tox", "fixtures", "testdata", ".tmp",
]
# Path parts that are additionally not scanned.
SCAN_SKIP = WALK_SKIP + ["migrations", ".mypy_cache", ".ruff_cache", "jspm_packages"]
# Suffixes of files that hold no text.
BINARY_SUFFIXES = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".pdf", ".zip", ".tar", ".gz", ".rar", ".7z", ".exe",
    ".dll", ".so", ".dylib", ".class", ".jar", ".war", ".ear", ".pyc", ".pyo", ".bin", ".hex", ".elf", ".o", ".a",
    ".woff", ".woff2", ".ttf", ".eot", ".mp3", ".mp4", ".webm", ".avi", ".mov", ".lock",
]
# Fixed value: with ``parity`` larger files are not scanned.
PARITY_FILE_BYTES = 500_000
# Join keys over which the paths of one repository are dealt out.
GLOB_SALTS = 16


def in_project(path: Column) -> Column:
    """True unless a directory on the path is skipped or hidden (two hidden ones count)."""

    def dropped(part: Column) -> Column:
        hidden = part.startswith(".") & ~part.isin(".github", ".gitlab")
        return part.isin(WALK_SKIP) | hidden

    return ~F.exists(directories(path), dropped)


def project_files(files: DataFrame) -> DataFrame:
    """The files of each repository."""
    return files.where(in_project(F.col("path")))


def scannable(path: Column, size: Column, parity: bool = False, max_bytes: int | None = None) -> Column:
    """True for files whose lines are matched, of any size unless ``max_bytes`` is given.

    By default only directories are compared with the skip list.  With ``parity`` the
    file name is compared too, which hides a committed ``.env``, and files over
    500,000 bytes are left out.
    """
    max_bytes = PARITY_FILE_BYTES if parity and max_bytes is None else max_bytes
    parts = F.split(path, "/") if parity else directories(path)
    skipped = F.exists(parts, lambda part: part.isin(SCAN_SKIP))
    return ~skipped & ~suffix(file_name(path)).isin(BINARY_SUFFIXES) & (F.lit(True) if max_bytes is None else size <= max_bytes)


def ignored_paths(paths: DataFrame, ignores: DataFrame) -> DataFrame:
    """The ``(repo_id, path)`` that an ignore glob of their repository covers, some twice.

    A glob ending in ``/`` covers a directory; any other glob covers the path itself
    and everything under it.  Globs without wildcards are found by equality with the
    path or one of its directories, so a repository with many of them needs no
    pairwise test.  Only wildcard globs are tried one by one, in a semi join that stops
    at the first match and emits no pairs; a repository's paths are dealt out over
    several keys for it.
    """
    globs = ignores.select("repo_id", normalise(F.col("glob")).alias("glob")).where("glob != ''")
    as_directory = F.col("glob").endswith("/")
    plain = globs.where(as_directory | ~has_wildcard(F.col("glob")))
    plain = plain.select(
        "repo_id",
        F.explode(F.when(as_directory, F.array("glob")).otherwise(F.array("glob", F.concat("glob", F.lit("/"))))).alias("start"),
    )
    wild = globs.where(~as_directory & has_wildcard(F.col("glob")))
    wild = wild.select(
        F.col("repo_id").alias("w_repo"),
        glob_regex(F.col("glob"), and_below=True).alias("regex"),
        F.explode(F.sequence(F.lit(0), F.lit(GLOB_SALTS - 1))).alias("w_salt"),
    )
    paths = paths.select("repo_id", "path")
    starts = paths.select("*", F.explode(F.array_append(prefixes(F.col("path")), F.col("path"))).alias("start"))
    by_start = starts.join(plain, ["repo_id", "start"], "left_semi").select("repo_id", "path")
    dealt = paths.withColumn("salt", F.pmod(F.hash("path"), F.lit(GLOB_SALTS)))
    same = (dealt["repo_id"] == wild["w_repo"]) & (dealt["salt"] == wild["w_salt"])
    by_glob = dealt.join(wild, same & F.rlike(dealt["path"], wild["regex"]), "left_semi").select("repo_id", "path")
    return by_start.union(by_glob)


def not_ignored(hits: DataFrame, ignores: DataFrame) -> DataFrame:
    """``hits(repo_id, path, ..)``, batch or stream, without those an ignore glob covers.

    A stream joins the patterns without state, and a pattern is tested once per hit.
    """
    covered = F.coalesce(F.rlike(F.col("path"), F.col("_ignored")), F.lit(False))
    return hits.join(ignore_patterns(ignores), "repo_id", "left").where(~covered).drop("_ignored")


def ignore_patterns(ignores: DataFrame) -> DataFrame:
    """``(repo_id, _ignored)``: the globs of a repository as one pattern, a static row."""
    globs = ignores.select("repo_id", normalise(F.col("glob")).alias("glob")).where("glob != ''")
    directory = F.concat(F.lit(r"(?s)\A"), F.regexp_replace("glob", r"([^\p{L}\p{N}_/])", r"\\$1"), F.lit(".*"))
    regex = F.when(F.col("glob").endswith("/"), directory).otherwise(glob_regex(F.col("glob"), and_below=True))
    return globs.select("repo_id", regex.alias("regex")).groupBy("repo_id").agg(
        F.concat(F.lit("(?:"), F.array_join(F.array_sort(F.collect_set("regex")), ")|(?:"), F.lit(")")).alias("_ignored")
    )
