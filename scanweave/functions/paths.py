"""Repo-relative POSIX path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """Last suffix in lower case; a leading dot alone (``.env``) is not a suffix."""
    return F.lower(F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1))


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit(""))


def prefixes(path: Column) -> Column:
    """``a/b/c.py`` -> ``[a/, a/b/]``."""
    dirs = directories(path)
    return F.transform(dirs, lambda _, i: F.concat(F.array_join(F.slice(dirs, F.lit(1), i + 1), "/"), F.lit("/")))
