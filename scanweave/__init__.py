"""Code-security analytics over many repositories, on Spark DataFrames."""

from .plans.scan import Scan, full_scan, scan
from .rules.catalog import builtin_rules, merge_rules, rules_frame
from .session import configure, materialize

__all__ = ["Scan", "builtin_rules", "configure", "full_scan", "materialize", "merge_rules", "rules_frame", "scan"]
