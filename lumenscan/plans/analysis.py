"""Whole analyses: a diff or a set of files to one table of issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.catalog.loader import RuleBundle, SecretRule
from lumenscan.operators import autofix, iac, sast, secrets
from lumenscan.operators.sast import AnalysisOptions
from lumenscan.operators.secrets import ScanOptions
from lumenscan.sources.files import diff_lines, numbered


def diff_issues(diffs: DataFrame, bundle: RuleBundle, options: AnalysisOptions | None = None, secret_rules: list[SecretRule] | None = None) -> DataFrame:
    """Rule issues of a diff's lines, then secrets; each part sorted and cut by itself. Secrets of every severity are kept."""
    options = options or AnalysisOptions()
    lines = diff_lines(diffs, options.only_new_code)
    out = sast.scan_diff_lines(lines, bundle, options)
    if not options.secret_detection_enabled:
        return out
    own = ScanOptions(options.ignore_paths, options.max_issues, "low", options.include_rules, options.exclude_rules)
    return out.unionByName(secrets.as_issues(secrets.scan_lines(lines, own, secret_rules)))


def file_issues(file_rows: DataFrame, bundle: RuleBundle, options: AnalysisOptions | None = None, secret_rules: list[SecretRule] | None = None) -> DataFrame:
    """Rule issues of whole files, then secrets, whatever the path."""
    options = options or AnalysisOptions()
    rows = numbered(file_rows)
    out = sast.scan_files(rows, bundle, options)
    if not options.secret_detection_enabled:
        return out
    own = ScanOptions([], options.max_issues, "low", options.include_rules, options.exclude_rules)
    return out.unionByName(secrets.as_issues(secrets.scan_contents(rows, own, secret_rules)))


def iac_issues(file_rows: DataFrame, options: ScanOptions | None = None) -> DataFrame:
    return iac.as_issues(iac.scan_contents(file_rows, options))


def fixes(issues: DataFrame, bundle: RuleBundle, max_fixes: int | None = None) -> DataFrame:
    return autofix.auto_fixes(issues, bundle, max_fixes)


def issue_counts(issues: DataFrame) -> DataFrame:
    """source, category, severity, issues."""
    return issues.groupBy("source", "category", "severity").agg(F.count("*").alias("issues"))
