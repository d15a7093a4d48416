"""Rule scans of source code: every rule of a file's language may report a line once."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenscan.catalog.loader import RuleBundle, java_regex, python_regex
from lumenscan.functions.paths import file_name, is_traversal, matches_globs
from lumenscan.functions.text import issue_category, parsed_minimum, rule_severity, severity_rank, trimmed
from lumenscan.operators.matching import tested
from lumenscan.sources.files import embedded_shell, lines, numbered

CI_LANGUAGES = ("github-actions", "gitlab-ci", "azure-pipelines")
CONFIDENCE = 0.85
ISSUE_COLUMNS = ("rule_id", "file_path", "line_start", "line_end", "severity", "category", "title", "description", "suggestion", "code_snippet", "confidence", "source")


@dataclass
class AnalysisOptions:
    ignore_paths: list[str] = field(default_factory=list)
    max_issues: int | None = None
    minimum_severity: str = "info"
    include_rules: list[str] = field(default_factory=list)
    exclude_rules: list[str] = field(default_factory=list)
    only_new_code: bool = True
    secret_detection_enabled: bool = True

    @classmethod
    def from_job(cls, job: dict) -> AnalysisOptions:
        """From a job's settings; those that analysis does not use are passed over."""
        own = {k: job[k] for k in cls.__dataclass_fields__ if job.get(k) is not None}
        return cls(**own | {"minimum_severity": parsed_minimum(job.get("minimum_severity"))})


RULE_DDL = "rule_ord int, language string, rule_id string, category string, pattern_no int, message string, suggestion string, severity string, name string, cwe array<string>"


def rule_frame(spark: SparkSession, bundle: RuleBundle, options: AnalysisOptions) -> tuple[DataFrame, list[str]]:
    """The rules that can report anything: valid patterns (as one alternation), asked for, severe enough. Filters apply to the rules, before
    a single line is matched. Also the alternations by their number."""
    rows, patterns = [], []
    for language in bundle.pattern_languages():
        for i, r in enumerate(bundle.patterns_for(language)):
            good = []
            for p in r["patterns"]:
                try:
                    re.compile(python_regex(p))
                    good.append(f"(?:{java_regex(p)})")
                except re.error:
                    continue
            if not good or r["rule_id"] in options.exclude_rules or (options.include_rules and r["rule_id"] not in options.include_rules):
                continue
            meta = bundle.find_rule(r["rule_id"]) or {}
            rows.append((i, language, r["rule_id"], r["category"], len(patterns), r["message"], r.get("suggestion"), meta.get("severity"), meta.get("name"), meta.get("cwe") or []))
            patterns.append("|".join(good))
    out = spark.createDataFrame(rows, RULE_DDL).withColumn("severity", rule_severity(F.col("severity")))
    return out.filter(severity_rank(F.col("severity")) >= severity_rank(F.lit(options.minimum_severity))), patterns


def file_language(path: Column, bundle: RuleBundle) -> Column:
    """By file name or end of path, then by what follows the last dot; of several languages the alphabetically first."""
    low = F.lower(path)
    parts = F.struct(low.alias("low"), F.lower(file_name(path)).alias("name"), F.concat(F.lit("."), F.substring_index(low, ".", -1)).alias("end"))

    def of(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for language, extensions in sorted(bundle.extensions.items(), reverse=True):
            if extensions:
                out = F.when(x["end"].isin([e.lower() for e in extensions]), language).otherwise(out)
        for language, names in sorted(bundle.file_names.items(), reverse=True):
            for n in reversed(names):
                out = F.when((x["name"] == n.lower()) | ((x["name"] != "") & x["low"].endswith(n.lower())), language).otherwise(out)
        return out

    return F.transform(F.array(parts), of)[0]  # the parts of a path are found once, not once a language


def scannable(path: Column, options: AnalysisOptions) -> Column:
    return ~is_traversal(path) & ~matches_globs(path, options.ignore_paths)


def _matched(line_rows: DataFrame, rules: DataFrame, patterns: list[str], shell: bool) -> DataFrame:
    found = line_rows.join(F.broadcast(rules), "language").filter(tested(F.col("pattern_no"), F.col("content"), patterns))
    number = F.least(F.col("line_number").cast("long"), F.lit(2**31 - 1)).cast("int")
    cwe = F.when(F.size("cwe") > 0, F.concat(F.lit(" [CWE: "), F.array_join("cwe", ", "), F.lit("]"))).otherwise("")
    return found.select(
        "file_ord", F.lit(int(shell)).alias("pass_ord"), F.col("line_number").cast("long").alias("line_ord"), "rule_ord", "rule_id", F.col("path").alias("file_path"), number.alias("line_start"), number.alias("line_end"),
        "severity", issue_category(F.col("category")).alias("category"), F.coalesce("name", "rule_id").alias("title"), F.concat("message", cwe).alias("description"), "suggestion",
        trimmed(F.col("content")).alias("code_snippet"), F.lit(CONFIDENCE).alias("confidence"), F.lit("static").alias("source"),
    )


def scan_lines(line_rows: DataFrame, bundle: RuleBundle, options: AnalysisOptions | None = None) -> DataFrame:
    """Issues of lines (file_ord, path, line_number, content), shell in CI files included, with columns that keep scan order."""
    options = options or AnalysisOptions()
    rules, patterns = rule_frame(line_rows.sparkSession, bundle, options)
    rows = line_rows.filter("content is not null").filter(scannable(F.col("path"), options))
    # a filter on a column would find the language twice, once to test it
    rows = rows.withColumn("language", F.explode(F.filter(F.array(file_language(F.col("path"), bundle)), lambda x: x.isNotNull())))
    # CI files are recognised by their path; their language may be another one (any YAML file)
    shell = embedded_shell(rows.select("file_ord", "path", "line_number", "content")).filter(trimmed(F.col("content")) != "").withColumn("language", F.lit("shell"))
    return _matched(rows, rules, patterns, False).unionByName(_matched(shell, rules, patterns, True))


def scan_files(file_rows: DataFrame, bundle: RuleBundle, options: AnalysisOptions | None = None) -> DataFrame:
    """Whole files: every issue, neither sorted, deduplicated nor cut."""
    return scan_lines(lines(numbered(file_rows)), bundle, options).select(*ISSUE_COLUMNS)


SCAN_ORDER = ("file_ord", "pass_ord", "line_ord", "rule_ord")


def ranked(issues: DataFrame, max_issues: int | None = None) -> DataFrame:
    """By severity, path and line, ties in scan order; the first of each (path, line, title); then the first max_issues."""
    order = [F.desc(severity_rank(F.col("severity"))), "file_path", "line_start", *SCAN_ORDER]
    first = Window.partitionBy("file_path", "line_start", "title").orderBy(*order)
    out = issues.withColumn("n", F.row_number().over(first)).filter("n = 1").orderBy(*order)
    return (out if max_issues is None else out.limit(max_issues)).select(*ISSUE_COLUMNS)


def scan_diff_lines(line_rows: DataFrame, bundle: RuleBundle, options: AnalysisOptions | None = None) -> DataFrame:
    options = options or AnalysisOptions()
    return ranked(scan_lines(line_rows, bundle, options), options.max_issues)
