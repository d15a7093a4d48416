"""Infrastructure-as-code scanning: at most one finding a line, the first accepted match among the rules of the file's kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.catalog.loader import IacRule, builtin_iac_rules, java_regex
from lumenscan.functions.paths import IAC_IGNORED, IAC_TYPES, iac_type, iac_type_named, is_traversal
from lumenscan.functions.text import IAC_PLACEHOLDERS, is_placeholder, known_severity
from lumenscan.operators import secrets
from lumenscan.operators.matching import tested
from lumenscan.operators.secrets import ScanOptions, by_severity, first_findings, scannable, selected
from lumenscan.sources.files import directory, lines

DEFAULT_SUGGESTION = "Review and fix this security issue."
CONFIDENCE = 0.90
RULE_DDL = "pattern_no int, iac_type string, rule_id string, title string, message string, severity string, suggestion string, rule_source string, pattern string"


def rule_patterns(spark: SparkSession, rules: list[IacRule]) -> tuple[DataFrame, list[str]]:
    """A row for each pattern and kind; a rule of no known kind stands for every kind. Also the patterns by their number, in order of
    rules."""
    rows, patterns = [], []
    for r in rules:
        kind = iac_type_named(r.iac_type)
        for p in r.patterns:
            for k in IAC_TYPES if kind == "unknown" else (kind,):
                rows.append((len(patterns), k, r.rule_id, r.title, r.message, r.severity, r.suggestion or DEFAULT_SUGGESTION, r.source, java_regex(p)))
            patterns.append(java_regex(p))
    return spark.createDataFrame(rows, RULE_DDL), patterns


def line_matches(line_rows: DataFrame, rules: list[IacRule] | None = None) -> DataFrame:
    """Lines of known kinds, joined with the broadcast rules of their kind; the first accepted match of each."""
    table, patterns = rule_patterns(line_rows.sparkSession, builtin_iac_rules() if rules is None else rules)
    typed = line_rows.withColumn("iac_type", iac_type(F.col("path"))).filter("iac_type != 'unknown'")
    hits = typed.join(F.broadcast(table), "iac_type").filter(tested(F.col("pattern_no"), F.col("content"), patterns)).withColumn("matched_pattern", F.expr("regexp_extract(content, pattern, 0)"))
    hits = hits.filter(~is_placeholder(F.col("matched_pattern"), IAC_PLACEHOLDERS))
    first = F.min_by(F.struct("rule_id", "title", "message", "severity", "suggestion", "iac_type", "matched_pattern", "rule_source"), "pattern_no").alias("x")
    return hits.groupBy("file_ord", "path", "line_number").agg(first).select("file_ord", "path", "line_number", "x.*")


def finding_rows(matches: DataFrame) -> DataFrame:
    return matches.select(
        "file_ord", "rule_id", F.col("path").alias("file_path"), F.col("line_number").cast("int").alias("line_number"), known_severity(F.col("severity"), "medium").alias("severity"),
        "title", "message", "suggestion", "iac_type", "matched_pattern", F.col("rule_source").alias("source"), F.lit(CONFIDENCE).alias("confidence"),
    )


def _of_types(rows: DataFrame, options: ScanOptions) -> DataFrame:
    return rows.filter(iac_type(F.col("path")).isin(options.iac_types)) if options.iac_types else rows


def scan_lines(line_rows: DataFrame, options: ScanOptions | None = None, rules: list[IacRule] | None = None) -> DataFrame:
    """Added lines of a diff; max_findings for all files together."""
    options = options or ScanOptions()
    path = F.col("path")
    rows = _of_types(line_rows.filter("content is not null").filter(~is_traversal(path) & scannable(path, options, IAC_IGNORED)), options)
    return by_severity(first_findings(selected(finding_rows(line_matches(rows, rules)), options), options.max_findings, each_file=False)).drop("file_ord")


def scan_contents(file_rows: DataFrame, options: ScanOptions | None = None, rules: list[IacRule] | None = None) -> DataFrame:
    """Whole contents, whatever their path; max_findings for each file."""
    options = options or ScanOptions()
    found = selected(finding_rows(line_matches(lines(_of_types(file_rows, options)), rules)), options)
    return by_severity(first_findings(found, options.max_findings, each_file=True)).drop("file_ord")


def scan_files(file_rows: DataFrame, options: ScanOptions | None = None, rules: list[IacRule] | None = None) -> DataFrame:
    options = options or ScanOptions()
    return scan_contents(file_rows.filter(scannable(F.col("path"), options, IAC_IGNORED)), options, rules)


def scan_directory(spark: SparkSession, folder: str, options: ScanOptions | None = None, rules: list[IacRule] | None = None, max_files: int | None = None) -> DataFrame:
    """The files below a folder; ignored ones are never opened."""
    options = options or ScanOptions()
    return scan_contents(directory(spark, folder, max_files, IAC_IGNORED, options.ignore_paths), options, rules)


def as_issues(findings: DataFrame) -> DataFrame:
    number = F.col("line_number").cast("int")
    return findings.select(
        "rule_id", "file_path", number.alias("line_start"), number.alias("line_end"), "severity", F.lit("iac").alias("category"), "title", F.col("message").alias("description"), "suggestion",
        F.col("matched_pattern").alias("code_snippet"), "confidence", "source",
    )


def rule_rows(spark: SparkSession, rules: list[IacRule] | None = None) -> DataFrame:
    """rule_id, type, severity, source of a catalog."""
    rows = [(r.rule_id, r.iac_type, r.severity, r.source) for r in (builtin_iac_rules() if rules is None else rules)]
    return spark.createDataFrame(rows, "rule_id string, type string, severity string, source string")


def rule_stats(rows: DataFrame) -> DataFrame:
    """dimension (total, type, severity, source), value, rules, n, of a catalog or of findings."""
    return secrets.rule_stats(rows, ("type", "severity", "source"))
