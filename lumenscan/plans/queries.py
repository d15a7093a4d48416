"""Queries over the driver's tables, and the corpora of code-like files that are made from them by rule.

Corpora are built with functions that Spark and DuckDB share, so each query has an independent SQL twin in `oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenscan.catalog import tables
from lumenscan.catalog.loader import RuleBundle
from lumenscan.functions import paths as P
from lumenscan.functions import text as X
from lumenscan.functions.comments import without_inline_comment
from lumenscan.operators import autofix, detect, duplication, iac, metrics, sast, secrets
from lumenscan.operators.work import cut, delete, new_folder
from lumenscan.plans import analysis
from lumenscan.sources.files import diff_chunks, diff_lines, embedded_shell, lines

from . import examples, oracle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A table in fewer splits than there are cores (one small file), dealt out over all of them; any other as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Splits a core that `dealt` makes.
DEALT = 4


def dealt(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Keys and sizes of a table that texts are made of by rule. Such columns are a few bytes a row, so that millions of rows are one split or
    one row group of a file, and all that is made of them would be one task's work: they are dealt out over all cores."""
    return _table(spark, sf_dir, name).select(*columns).repartition(DEALT * spark.sparkContext.defaultParallelism)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("file_ord"), F.format_string("docs/%d.txt", "doc_id").alias("path"), F.col("text").alias("content"))


def secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line a customer, holding a kind of secret by its key; a stable row id as file_ord."""
    rows = dealt(spark, sf_dir, "customer", "c_custkey").selectExpr("c_custkey AS file_ord", oracle.SECRET_PATH + " AS path", "1 AS line_number", oracle.SECRET_LINE + " AS content")
    return rows


def iac_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "part", "p_partkey", "p_size").selectExpr("p_partkey AS file_ord", oracle.IAC_PATH + " AS path", "cast(p_size AS int) AS line_number", oracle.IAC_LINE + " AS content")


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "orders", "o_orderkey", "o_custkey").selectExpr("o_orderkey AS file_ord", oracle.CODE_PATH + " AS path", "cast(o_orderkey % 97 + 1 AS int) AS line_number", oracle.CODE_LINE + " AS content")


def path_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").selectExpr(oracle.TREE_PATH + " AS path").distinct()


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff for each order: a hunk for its lineitems, which are added, removed or context lines by return flag."""
    items = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS diff_id", "l_linenumber AS n", oracle.DIFF_LINE + " AS line")
    body = items.groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return body.selectExpr("diff_id", oracle.DIFF_TEXT + " AS diff")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small file a part, in a language by its key."""
    return dealt(spark, sf_dir, "part", "p_partkey", "p_size").selectExpr("p_partkey AS file_ord", oracle.FILE_PATH + " AS path", oracle.FILE_TEXT + " AS content")


def ci_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "supplier", "s_suppkey").selectExpr("s_suppkey AS file_ord", oracle.CI_PATH + " AS path", oracle.CI_TEXT + " AS content")


def _numbered_examples(spark: SparkSession, rows: list[tuple], name: str, at: str) -> DataFrame:
    """A part's example, by its key: a few hundred rows, broadcast."""
    return F.broadcast(spark.createDataFrame([(*r[:-1], r[-1]) for r in rows], f"{at} long, " + ("example_path string, " if len(rows[0]) == 3 else "") + f"{name} string"))


def secret_catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line a part: one that a secret rule matches, or nearly."""
    rows = examples.secret_examples()
    parts = dealt(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("file_ord"), (F.col("p_partkey") % len(rows)).alias("i"))
    found = parts.join(_numbered_examples(spark, rows, "content", "i"), "i")
    return found.select("file_ord", F.format_string("src/app/f%d.env", "file_ord").alias("path"), F.lit(1).alias("line_number"), "content")


def secret_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a part of two example lines, in folders that are ignored, by default or on request, or not."""
    rows = examples.secret_examples()
    parts = dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", (F.col("p_partkey") % len(rows)).alias("i"), ((F.col("p_partkey") * 7 + 2) % len(rows)).alias("j"))
    found = parts.join(_numbered_examples(spark, rows, "one", "i"), "i").join(_numbered_examples(spark, rows, "two", "j"), "j")
    return found.selectExpr("p_partkey AS file_ord", oracle.SECRET_FILE_PATH + " AS path", "concat(one, chr(10), 'plain', chr(13), chr(10), two, chr(10)) AS content")


def iac_catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples.iac_examples()
    parts = dealt(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("file_ord"), (F.col("p_partkey") % len(rows)).alias("i"))
    found = parts.join(_numbered_examples(spark, rows, "content", "i"), "i")
    return found.select("file_ord", F.format_string("d%d/%s", "file_ord", "example_path").alias("path"), F.lit(1).alias("line_number"), "content")


def iac_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples.iac_examples()
    parts = dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", (F.col("p_partkey") % len(rows)).alias("i"), ((F.col("p_partkey") + 2) % len(rows)).alias("j"))
    found = parts.join(_numbered_examples(spark, rows, "one", "i"), "i").join(_numbered_examples(spark, rows, "two", "j").drop("example_path"), "j")
    return found.selectExpr("p_partkey AS file_ord", f"concat({oracle.IAC_FILE_DIR}, example_path) AS path", "concat(one, chr(10), two, chr(10), chr(10), one, chr(10)) AS content")


# --- sources ---


def lines_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(document_files(spark, sf_dir))
    return rows.groupBy("path").agg(F.count("*").alias("n_lines"), F.sum(F.length("content")).alias("n_chars"), F.max(F.octet_length("content")).cast("long").alias("widest"))


def diff_added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_lines(diffs(spark, sf_dir)).filter("line_number is not null").select("diff_id", "path", F.col("line_number").cast("long").alias("line_number"), "content")


def diff_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_lines(diffs(spark, sf_dir), only_new_code=False).filter("line_number is not null").select("diff_id", "path", F.col("line_number").cast("long").alias("line_number"), "content")


def diff_chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("diff_id"), F.col("text").alias("diff"))
    return diff_chunks(rows, 50, 2000).select("diff_id", F.col("chunk").cast("long").alias("chunk"), F.octet_length("text").cast("long").alias("n_bytes"))


def ci_shell_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded_shell(lines(ci_files(spark, sf_dir))).select("path", F.col("line_number").cast("long").alias("line_number"), "content")


def ci_shell_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for shell, over the shell in CI files."""
    return sast.scan_files(ci_files(spark, sf_dir), RuleBundle()).select("rule_id", "file_path", "line_start", "severity", "title", "code_snippet")


# --- scalar functions ---


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("token")
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", oracle.TOKEN + " AS token")
    return rows.select(
        "c_custkey", X.is_placeholder(c).alias("placeholder"), X.is_repetitive(c).alias("repetitive"), X.masked(c).alias("masked"), F.round(X.entropy(c), 6).alias("entropy"),
        F.round(X.confidence(c, F.when(F.col("c_custkey") % 3 == 0, F.lit(4.5))), 6).alias("confidence"), X.is_allowlisted(c).alias("allowlisted"),
    )


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    rows = path_rows(spark, sf_dir)
    return rows.select(
        "path", P.is_traversal(p).alias("traversal"), P.any_regex(p, P.SECRET_IGNORED).alias("secret_ignored"), P.any_regex(p, P.IAC_IGNORED).alias("iac_ignored"), P.iac_type(p).alias("iac_type"),
        P.metrics_language(p).alias("metrics_language"), P.source_language(p).alias("source_language"), P.marker_language(F.lower(P.file_name(p))).alias("marker_language"), P.is_ci_path(p).alias("ci"),
    )


def ignored_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").selectExpr(oracle.GLOB_PATH + " AS path").distinct()
    return rows.select("path", P.matches_globs(F.col("path"), ["src/gen/*", "*.min.js", "docs/**", "lib/[tz]*"]).alias("ignored"))


def severity_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    rows = _table(spark, sf_dir, "orders").selectExpr(oracle.SEVERITY + " AS s").distinct()
    return rows.select("s", X.rule_severity(s).alias("of_rule"), X.known_severity(s, "high").alias("of_secret"), X.known_severity(s, "medium").alias("of_iac"), X.minimum_severity(s).alias("minimum"), X.severity_rank(X.minimum_severity(s)).cast("int").alias("rank"))


# --- scans ---

FINDING = ("rule_id", "file_path", "line_number", "severity", "provider", "masked_text")


def secrets_in_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.finding_rows(secrets.line_matches(secret_lines(spark, sf_dir)))
    return found.select("rule_id", "file_path", "severity", "provider", "matched_text", "masked_text", F.round("confidence", 6).alias("confidence"))


def secrets_in_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = secrets.ScanOptions(ignore_paths=["secret/skip"], minimum_severity="high", exclude_rules=["SEC-GH-001"])
    return secrets.scan_lines(secret_lines(spark, sf_dir), options).select(*FINDING)


def secrets_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_contents(document_files(spark, sf_dir)).select("rule_id", "file_path", "line_number", "severity", "masked_text", F.round("confidence", 6).alias("confidence"))


def secret_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the catalog on a line made for it and on a near miss."""
    found = secrets.finding_rows(secrets.line_matches(secret_catalog_lines(spark, sf_dir)))
    return found.select("rule_id", "file_path", "severity", "provider", "matched_text", "masked_text", F.round("confidence", 6).alias("confidence"))


def secrets_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as from a directory: ignored paths, and the first finding of each file that is severe enough."""
    options = secrets.ScanOptions(ignore_paths=["skip/"], max_findings=1, minimum_severity="medium")
    return secrets.scan_files(secret_files(spark, sf_dir), options).select("rule_id", "file_path", "line_number", "severity")


def secret_rule_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rules, and how often, found something in the lines made for the catalog."""
    return secrets.rule_stats(secrets.finding_rows(secrets.line_matches(secret_catalog_lines(spark, sf_dir))))


def secrets_with_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own rules: what the first one's allowlist rejects goes to the second."""
    return secrets.line_matches(secret_lines(spark, sf_dir), oracle.OWN_RULES).select("rule_id", F.col("path").alias("file_path"), "matched_text")


def secrets_in_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in a tree of files by folder; ignored folders are never opened."""
    root = new_folder(spark, "tree")
    secret_catalog_lines(spark, sf_dir).filter("NOT contains(content, chr(10))").selectExpr("content AS value", oracle.TREE_FOLDER + " AS folder").write.partitionBy("folder").text(root)
    found = secrets.scan_directory(spark, root, secrets.ScanOptions(ignore_paths=["folder=skip/"]))
    out = cut(found.groupBy(F.regexp_extract("file_path", "/folder=([^/]+)/", 1).alias("folder"), "rule_id", "severity").agg(F.count("*").alias("findings")))
    delete(spark, root)
    return out


def secret_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.as_issues(secrets.finding_rows(secrets.line_matches(secret_lines(spark, sf_dir))))
    return found.groupBy("rule_id", "severity", "category", "source").agg(F.count("*").alias("issues"), F.count_distinct("description").alias("descriptions"))


def secret_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.rotation_report(secrets.finding_rows(secrets.line_matches(secret_lines(spark, sf_dir))))
    return found.groupBy("provider", "rotation_provider", "rotation_severity").agg(F.count("*").alias("findings"), F.max(F.size("rotation_steps")).cast("int").alias("steps"))


def entropy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entropy_kinds(_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), 4.0)


def _entropy_kinds(rows: DataFrame, least: float) -> DataFrame:
    kinds = {"token": secrets.high_entropy_tokens(rows, 20, least), "base64": secrets.high_entropy_base64(rows), "hex": secrets.high_entropy_hex(rows)}
    out = None
    for kind, found in kinds.items():
        part = found.select("doc_id", F.lit(kind).alias("kind"), "token", F.round("entropy", 6).alias("entropy"))
        out = part if out is None else out.unionByName(part)
    return out


def iac_in_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = iac.finding_rows(iac.line_matches(iac_lines(spark, sf_dir)))
    return found.select("rule_id", "file_path", "line_number", "severity", "iac_type", "matched_pattern", "source")


def iac_in_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = secrets.ScanOptions(iac_types=["dockerfile", "terraform"], minimum_severity="high")
    return iac.scan_lines(iac_lines(spark, sf_dir), options).select("rule_id", "file_path", "line_number", "severity", "iac_type")


def iac_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = iac.finding_rows(iac.line_matches(iac_catalog_lines(spark, sf_dir)))
    return found.select("rule_id", "file_path", "severity", "iac_type", "matched_pattern", "source")


def iac_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as from a directory, at most two findings of each."""
    options = secrets.ScanOptions(ignore_paths=["skip/"], max_findings=2)
    return iac.scan_files(iac_files(spark, sf_dir), options).select("rule_id", "file_path", "line_number", "severity")


def iac_file_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.iac_issues(iac_files(spark, sf_dir))
    return found.groupBy("rule_id", "severity", "category", "title", "description", "source").agg(F.count("*").alias("issues"))


def iac_rule_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iac.rule_stats(iac.finding_rows(iac.line_matches(iac_catalog_lines(spark, sf_dir))).withColumnRenamed("iac_type", "type"))


# --- catalogs ---


def rule_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule file a part; the first of a rule id stays."""
    rows = tables.metadata(dealt(spark, sf_dir, "part", "p_partkey", "p_size").selectExpr("p_partkey AS source_ord", oracle.META_JSON + " AS text"))
    return rows.select("rule_id", "name", "severity", F.array_join("cwe", ",").alias("cwe"), "source_ord", "language", "category")


def rule_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern file a part; the last that names a language stays, malformed ones are passed over."""
    rows = tables.patterns(dealt(spark, sf_dir, "part", "p_partkey", "p_size").selectExpr("p_partkey AS source_ord", oracle.PATTERN_JSON + " AS text"))
    return rows.select("language", "rule_ord", "rule_id", "category", F.array_join("patterns", " ").alias("patterns"), "message", "suggestion")


def leak_rule_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leak scanner's configuration a part; rules whose external id a base catalog (one rule a supplier) has are left out."""
    imported = tables.leak_rules(dealt(spark, sf_dir, "part", "p_partkey", "p_size").selectExpr("p_partkey AS source_ord", oracle.LEAK_JSON + " AS text"))
    base = _table(spark, sf_dir, "supplier").selectExpr("concat('BASE-', s_suppkey) AS rule_id", "concat('gitleaks/aws-', s_suppkey) AS external_id", "array('x') AS patterns", "'low' AS severity", "'base' AS provider", "'none' AS suggestion", "cast(NULL AS double) AS entropy", "array('k') AS keywords")
    rows = tables.checked(tables.merged(base, imported))
    return rows.select("rule_id", "external_id", F.array_join("patterns", " ").alias("patterns"), "severity", "provider", "suggestion", "entropy", F.array_join("keywords", ",").alias("keywords"), "fault")


def rule_file_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file from the first source that has it."""
    sources = _table(spark, sf_dir, "lineitem").selectExpr("concat('f', l_partkey) AS file", "l_orderkey * 10 + l_linenumber AS source_ord", "CASE WHEN l_orderkey % 3 <> 0 THEN concat('t', l_suppkey) END AS text")
    return tables.preferred(sources)


def fix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of fixes by confidence, NaN last."""
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CASE WHEN l_partkey % 5 = 0 THEN cast('NaN' AS double) ELSE cast(l_discount AS double) END AS confidence")
    order = Window.partitionBy("l_orderkey").orderBy(*autofix.confidence_order(), "l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", F.row_number().over(order).alias("place"))


def inline_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", oracle.COMMENTED + " AS line")
    return rows.select("o_orderkey", F.pandas_udf(_without_inline_comments, "string")("line").alias("code"))


def _without_inline_comments(lines_of_code: pd.Series) -> pd.Series:
    return lines_of_code.map(without_inline_comment)


def entropy_in_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entropy_kinds(dealt(spark, sf_dir, "customer", "c_custkey").selectExpr("c_custkey AS doc_id", oracle.ENTROPY_LINE + " AS content"), 4.5)


def code_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sast.scan_lines(code_lines(spark, sf_dir), RuleBundle()).select("rule_id", "file_path", "line_start", "severity", "category", "title", "description", "code_snippet")


def code_issues_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = sast.AnalysisOptions(max_issues=100, minimum_severity="high", exclude_rules=["PY-SHELL"])
    return sast.scan_diff_lines(code_lines(spark, sf_dir), RuleBundle(), options).select("rule_id", "file_path", "line_start", "severity", "title")


def code_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = sast.scan_lines(code_lines(spark, sf_dir), RuleBundle()).select(*sast.ISSUE_COLUMNS)
    return autofix.auto_fixes(issues, RuleBundle()).select("issue_key", "rule_id", "fixed_code", "confidence", "is_safe")


def diff_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule issues and secrets of the diffs, counted."""
    return analysis.issue_counts(analysis.diff_issues(diffs(spark, sf_dir), RuleBundle()))


# --- metrics ---


def document_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.file_loc(document_files(spark, sf_dir)).drop("file_ord")


def code_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.file_loc(code_files(spark, sf_dir)).drop("file_ord")


def file_length_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: the length of every document, then alerts on long ones (here: above 20 and 60 lines)."""
    lines_of = metrics.total_lines(F.col("content")).cast("double").alias("value")
    measures = document_files(spark, sf_dir).select(F.lit("FILE_LENGTH").alias("metric_type"), F.col("path").alias("file_path"), F.lit(None).cast("string").alias("function_name"), F.lit(None).cast("int").alias("line_number"), lines_of)
    return metrics.alerts(measures, metrics.Thresholds(file_length=(20, 60))).select("metric_type", "level", "file_path", "current_value", "threshold", "message")


def threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of alerts at their own thresholds, over a measure a line item."""
    rows = _table(spark, sf_dir, "lineitem").selectExpr(
        oracle.MEASURE_KIND + " AS metric_type", "concat('f', l_partkey) AS file_path", "CASE WHEN l_orderkey % 8 >= 4 THEN concat('fn', l_suppkey % 7) END AS function_name", "cast(l_linenumber AS int) AS line_number", oracle.MEASURE + " AS value",
    )
    return metrics.alerts(rows)


def pr_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity")).cast("long").alias("n"))
    return changes.select(F.col("l_suppkey").alias("change"), metrics.pr_size(F.col("n") % 1500).alias("size"))


def function_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.functions(code_files(spark, sf_dir)).drop("file_ord", "parameters")


def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.files(code_files(spark, sf_dir)).drop("file_ord")


def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(code_files(spark, sf_dir), 300, 45)


def duplicate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal blocks in documents, as (number of instances, lines, tokens) counts."""
    return duplication.group_counts(document_files(spark, sf_dir))


def duplicate_blocks_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of equal blocks of code whose white space counts."""
    return duplication.instances(code_files(spark, sf_dir), ignore_whitespace=False).select("hash", "path", "line_start", "line_end", "line_count", "token_count")


def duplicate_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplication.percentages(document_files(spark, sf_dir)).select(F.round("duplication_percentage", 6).alias("duplication_percentage"))


# --- detection ---


def project_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.projects(path_rows(spark, sf_dir))


def project_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.languages(path_rows(spark, sf_dir)).select("language", F.col("priority").cast("int").alias("priority"))


def project_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.auxiliary_targets(path_rows(spark, sf_dir))


def project_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.profile(path_rows(spark, sf_dir))
    return out.select("primary_language", "is_polyglot", "label", F.array_join("languages", ",").alias("languages"), F.array_join("target_keys", ",").alias("target_keys"))


def project_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.build_targets(detect.projects(path_rows(spark, sf_dir)))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    file_length_alerts, lines_of_documents, diff_added_lines, diff_all_lines, diff_chunk_sizes, ci_shell_lines, ci_shell_issues, text_functions, path_functions, ignored_globs, severity_functions, secrets_in_lines, secrets_in_diff,
    secrets_in_documents, secret_catalog, secrets_in_files, secret_rule_stats, secrets_with_allowlist, secrets_in_tree, secret_issues, secret_rotation, entropy_tokens, iac_in_lines, iac_in_diff, iac_catalog, iac_in_files, iac_file_issues, iac_rule_stats, rule_metadata, rule_patterns, leak_rule_import, rule_file_choice, fix_order, inline_comments, entropy_in_lines, code_issues, code_issues_ranked, code_fixes, diff_analysis,
    document_loc, code_loc, pr_sizes, threshold_alerts, function_metrics, file_metrics, change_summary, duplicate_blocks, duplicate_blocks_as_written, duplicate_share, project_list, project_languages, project_targets, project_profile, project_builds,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
