"""Auto-fix suggestions for issues."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenscan.catalog.loader import RuleBundle, java_regex, python_regex
from lumenscan.operators.sast import file_language

FIX_DDL = "language string, rule_id string, fix_ord int, fix_description string, find string, template string, safe boolean, fix_confidence double, breaking_changes array<string>"
SAFE_CONFIDENCE = 0.9


def java_template(template: str, pattern: str) -> str:
    """A replacement template (`$1`, `${1}`, `$name`, `$$`) for Java; groups that the pattern lacks give nothing."""
    known = re.compile(python_regex(pattern))
    out, at = [], 0
    for m in re.finditer(r"\$(?:\$|\{(\w+)\}|(\w+))", template):
        out.append(re.sub(r"([\\$])", r"\\\1", template[at : m.start()]))
        name = m[1] or m[2]
        if name is None:
            out.append(r"\$")
        elif name.isdigit():
            out.append(f"${name}" if int(name) <= known.groups else "")
        elif name in known.groupindex:
            out.append(f"${{{name}}}")
        at = m.end()
    return "".join([*out, re.sub(r"([\\$])", r"\\\1", template[at:])])


def fix_rows(bundle: RuleBundle) -> list[tuple]:
    """Usable fixes: with a template and a valid pattern."""
    rows = []
    for language, fixes in sorted(bundle.fixes.items()):
        for i, x in enumerate(fixes):
            try:
                re.compile(python_regex(x["findPattern"]))
            except (re.error, KeyError):
                continue
            if x.get("replaceTemplate") is not None:
                rows.append((language, x["ruleId"], i, x.get("description", ""), java_regex(x["findPattern"]), java_template(x["replaceTemplate"], x["findPattern"]), bool(x.get("isSafe")), float(x.get("confidence") or 0.0), x.get("breakingChanges") or []))
    return rows


def safe_to_apply(safe: Column, confidence: Column, breaking_changes: Column, category: Column) -> Column:
    return safe & (confidence >= SAFE_CONFIDENCE) & (F.coalesce(F.size(breaking_changes), F.lit(0)) <= 0) & (category != "security")


def issue_key(path: Column, line: Column, rule_id: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"), F.coalesce(rule_id, F.lit("unknown")))


def first_replaced(text: str, find: str, template: str) -> Column:
    """text with the leftmost match of the pattern in column `find` replaced; null if there is none."""
    return F.expr(
        f"CASE WHEN {text} rlike {find} THEN concat(substring({text}, 1, regexp_instr({text}, {find}) - 1), regexp_replace(regexp_extract({text}, {find}, 0), {find}, {template}), "
        f"substring({text}, regexp_instr({text}, {find}) + length(regexp_extract({text}, {find}, 0)))) END"
    )


def confidence_order(confidence: str = "confidence") -> list[Column]:
    """Highest first, NaN last."""
    return [F.isnan(confidence).asc(), F.desc(confidence)]


def auto_fixes(issues: DataFrame, bundle: RuleBundle, max_fixes: int | None = None) -> DataFrame:
    """Fixes of issues, by confidence; cut to max_fixes before equal ones of an issue are dropped, so fewer may remain.

    issues may carry issue_ord, their order; otherwise they count as ordered by path, line and rule."""
    spark = issues.sparkSession
    ordered = "issue_ord" in issues.columns
    rows = issues.filter("rule_id is not null and code_snippet is not null").withColumn("language", file_language(F.col("file_path"), bundle))
    fixes = F.broadcast(spark.createDataFrame(fix_rows(bundle), FIX_DDL))
    found = rows.drop("confidence").join(fixes, ["language", "rule_id"]).withColumn("fixed_code", first_replaced("code_snippet", "find", "template"))
    found = found.filter("fixed_code is not null and fixed_code != code_snippet").withColumnRenamed("fix_confidence", "confidence")
    order = [*confidence_order(), *(["issue_ord"] if ordered else ["file_path", "line_start", "rule_id"]), "fix_ord"]
    if max_fixes is not None:
        found = found.orderBy(*order).limit(max_fixes)
    found = found.withColumn("issue_key", issue_key(F.col("file_path"), F.col("line_start"), F.col("rule_id")))
    first = Window.partitionBy("issue_key", "rule_id", "fixed_code").orderBy(*order)
    found = found.withColumn("n", F.row_number().over(first)).filter("n = 1").orderBy(*order)
    return found.select(
        "issue_key", "rule_id", F.col("code_snippet").alias("original_code"), "fixed_code", "fix_description", "confidence",
        safe_to_apply(F.col("safe"), F.col("confidence"), F.col("breaking_changes"), F.col("category")).alias("is_safe"), "breaking_changes",
    )
