"""Rule catalogs as typed tables: JSON documents of any number of sources to rows, with checks; which rule stays is decided by windows and
anti-joins over (source, order). `loader` reads the few files of one bundle on the driver; these take catalogs of any size, and hold
versions of a catalog that streams read again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenscan.catalog.loader import CRITICAL_WORDS, DEFAULT_SUGGESTION, IMPORT_SUGGESTIONS, LANGUAGE_ALIASES, META_CATEGORIES, NOT_LANGUAGES, PATTERN_CATEGORIES, SecretRule, python_regex

_META = "array<struct<id:string,name:string,severity:string,cwe:array<string>,owaspTop10:array<string>,owaspAsvs:array<string>,complianceStandards:array<string>,canonicalCategory:string,canonicalSubcategory:string>>"
_PATTERN = "array<struct<ruleId:string,patterns:array<string>,message:string,suggestion:string>>"
_LEAKS = "array<struct<id:string,description:string,regex:string,path:string,tags:array<string>,keywords:array<string>,entropy:double,allowlist:struct<regexes:array<string>>>>"
RULE_DDL = "rule_ord int, rule_id string, external_id string, title string, message string, severity string, patterns array<string>, provider string, keywords array<string>, suggestion string, allowlist_patterns array<string>, entropy double"


def preferred(sources: DataFrame) -> DataFrame:
    """sources: file, source_ord, text (null where a source lacks the file). Each file from the first source that has it."""
    order = Window.partitionBy("file").orderBy("source_ord")
    return sources.filter("text is not null").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def _entries(sources: DataFrame, categories: list[str], kind: str) -> DataFrame:
    """source_ord, key, category (and its number), pos, x for every entry of {key: {category: [entry, ...]}}; what is shaped otherwise is
    passed over."""
    keys = sources.select("source_ord", "text", F.explode(F.json_object_keys("text")).alias("key"))
    path = F.concat(F.lit("$['"), "key", F.lit("']"))
    inside = keys.select("source_ord", "key", F.from_json(F.call_function("get_json_object", F.col("text"), path), ", ".join(f"`{c}` {kind}" for c in categories)).alias("o"))
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("category_no"), F.lit(c).alias("category"), F.col(f"o.{c}").alias("entries")) for i, c in enumerate(categories)]))
    rows = inside.filter("o is not null").select("source_ord", "key", listed.alias("c"))
    return rows.select("source_ord", "key", "c.category_no", "c.category", F.posexplode("c.entries").alias("pos", "x"))


def metadata(sources: DataFrame) -> DataFrame:
    """sources: source_ord, text. A row a rule id: the first one by source, key, category and place stays."""
    rows = _entries(sources, list(META_CATEGORIES), _META).filter("x.id is not null")
    first = Window.partitionBy("x.id").orderBy("source_ord", "key", "category_no", "pos")
    rows = rows.withColumn("n", F.row_number().over(first)).filter("n = 1")
    empty = F.array().cast("array<string>")
    return rows.select(
        F.col("x.id").alias("rule_id"), F.coalesce("x.name", "x.id").alias("name"), F.coalesce("x.severity", F.lit("MAJOR")).alias("severity"), *[F.coalesce(f"x.{c}", empty).alias(n) for c, n in (("cwe", "cwe"), ("owaspTop10", "owasp_top10"), ("owaspAsvs", "owasp_asvs"), ("complianceStandards", "compliance_standards"))],
        F.col("x.canonicalCategory").alias("canonical_category"), F.col("x.canonicalSubcategory").alias("canonical_subcategory"), "source_ord", F.col("key").alias("language"), "category",
    )


def language_key(key: Column) -> Column:
    low = F.lower(key)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv])[low], low)


def patterns(sources: DataFrame) -> DataFrame:
    """language, rule_ord, rule_id, category, patterns, message, suggestion: of the keys that mean one language the last stays, by source
    and key; one with an entry that lacks its id, patterns or message is passed over whole."""
    rows = _entries(sources, list(PATTERN_CATEGORIES), _PATTERN).filter(~F.col("key").isin(*NOT_LANGUAGES)).withColumn("language", language_key(F.col("key")))
    lacking = F.max((F.col("x.ruleId").isNull() | F.col("x.patterns").isNull() | F.col("x.message").isNull()).cast("int"))
    keys = rows.groupBy("language", "source_ord", "key").agg(lacking.alias("bad")).filter("bad = 0")
    last = Window.partitionBy("language").orderBy(F.desc("source_ord"), F.desc("key"))
    kept = keys.withColumn("n", F.row_number().over(last)).filter("n = 1").select("language", "source_ord", "key")
    named = F.create_map(*[F.lit(x) for kv in PATTERN_CATEGORIES.items() for x in kv])[F.col("category")]
    order = Window.partitionBy("language").orderBy("category_no", "pos")
    return rows.join(kept, ["language", "source_ord", "key"]).select("language", (F.row_number().over(order) - 1).alias("rule_ord"), F.col("x.ruleId").alias("rule_id"), named.alias("category"), "x.patterns", "x.message", "x.suggestion")


def leak_rules(configs: DataFrame) -> DataFrame:
    """configs: source_ord, text (JSON of leak scanners). Typed rules in order; one without regex uses its path as one, without either, or
    without id, it is left out."""
    rows = configs.select("source_ord", F.posexplode(F.from_json("text", f"rules {_LEAKS}")["rules"]).alias("pos", "x"))
    pattern = F.coalesce(F.when(F.col("x.regex") != "", F.col("x.regex")), F.when(F.col("x.path") != "", F.col("x.path")))
    low, said = F.lower("x.id"), F.coalesce("x.description", F.lit(""))
    holds = lambda words: low.rlike("|".join(map(re.escape, words)))
    severity = F.when(holds(CRITICAL_WORDS), "critical").when(holds(("test", "example")), "low").otherwise("high")
    suggestion = F.lit(DEFAULT_SUGGESTION)
    for words, text in reversed(IMPORT_SUGGESTIONS):
        suggestion = F.when(holds(words), text).otherwise(suggestion)
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return rows.filter(pattern.isNotNull() & F.col("x.id").isNotNull()).select(
        "source_ord", "pos", F.concat(F.lit("SEC-GL-"), F.upper("x.id")).alias("rule_id"), F.concat(F.lit("gitleaks/"), "x.id").alias("external_id"), said.alias("title"), F.concat(F.lit("A "), said, F.lit(" was detected.")).alias("message"),
        severity.alias("severity"), F.array(pattern).alias("patterns"), F.coalesce(F.get("x.tags", F.lit(0)), F.lit("generic")).alias("provider"), listed(F.col("x.keywords")).alias("keywords"), suggestion.alias("suggestion"),
        listed(F.col("x.allowlist.regexes")).alias("allowlist_patterns"), F.col("x.entropy").alias("entropy"),
    )


def merged(base: DataFrame, imported: DataFrame) -> DataFrame:
    """Rows of base, then those imported whose external_id base lacks: the columns of both."""
    own = [c for c in base.columns if c in imported.columns]
    return base.select(*own).unionByName(imported.join(base.select("external_id").distinct(), "external_id", "left_anti").select(*own))


def checked(rules: DataFrame) -> DataFrame:
    """Rules with `fault`: null, or why a rule can not be used: no id, no pattern, or the first pattern that is none."""

    @F.pandas_udf("string")
    def broken(every: pd.Series) -> pd.Series:
        def first(own) -> str | None:
            for p in own if own is not None else ():
                try:
                    re.compile(python_regex(p))
                except (re.error, TypeError):
                    return f"bad pattern {p!r}"
            return None

        return every.map(first)

    none = F.col("patterns").isNull() | (F.size("patterns") == 0)
    return rules.withColumn("fault", F.when(F.coalesce("rule_id", F.lit("")) == "", "no id").when(none, "no pattern").otherwise(broken("patterns")))


# --- versions ---


def publish(spark: SparkSession, rules: list[SecretRule], folder: str) -> int:
    """Writes the rules as the folder's next version, one file, which appears at once; returns its number."""
    version = newest_version(spark, folder) + 1
    names = [c.split()[0] for c in RULE_DDL.split(", ")]
    rows = [(i, *(getattr(r, n) for n in names[1:])) for i, r in enumerate(rules)]
    spark.createDataFrame(rows, RULE_DDL).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={version}")
    return version


def newest_version(spark: SparkSession, folder: str) -> int:
    """0 if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(path) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max((int(n.split("=")[1]) for n in names if n.startswith("version=")), default=0)


def newest(spark: SparkSession, folder: str) -> list[SecretRule]:
    """The rules of the newest version, in order: a catalog, some hundred rows."""
    version = newest_version(spark, folder)
    if not version:
        return []
    rows: Iterator = spark.read.schema(RULE_DDL).parquet(f"{folder}/version={version}").orderBy("rule_ord").toLocalIterator()
    return [SecretRule(**{k: v for k, v in r.asDict().items() if k != "rule_ord"}) for r in rows]
