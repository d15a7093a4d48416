"""The corpus pipeline over the documents table: five stages, each written as Parquet and read again as the next one's documents.

Each stage decides on all that its predecessor kept. Rows with a null doc id, and rows that share one, are judged like others. An empty
table passes through every stage; columns beyond doc_id and text are carried along as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.llm.common import discard, staged, swept, table, unused
from lumenscan.llm.decontam import judged
from lumenscan.llm.jaccard_join import joined_components
from lumenscan.llm.langid import UND, identified, trained
from lumenscan.llm.packing import pack
from lumenscan.llm.suffix_dedup import deduplicated

#: At most so many ids or keys are broadcast to leave documents out (16 bytes each); beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    ids = staged(ids.distinct(), "left-out")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification gives a language; those it calls `und`, without a text or a letter, go."""
    lang, score = unused(docs, "found_lang", "found_score")
    return identified(docs, trained(docs), docs.columns, (lang, score)).filter(F.col(lang) != UND).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that Jaccard links join, one row of smallest doc id stays, one without an id only if none has one.
    Ids may be null or repeated, so rows stand for their id and text together; those without words stay, each its own group."""
    [key] = unused(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    found = joined_components(keyed.select(F.col(key).alias("doc_id"), "text")).filter("n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias(key)).agg(F.min("component_id").alias("grp"), F.count("*").alias("rows"))
    ids = keyed.groupBy(key).agg(F.min(F.col("doc_id").cast("long")).alias("id"))
    found = staged(found.join(ids, key), "row-groups")
    best = found.groupBy("grp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", key)).alias("best")).select(F.col(f"best.{key}").alias(key))
    out = _without(keyed, found.join(best, key, "left_anti").select(key), key)
    repeated = staged(found.filter("rows > 1").select(key), "repeated-rows")
    if not repeated.isEmpty():
        out = out.join(repeated, key, "left_anti").unionByName(out.join(repeated, key, "left_semi").dropDuplicates([key]))
    return out.select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated 200-byte strings are cut out of the texts; a document of which nothing is left goes."""
    out = deduplicated(docs, least_kept=1)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go. The verdict is the text's, so texts stand for rows."""
    [key] = unused(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    verdicts = judged(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(keyed, verdicts.filter("contaminated").select(F.col("doc_id").alias(key)), key).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document is in the packed sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("packing", packing),
]
#: Language identification is a fitted kernel model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's tables go when its result is written, and that when the next one's is."""
    docs = first = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, swept(spark, lambda s=stage, d=docs: s(spark, d, sf_dir), f"pipeline-{name}")
        if before is not first:
            discard(before)
    return docs
