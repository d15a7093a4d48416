"""I-Match document fingerprints, with DataFrame functions only.

A term is kept if the share of documents that hold it lies in a band, which is a band of inverse document frequencies. The sorted
distinct kept terms are hashed once for each of SUBSETS random lexicons, which hold 1/4, 1/8, ... 1/512 of the terms, so that texts of any
length have lexicons that keep a few of theirs: fuller ones tell close texts apart, thinner ones survive more edits. The lexicon is
bounded by arithmetic, not by the corpus: the shares of all terms add up to the mean number d of distinct terms in a document, so at
most d / LOW_SHARE terms reach the band (some 300,000 for texts of 300 different words). It is looked up by hash in a constant
array, so no document is ever taken apart into rows again.

A fingerprint starts with the hash of all the text's distinct terms; a lexicon that keeps none of them leaves its place empty. Likeness
is the share of lexicons that agree among those that keep a term of either text; if there is none, the first hashes decide.

Defined results: null text is an empty one; texts without terms are all alike; the next document is by (doc_id, hash of the text), a
null id counting as the least number; a table of one row is its own next document; an empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

LOW_SHARE, HIGH_SHARE = 0.001, 0.2
SUBSETS, LEVELS = 16, 8
LEXICON_BUCKETS = 1 << 14
#: Rows of one sort group of the next-document step, how many groups there are at most, and sampled keys a group.
GROUP_ROWS, MAX_GROUPS, SAMPLED = 2000, 1 << 16, 16
KEY = ("at", "hash", "place")
LEAST_ID = -(1 << 63)
#: Control characters, which no term holds.
MARK, BREAK = "\x01", "\x02"
NOT_A_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), NOT_A_WORD, -1), lambda t: t != ""))


def _bucket(term: Column) -> Column:
    return F.pmod(F.hash(term), F.lit(LEXICON_BUCKETS))


def lexicon(docs: DataFrame, low: float = LOW_SHARE, high: float = HIGH_SHARE) -> Column:
    """A constant array of LEXICON_BUCKETS strings, each the terms of a bucket between MARKs, from all whole texts."""
    total = docs.count()
    terms = docs.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").count()
    kept = staged(terms.filter((F.col("count") >= low * total) & (F.col("count") <= high * total)).select("term"), "imatch-lexicon")
    between = F.concat(F.lit(MARK), F.array_join(F.sort_array(F.collect_list("term")), MARK), F.lit(MARK))
    buckets = kept.groupBy(_bucket(F.col("term")).cast("long").alias("id")).agg(between.alias("terms"))
    every = docs.sparkSession.range(LEXICON_BUCKETS).join(buckets, "id", "left").select("id", F.coalesce("terms", F.lit("")).alias("terms"))
    rows = every.agg(F.array_sort(F.collect_list(F.struct("id", "terms"))).alias("x"))
    constant = rows.select(F.array_join(F.transform("x", lambda b: b["terms"]), BREAK)).first()[0]
    return F.split(F.lit(constant), BREAK, -1)  # of a literal, so it is split once, when the plan is optimized


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hex(text: Column, seed: int) -> Column:
    return F.lpad(F.lower(F.hex(F.xxhash64(text, F.lit(seed)))), 16, "0")


def fingerprint(terms: Column, lexicon: Column) -> Column:
    """The hash of all terms, then SUBSETS hashes of kept ones, joined by `-`."""
    kept = lambda all_terms: F.filter(all_terms, lambda t: F.contains(F.element_at(lexicon, (_bucket(t) + 1).cast("int")), F.concat(F.lit(MARK), t, F.lit(MARK))))
    return let(F.sort_array(terms), lambda t: F.concat_ws("-", _hex(F.array_join(t, " "), -1), subset_hashes(kept(t))))


def subset_hashes(kept: Column) -> Column:
    """kept: the sorted kept terms."""

    def one(pairs: Column, s: int) -> Column:
        # other bits of the terms' hashes for each lexicon
        inside = F.filter(pairs, lambda p: F.shiftrightunsigned(p["h"], 3 * s).bitwiseAND((4 << s % LEVELS) - 1) == 0)
        return let(inside, lambda x: F.when(F.size(x) > 0, _hex(F.array_join(F.transform(x, lambda p: p["t"]), " "), s)).otherwise(""))

    return let(F.transform(kept, lambda t: F.struct(t.alias("t"), F.xxhash64(t).alias("h"))), lambda pairs: F.concat_ws("-", *[one(pairs, s) for s in range(SUBSETS)]))


def likeness(a: Column, b: Column) -> Column:
    """The share of random lexicons on which two fingerprints agree, of those that keep anything of either."""
    pairs = F.filter(F.zip_with(F.split(a, "-", -1), F.split(b, "-", -1), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: (p["x"] != "") | (p["y"] != ""))
    same = lambda all_pairs: F.size(F.filter(all_pairs, lambda p: p["x"] == p["y"]))
    whole = (F.substring_index(a, "-", 1) == F.substring_index(b, "-", 1)).cast("int")
    return let(pairs, lambda p: F.when(F.size(p) > 1, (same(p) - whole) / (F.size(p) - 1)).otherwise(whole.cast("double")))


def _upto(bounds: list[tuple[int, ...]], key: tuple[str, ...]) -> Column:
    """How many of the sorted bounds are no greater than the row's key columns: a binary search in constant arrays."""
    # of literals, so they are split once, when the plan is optimized
    columns = [F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in zip(*bounds, strict=True)]

    def no_greater(i: Column) -> Column:
        out = F.lit(True)
        for values, name in reversed(list(zip(columns, key, strict=True))):
            value = F.element_at(values, i)
            out = (value < F.col(name)) | ((value == F.col(name)) & out)
        return out

    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.when(at + step <= len(bounds), no_greater(at + step)).otherwise(False), at + step).otherwise(at))


def grouped(rows: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """rows (doc_id, text, place) with their sort key (at, hash, place) and `grp`, ascending with it, of about group_rows rows: ranges
    between quantiles of a sample of the keys. A null id counts as the least number. Rows that share an id are told apart by their
    text's hash, equal rows by their place."""
    keyed = rows.withColumns({"at": F.coalesce("doc_id", F.lit(LEAST_ID)), "hash": F.xxhash64("text")})
    total = rows.count()
    groups = min(MAX_GROUPS, -(-total // group_rows))
    if groups < 2:
        return keyed.withColumn("grp", F.lit(0))
    picked = F.pmod(F.xxhash64(*KEY), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLED * groups / total))
    sample = keyed.filter(picked).agg(F.array_sort(F.collect_list(F.struct(*KEY))).alias("x"))
    places = F.transform(F.sequence(F.lit(1), F.lit(groups - 1)), lambda i: F.floor(i * F.size("x") / groups).cast("int"))
    found = sample.select(F.when(F.size("x") > 0, F.transform(F.array_distinct(F.filter(places, lambda i: i > 0)), lambda i: F.element_at(F.col("x"), i))).alias("bounds")).first()[0]
    return keyed.withColumn("grp", _upto([tuple(x) for x in found], KEY) if found else F.lit(0))


def with_next(rows: DataFrame, derived: dict[str, Column], group_rows: int = GROUP_ROWS) -> DataFrame:
    """rows (doc_id, text, place) with the derived columns, and `next`, a struct of the text and those columns of the next row by
    (doc_id, hash of the text, place), after the last row the first one's. `place` is any number that tells equal rows apart and is the
    same whenever the rows are read.

    Rows are dealt to groups of even size, so the one shuffle is of group-sized sorts, which spill if they must; the last row of a group
    takes the first row of the next group that has any. What single tasks see of all groups is a row each, at most MAX_GROUPS."""
    rows = grouped(rows, group_rows)
    # a key a group, written, so that its known size decides how it is joined; then the few texts that it names
    ids = staged(rows.groupBy("grp").agg(F.min(F.struct(*KEY)).alias("head")), "imatch-ids").select("grp", *[F.col(f"head.{k}").alias(f"head_{k}") for k in KEY])
    firsts = rows.join(ids, "grp").filter(" and ".join(f"{k} = head_{k}" for k in KEY)).select("grp", "text")
    heads = staged(firsts.groupBy("grp").agg(F.min("text").alias("text")), "imatch-heads")
    own = F.struct("text", *derived)
    after = heads.select("grp", F.lead("grp").over(Window.orderBy("grp")).alias("later"), F.min("grp").over(Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first"))
    after = after.select("grp", F.coalesce("later", "first").alias("later"))
    heads = after.join(heads.withColumns(derived).select(F.col("grp").alias("later"), own.alias("head")), "later").select("grp", "head")
    ordered = Window.partitionBy("grp").orderBy(*KEY)
    return rows.withColumns(derived).withColumn("lead", F.lead(own).over(ordered)).join(heads, "grp").withColumn("next", F.coalesce("lead", "head")).drop("lead", "head", "grp", "at", "hash", "place")


def edited(text: Column, following: Column) -> Column:
    """The text whose last floor(n / 2) code points are replaced by as many from the start of the following text, or all of that."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def fingerprinted(docs: DataFrame, low: float = LOW_SHARE, high: float = HIGH_SHARE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """docs (doc_id, text, place): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    words = lexicon(docs, low, high)
    rows = with_next(docs, {"fingerprint": fingerprint(terms_of(F.col("text")), words)}, group_rows).withColumn("edited", edited(F.col("text"), F.col("next.text")))
    rows = rows.withColumn("edited_fingerprint", fingerprint(terms_of(F.col("edited")), words))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next.fingerprint")).alias("near_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of all documents and of their edited texts; see the module's defined results."""
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")  # the same at each reading, however files are split
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), place.alias("place"))
    return fingerprinted(docs)
