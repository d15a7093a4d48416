"""Exact Jaccard join of documents on word n-gram sets, by prefix filters under several global token orders.

If two sets are similar enough, then under any global order of tokens each has, among its first n - ceil(t n) + 1 tokens, one that the
other has among its first ones. Three orders are used. The first puts rare tokens first, by a sketch of token counts of fixed size (any
function of the token is a valid order, so the sketch's errors cost time, not results); its prefixes go into an inverted index that
makes the candidates. The other two are by hashes that have nothing to do with it, so that a pair that shares a rare token by chance,
or a passage, seldom passes them too. A class carries its prefixes under them as 16-bit signatures (shortening a token can only let more
pass), and a pair that does not meet under both is dropped before any text is fetched. Long lists are divided by the second order's prefix
tokens, so that only classes that share a token under both orders become pairs.

Documents with equal sets form one class from the start. A posting list does not emit its pairs: first each class is compared with two
of the least classes of its lists only. That joins most near copies into components. Then classes are compared with the other least
ones, and at last all pairs of a list, but each time only classes that are still in different components. No link between components is lost, and a group of n copies costs some n comparisons.
Pairs are screened by size and by parity bitmaps (the bits in which they differ never outnumber the tokens in which the sets differ).

Defined results: null or blank text has an empty set, links with nothing and is its own component; a component's id is its smallest
doc id (null if all are null); rows that share a doc id are documents each; an empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, mixed, ngram_hashes, parts_of, shuffle_parts, staged, table, utf8, words_by_text

WORDS, THRESHOLD = 4, 85
#: Cells of the count sketch (two bytes each in a task, one in the end), and into how many pieces it is cut to be summed.
SKETCH_LOG, SKETCH_CHUNKS = 22, 64
ORDERS = 3
#: A task sends its prefix tokens whenever so many have come together.
FLUSH_TOKENS = 500_000
#: Prefix tokens that meet in one part of the index, of 17 bytes each.
PART_TOKENS = 2_000_000
#: Tables of two numbers a row are broadcast up to so many rows (keys of texts that are to be compared, so that no other text moves, and
#: classes' components); beyond, both sides of the join are shuffled.
BROADCAST_ROWS = 300_000
#: Posting lists of tokens met more often than this are split by class, so that no list has to fit a task.
LONG_LIST = 1_000_000
#: So many of a class's least tokens travel with it in the last round.
HEAD_TOKENS = 8
#: In the last round, lists of more classes are divided by the second order's prefix tokens: a pair is screened in a fraction of the time
#: that it takes to deal a class out by each of its tokens.
WHOLE_LIST = 2_000
_U64 = np.uint64
_BITS = [f"b{i}" for i in range(8)]


def token_sets(texts: list[bytes], n: int = WORDS) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct word n-grams; of fewer words the whole sequence; nothing without words."""
    return [np.unique(ngram_hashes(words, min(n, len(words)))) if len(words) else words for words in words_by_text(texts)]


def class_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def parity(tokens: np.ndarray) -> np.ndarray:
    """512 bits: bit i tells whether an odd number of tokens falls on i."""
    return np.packbits(np.bincount((tokens & _U64(511)).astype(np.int64), minlength=512) & 1).view(np.int64)


def prefix_size(n: int, threshold: int = THRESHOLD) -> int:
    return n + (-threshold * n) // 100 + 1


def prefix(tokens: np.ndarray, sketch: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """The first tokens by the logarithm of their sketched count, then by hash."""
    size = prefix_size(len(tokens), threshold)
    if size >= len(tokens):
        return tokens
    level = sketch[(tokens >> _U64(64 - SKETCH_LOG)).astype(np.int64)].astype(np.uint64)
    return tokens[np.argpartition((level << _U64(57)) | (mixed(tokens) >> _U64(7)), size - 1)[:size]]


def signature(tokens: np.ndarray, order: int, threshold: int = THRESHOLD) -> np.ndarray:
    """16 bits of each of the first tokens under order 1 (their own hashes, as they are sorted) or 2 (the hashes times an odd number),
    different ones, in order."""
    size = prefix_size(len(tokens), threshold) if len(tokens) else 0
    if order == 2:
        tokens = tokens * _U64(0xD6E8FEB86659FD93)
        tokens = np.partition(tokens, size - 1) if 0 < size < len(tokens) else tokens
    return np.unique(tokens[:size].astype(np.uint16).view(np.int16))


DOC_DDL = "doc_id long, row_key long, cls long, n long, " + ", ".join(f"{b} long" for b in _BITS) + ", s1 array<smallint>, s2 array<smallint>, chunk int, counts binary"
_DOC = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), *((b, pa.int64()) for b in _BITS), ("s1", pa.list_(pa.int16())), ("s2", pa.list_(pa.int16())), ("chunk", pa.int32()), ("counts", pa.binary())])


def _lists_of(arrays: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32), np.concatenate(arrays))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of both, by which a row's text is found again; rows that share it have the same text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")


def described(docs: DataFrame, n_words: int, threshold: int) -> DataFrame:
    """A row for each document with its class, set size, bitmap and signatures; and the tasks' token counts by sketch cell."""

    def describe(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in source:
            for chosen in parts_of(pc.binary_length(batch.column(2)).to_pylist(), 500):
                part = batch.slice(chosen.start, chosen.stop - chosen.start)
                sets = token_sets(part.column(2).to_pylist(), n_words)
                bits = np.array([parity(s) for s in sets], np.int64).reshape(len(sets), 8)
                m = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(bits[:, i]) for i in range(8)),
                     *(_lists_of([signature(s, k, threshold) for s in sets]) for k in (1, 2)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                    schema=_DOC,
                )
                total = np.zeros(1 << SKETCH_LOG, "<u2") if total is None else total
                cells, n = np.unique(np.concatenate(sets) >> _U64(64 - SKETCH_LOG), return_counts=True)
                total[cells.astype(np.int64)] = np.minimum(total[cells.astype(np.int64)] + n, 65535)
        if total is not None:
            none = [pa.nulls(SKETCH_CHUNKS, f.type) for f in list(_DOC)[:-2]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SKETCH_CHUNKS), pa.int32()), pa.array([zstandard.compress(x.tobytes(), 1) for x in total.reshape(SKETCH_CHUNKS, -1)], pa.binary())], schema=_DOC)

    return keyed_texts(docs).mapInArrow(lean(describe), DOC_DDL)


def _summed(t: pa.Table) -> pa.Table:
    total = np.zeros((1 << SKETCH_LOG) // SKETCH_CHUNKS, np.int64)
    for x in t.column("counts").to_pylist():
        total += np.frombuffer(zstandard.decompress(x), "<u2")
    level = np.where(total > 0, np.floor(2 * np.log2(np.maximum(total, 1))) + 1, 0)  # half powers of two
    return pa.table({"chunk": pa.array([t.column("chunk")[0].as_py()], pa.int32()), "levels": pa.array([level.astype(np.uint8).tobytes()], pa.binary())})


def sketch_of(found: DataFrame) -> np.ndarray:
    """The sketch: fixed size, whatever the corpus."""
    rows = found.filter("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(_summed, "chunk int, levels binary").collect()
    out = np.zeros((SKETCH_CHUNKS, (1 << SKETCH_LOG) // SKETCH_CHUNKS), np.uint8)
    for r in rows:
        out[r[0]] = np.frombuffer(r[1], np.uint8)
    return out.ravel()


def postings(docs: DataFrame, sketch, n_words: int, threshold: int, long_list: int, n_tokens: int) -> DataFrame:
    """(token, cls, leader, split) of prefix tokens under the first order that at least two classes share; leader: the least class of
    the list, or of its part if the list is split. n_tokens: at most so many are sent; a part, which is one group in a task's memory, is
    to hold PART_TOKENS of them."""
    parts = max(64, 4 * shuffle_parts(docs.sparkSession), -(-n_tokens // PART_TOKENS))

    def post(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sketch.value
        seen, held, size = set(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            tokens = np.concatenate([x[0] for x in held])
            classes = np.repeat(np.array([x[1] for x in held], np.int64), [len(x[0]) for x in held])
            level = levels[(tokens >> _U64(64 - SKETCH_LOG)).astype(np.int64)].astype(np.float64)
            pieces = np.maximum(1, 2 ** ((level + 1) / 2) // long_list).astype(np.uint64)
            part = (mixed(tokens + (classes.view(np.uint64) % pieces) * _U64(0x9E3779B97F4A7C15)) % _U64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(cuts)).tolist()
            columns = [[x[by[cuts[p] : cuts[p + 1]]].tobytes() for p in some] for x in (tokens, classes, (pieces > 1).astype("u1"))]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["part", "tokens", "classes", "split"])

        for batch in source:
            for chosen in parts_of(pc.binary_length(batch.column(0)).to_pylist(), 500):
                for tokens in token_sets(batch.column(0)[chosen].to_pylist(), n_words):
                    if len(tokens) and (c := class_of(tokens)) not in seen:
                        if len(seen) < 500_000:
                            seen.add(c)
                        held.append((prefix(tokens, levels, threshold), c))
                        size += len(held[-1][0])
                if size >= FLUSH_TOKENS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    packed = docs.select(utf8("text").alias("text")).mapInArrow(lean(post), "part int, tokens binary, classes binary, split binary")
    return packed.groupBy("part").applyInArrow(_lists, "token long, cls long, leader long, split boolean")


def _lists(t: pa.Table) -> pa.Table:
    token, cls, split = (np.concatenate([np.frombuffer(x, kind) for x in t.column(name).to_pylist()]) for name, kind in (("tokens", np.uint64), ("classes", np.int64), ("split", np.uint8)))
    by = np.lexsort((cls, token))
    token, cls, split = token[by], cls[by], split[by]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])]) if len(token) else np.zeros(0, bool)
    token, cls, split = token[new], cls[new], split[new]
    first = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
    where = np.flatnonzero(first)
    length = np.diff(np.concatenate([where, [len(token)]]))
    keep = np.repeat(length > 1, length) | (split > 0)
    return pa.table({"token": pa.array(token[keep].view(np.int64)), "cls": pa.array(cls[keep]), "leader": pa.array(np.repeat(cls[where], length)[keep]), "split": pa.array(split[keep] > 0)})


def _light(df: DataFrame) -> DataFrame:
    """A staged table of two numbers a row, to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _may_link(a: str, b: str, threshold: int) -> Column:
    """Sizes and bitmaps allow the pair: t (|a| + |b| + d) <= 100 (|a| + |b| - d), where d is at least the bitmaps' difference."""
    total = F.col(f"{a}n") + F.col(f"{b}n")
    differ = sum((F.bit_count(F.col(f"{a}{x}").bitwiseXOR(F.col(f"{b}{x}"))) for x in _BITS), F.lit(0))
    return (100 * F.least(f"{a}n", f"{b}n") >= threshold * F.greatest(f"{a}n", f"{b}n")) & (differ * (100 + threshold) <= (100 - threshold) * total)


def _in_orders() -> Column:
    """The pair shares prefix tokens under the second and third order."""
    return F.arrays_overlap("a_s1", "b_s1") & F.arrays_overlap("a_s2", "b_s2")


def _screened(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """pairs (a, b) that sizes and bitmaps allow, and that share prefix tokens under the second and third order. Signatures, most of a
    class's bytes, move only for the classes of pairs that sizes and bitmaps allow."""

    def with_both(pairs: DataFrame, classes: DataFrame, *carried: str) -> DataFrame:
        left, right = (classes.select(F.col("cls").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in carried]) for x in ("a", "b"))
        return pairs.join(left, "a").join(right, "b")

    allowed = staged(with_both(pairs, classes, "n", *_BITS).filter(_may_link("a_", "b_", threshold)).select("a", "b"), "join-allowed")
    signed = classes.select("cls", "s1", "s2").join(_light(staged(_ends(allowed), "join-wanted")), "cls")
    return with_both(allowed, signed, "s1", "s2").filter(_in_orders()).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n_words: int, threshold: int) -> DataFrame:
    """pairs (a, b) whose sets are similar enough. The text of a class is that of its row of smallest key, so that a row meets its own
    class only, whatever its doc id; texts of pairs alone move, once a class and task, and those of the second side once a pair."""
    wanted = _ends(pairs).join(classes.select("cls", "row_key"), "cls")

    def own(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()  # of rows with one key one is enough; each is a copy of the others
        for batch in source:
            for chosen in parts_of(pc.binary_length(batch.column(1)).to_pylist(), 500):
                part = batch.slice(chosen.start, chosen.stop - chosen.start)
                new = [c not in sent for c in part.column(0).to_pylist()]
                part = part.filter(pa.array(new, pa.bool_()))
                sets = token_sets(part.column(1).to_pylist(), n_words)
                part = part.filter(pa.array([class_of(x) == c for c, x in zip(part.column(0).to_pylist(), sets, strict=True)], pa.bool_()))
                if len(sent) < 500_000:
                    sent.update(part.column(0).to_pylist())
                yield part

    wanted = staged(wanted, "join-wanted")
    texts = keyed_texts(docs).join(_light(wanted), "row_key").select("cls", "text").mapInArrow(lean(own), "cls long, text binary")
    texts = staged(texts, "join-texts").dropDuplicates(["cls"])  # one shuffle serves this and both sides of the join

    def compare(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in source:
            keep = []
            for chosen in parts_of(pc.binary_length(batch.column(3)).to_pylist(), 500):
                one, two = batch.column(0)[chosen].to_pylist(), token_sets(batch.column(3)[chosen].to_pylist(), n_words)
                for k, (a, y) in enumerate(zip(one, two, strict=True), chosen.start):
                    if last[0] != a:
                        last = (a, token_sets([batch.column(2)[k].as_py()], n_words)[0])
                    x = last[1]
                    both = np.intersect1d(x, y, assume_unique=True).size
                    keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(lean(compare), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(cls, comp) of every class with an edge (a, b). Each round merges a class with the least one next to it and keeps the edges between
    what is left; class ids are hashes, so about half goes each time. Rounds are written to the shared folder."""
    edges, rounds = staged(edges.distinct(), "join-edges"), []
    while not rounds or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        merged = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("cls"), F.least("a", "m").alias("comp")), "join-merged")
        rounds.append(merged)
        ends = [merged.select(F.col("cls").alias(x), F.col("comp").alias(f"{x}_to")) for x in ("a", "b")]
        left = edges.join(ends[0], "a").join(ends[1], "b").filter("a_to != b_to")
        edges = staged(left.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "join-edges")
    out = rounds.pop()
    while rounds:
        out = rounds.pop().withColumnRenamed("comp", "to").join(out.withColumnRenamed("cls", "to"), "to", "left").select("cls", F.coalesce("comp", "to").alias("comp"))
    return out


def merged_components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (cls, comp) after merging along the links."""
    ends = [comps.select(F.col("cls").alias(x), F.col("comp").alias(f"{x}_comp")) for x in ("a", "b")]
    apart = links.join(ends[0], "a").join(ends[1], "b").filter("a_comp != b_comp").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    found = components(apart).select(F.col("cls").alias("comp"), F.col("comp").alias("to"))
    return staged(comps.join(found, "comp", "left").select("cls", F.coalesce("to", "comp").alias("comp")), "join-components")


def joined_components(docs: DataFrame, n_words: int = WORDS, threshold: int = THRESHOLD, long_list: int = LONG_LIST, whole_list: int = WHOLE_LIST) -> DataFrame:
    """doc_id, n_shingles, cls (documents with equal sets share it), component_id for each row of docs."""
    found = staged(described(docs, n_words, threshold), "join-documents")
    own = found.filter("chunk is null")
    sketch = docs.sparkSession.sparkContext.broadcast(sketch_of(found))
    classes = staged(own.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key"), *[F.first(c).alias(c) for c in ("n", *_BITS, "s1", "s2")]), "join-classes")
    sent = own.filter("n > 0").agg(F.sum(F.col("n") + F.floor(-threshold * F.col("n") / 100) + 1)).first()[0] or 0
    lists = staged(postings(docs, sketch, n_words, threshold, long_list, int(sent)), "join-lists")

    # each class with two of the least ones of its lists: the one it shares most lists with, and the least; parts of split lists through
    # their own least ones
    stars = lists.filter("cls != leader").groupBy("cls", "leader").count()
    stars = stars.groupBy("cls").agg(F.array_distinct(F.array(F.max_by("leader", F.struct("count", "leader")), F.min("leader"))).alias("leaders"))
    stars = stars.select(F.explode("leaders").alias("a"), F.col("cls").alias("b"))
    tops = lists.filter("split").groupBy("token").agg(F.min("leader").alias("a"))
    tops = lists.filter("split").select("token", F.col("leader").alias("b")).distinct().join(tops, "token").filter("a != b").select("a", "b")
    tried = staged(_screened(stars.unionByName(tops).distinct(), classes, threshold), "join-pairs")
    comps = staged(lists.select("cls", F.col("cls").alias("comp")).distinct(), "join-components")
    comps = merged_components(comps, staged(verified(tried, classes, docs, n_words, threshold), "join-links"))

    # classes that are still apart from others of the least ones of their lists
    light = _light(comps)
    led = lists.join(light, "cls").join(light.select(F.col("cls").alias("leader"), F.col("comp").alias("leader_comp")), "leader").filter("comp != leader_comp")
    led = led.select(F.col("leader").alias("a"), F.col("cls").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = staged(_screened(led, classes, threshold), "join-pairs")
    if not more.isEmpty():
        tried = tried.unionByName(more)
        comps = merged_components(comps, staged(verified(more, classes, docs, n_words, threshold), "join-links"))

    # pairs of a list that are still apart; the one pair of a list of two has been tried
    placed = lists.select("token", "cls").join(_light(comps), "cls")
    # lists of the same classes, as those of one passage's tokens are, give the same pairs: the one of least token stands for all
    same = [F.bit_xor(F.xxhash64("cls", F.lit(i))).alias(f"same{i}") for i in (1, 2)]
    apart = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k"), *same).filter("lo != hi and k > 2")
    apart = apart.groupBy("k", "same1", "same2").agg(F.min("token").alias("token")).select("token", "k")
    rows = placed.join(apart, "token")
    # with the least of each class's tokens, a pair that shares many need not come up at each: it does at the least one they share
    heads = rows.groupBy("cls").agg(F.slice(F.sort_array(F.collect_set("token")), 1, HEAD_TOKENS).alias("head"))
    rows = staged(rows.join(heads, "cls").join(classes.select("cls", "n", *_BITS, "s1", "s2"), "cls"), "join-apart")
    # a long list is a list for each of the second order's prefix tokens in it
    long, rows = rows.filter(F.col("k") > whole_list), rows.filter(F.col("k") <= whole_list).drop("k").withColumns({"second": F.lit(0), "second_head": F.array().cast("array<smallint>")})
    if not long.isEmpty():
        second = long.withColumn("second_head", F.slice(F.sort_array("s1"), 1, HEAD_TOKENS)).select("*", F.explode("s1").alias("second")).withColumn("second", F.col("second").cast("int")).drop("k")
        several = second.groupBy("token", "second").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("token", "second")
        rows = rows.unionByName(second.join(several, ["token", "second"]))  # a token's list is whole or divided, never both
    one = rows.select("token", "second", *[F.col(c).alias(f"a_{c}") for c in ("cls", "comp", "head", "second_head", "n", *_BITS, "s1", "s2")])
    two = rows.select("token", "second", *[F.col(c).alias(f"b_{c}") for c in ("cls", "comp", "head", "second_head", "n", *_BITS, "s1", "s2")])
    earlier = lambda heads, at: F.coalesce(F.array_min(F.array_intersect(f"a_{heads}", f"b_{heads}")) < F.col(at), F.lit(False))
    shared_before = earlier("head", "token") | earlier("second_head", "second")
    wanted = (F.col("a_cls") < F.col("b_cls")) & (F.col("a_comp") != F.col("b_comp")) & _may_link("a_", "b_", threshold)
    more = one.join(two, ["token", "second"]).filter(F.when(wanted, ~shared_before & _in_orders()).otherwise(False))
    more = more.select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")).distinct()
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = staged(more.join(tried, ["a", "b"], "left_anti"), "join-pairs")
    if not more.isEmpty():
        comps = merged_components(comps, staged(verified(more, classes, docs, n_words, threshold), "join-links"))

    named = classes.select("cls", F.col("doc_id").alias("least")).join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    ids = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = staged(named.select("cls", "comp").join(ids, "comp").select("cls", "component_id"), "join-components")
    out = own.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(named, "cls", "left")
    return out.select("doc_id", "n_shingles", "cls", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document under Jaccard links; see the module's defined results."""
    return joined_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
