"""Suffix-array deduplication by bucket-pointer refinement: which bytes lie in a string of LENGTH bytes that also starts elsewhere.

Initial buckets are q-grams (Q bytes). Not every suffix is sorted: of the q-grams inside a string of LENGTH bytes, the one of least hash
(the leftmost of equal ones) is the string's anchor. Equal strings have equal anchors at equal offsets, so only strings in the same
anchor bucket need comparing, and a text has about one anchor in 75 bytes. Buckets with one member hold no repeat: a Bloom filter of
the others, with as many bits for each at every size, leaves them out where the texts are (its false positives cost time, not results).
A filter of up to MAX_BROADCAST_BYTES is broadcast; beyond, the distinct anchors of each chunk of texts are shuffled to its blocks, and
the chunk's texts to the answers.

What is left of a text are contexts: an anchor with the stretch of strings it stands for. Equal contexts are counted where they arise
and travel once a task. A bucket's contexts are refined together: the bucket identifier of a position (its q-gram) is paired with that
of the position Q later and sorted into identifiers of 2Q bytes; those, paired with the ones 2Q later, give identifiers of LENGTH bytes.
Positions alone in their bucket drop out at each step. Buckets of very many different contexts are compared string by string in a
distributed aggregation instead, so no bucket has to fit a task.

Results depend on the text alone, so texts are keyed by digest and rows with equal texts share one result.

Defined results: null text is an empty one; texts shorter than LENGTH keep everything; rows that share a doc id are judged each for
itself, and equal rows are repeats of each other; an empty table gives an empty result. Extra columns are kept by `deduplicated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_VALUE, ODD, STRETCH, lean, mixed, parts_of, powers, shuffle_parts, staged, table, unused, utf8
from .lm import MAX_BLOCK_BYTES, LogFrequencyFilter, build_block, packed, placed, unpacked

LENGTH = 200
Q = LENGTH // 4
#: So many q-grams start in a string.
GRAMS = LENGTH - Q + 1
#: Texts are looked at in pieces of so many strings, long ones in several.
PIECE, CHUNK = 1 << 19, 1 << 20
MAX_BROADCAST_BYTES = 128 << 20
#: Bytes of text a part of the filter, and of a chunk of texts.
PART_BYTES, CHUNK_BYTES = 256 << 20, 8 << 20
#: A bucket with more different contexts than this (some 270 bytes each) is compared string by string, so that a part's task holds little
#: of any one bucket.
HOT_CONTEXTS = 4_000
FLUSH_BYTES = 12 << 20
_U64 = np.uint64


class Rolling:
    """Hashes of all substrings of a length: a polynomial over the bytes' random values, modulo 2^64, then scrambled."""

    def of(self, data: np.ndarray, size: int) -> np.ndarray:
        n = len(data) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        up, down = powers(max(2 * STRETCH, 1 << len(data).bit_length()) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=total[1:])
        return mixed((total[size:] - total[:n]) * down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, from running minima of blocks in either direction."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) of all texts, in chunks; neighbouring pieces of a long text share LENGTH - 1 bytes."""
    out, held = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t) - LENGTH + 1, PIECE):
            out.append((i, at, t if len(t) < PIECE else t[at : at + PIECE + LENGTH - 1]))
            held += len(out[-1][2])
            if held >= CHUNK:
                yield out
                out, held = [], 0
    if out:
        yield out


def anchors(chunk: list[tuple[int, int, bytes]], rolling: Rolling) -> tuple[np.ndarray, ...]:
    """For each run of strings with the same anchor: piece, first string, strings (both in the joined data), anchor hash; and the data."""
    data = np.frombuffer(b"".join(x[2] for x in chunk), np.uint8)
    lengths = np.array([len(x[2]) for x in chunk], np.int64)
    starts = np.cumsum(lengths) - lengths
    grams = rolling.of(data, Q)
    key = (grams & _U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(key, GRAMS)
    strings = lengths - LENGTH + 1
    piece = np.repeat(np.arange(len(chunk)), strings)
    first = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings) + np.repeat(starts, strings)
    at = (least[first] & _U64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])]))
    runs = np.diff(np.concatenate([new, [len(at)]]))
    return piece[new], first[new], runs, grams[at[new]], data, starts


def _keyed(docs: DataFrame) -> DataFrame:
    text = utf8("text")
    return docs.select(F.unhex(F.md5(text)).alias("key"), text.alias("text"))


def repeated_anchors(docs: DataFrame) -> tuple[DataFrame, int]:
    """The filter of the anchors that occur more than once, from counts over all texts: (part, block) rows, and the number of parts."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(utf8("text"))), F.lit(0))).first()[0]
    parts = 1 << (max(64, 2 * shuffle_parts(docs.sparkSession), -(-size // PART_BYTES)) - 1).bit_length()

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, held, size = Rolling(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            part, keys = placed(h, parts)
            by = np.argsort(part, kind="stable")
            keys, many, cuts = keys[by], (n[by] > 1).astype("u1"), np.searchsorted(part[by], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(cuts)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed(keys[cuts[p] : cuts[p + 1]]) for p in some], pa.binary()), pa.array([many[cuts[p] : cuts[p + 1]].tobytes() for p in some], pa.binary())], ["part", "keys", "many"])

        for batch in source:
            for chunk in pieces(batch.column(0).to_pylist()):
                held.append(anchors(chunk, rolling)[3])
                size += len(held[-1])
                if size >= 2_000_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    counts = docs.select(utf8("text").alias("text")).mapInArrow(lean(count), "part int, keys binary, many binary")
    return staged(counts.groupBy("part").applyInArrow(_block, "part int, block binary"), "anchor-filter"), parts


def _block(t: pa.Table) -> pa.Table:
    keys = np.concatenate([unpacked(x) for x in t.column("keys").to_pylist()])
    many = np.concatenate([np.frombuffer(x, np.uint8) for x in t.column("many").to_pylist()])
    keys, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
    kept = keys[(n > 1) | (np.bincount(inverse, many, len(keys)) > 0)]
    return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "block": pa.array([build_block(kept, np.ones(len(kept), np.int64), MAX_BLOCK_BYTES)], pa.binary())})


CONTEXT_DDL = "key binary, contexts array<long>, firsts array<int>, id long, anchor long, part int, context binary, times long"
_CONTEXT = pa.schema([("key", pa.binary()), ("contexts", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int32())), ("id", pa.int64()), ("anchor", pa.int64()), ("part", pa.int32()), ("context", pa.binary()), ("times", pa.int64())])


def _contexts_of(keys: list[bytes], texts: list[bytes], known: LogFrequencyFilter | Members, parts: int, met: dict[int, list]) -> Iterator[pa.RecordBatch]:
    """A row for each text with candidates: its contexts and where their first strings start. The contexts themselves go into met."""
    rolling = Rolling()
    of: dict[int, tuple[list, list]] = {}
    for chunk in pieces(texts):
        piece, first, runs, hashes, data, starts = anchors(chunk, rolling)
        some = np.flatnonzero(known.levels(hashes) > 0)
        raw = data.tobytes()
        for p, f, n, h in zip(piece[some].tolist(), first[some].tolist(), runs[some].tolist(), hashes[some].tolist(), strict=True):
            context = raw[f : f + n + LENGTH - 1]
            i = xxhash.xxh3_64_intdigest(context) - (1 << 63)
            ids, firsts = of.setdefault(chunk[p][0], ([], []))
            ids.append(i)
            firsts.append(chunk[p][1] + f - int(starts[p]))
            if i in met:
                met[i][3] += 1
            else:
                met[i] = [h - (1 << 63), h % parts, context, 1]
    yield pa.RecordBatch.from_pylist([{"key": keys[d], "contexts": ids, "firsts": firsts} for d, (ids, firsts) in of.items()], schema=_CONTEXT)


def _met_rows(met: dict[int, list]) -> Iterator[pa.RecordBatch]:
    """Each context with how often it was met."""
    rows = [{"id": i, "anchor": a, "part": p, "context": c, "times": n} for i, (a, p, c, n) in met.items()]
    for k in range(0, len(rows), 20_000):
        yield pa.RecordBatch.from_pylist(rows[k : k + 20_000], schema=_CONTEXT)


def contexts(docs: DataFrame, blocks: DataFrame, filter_parts: int, parts: int, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Two kinds of rows: for each text with candidates its contexts and where their first strings start; and, once a task, each
    context with how often it was met."""
    size = blocks.agg(F.coalesce(F.sum(F.octet_length("block")), F.lit(0))).first()[0]
    if size > max_broadcast_bytes:
        return _contexts_by_join(docs, blocks, filter_parts, parts)
    found = blocks.toArrow()
    at = {p: i for i, p in enumerate(found.column(0).to_pylist())}
    shared = docs.sparkSession.sparkContext.broadcast(LogFrequencyFilter([memoryview(found.column(1)[at[p]].as_buffer()) if p in at else b"\0" * 8 for p in range(filter_parts)]))

    def find(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = shared.value, {}
        for batch in source:
            for own in parts_of(pc.binary_length(batch.column(1)).to_pylist(), 1_000, CHUNK_BYTES // 4):
                yield from _contexts_of(batch.column(0)[own].to_pylist(), batch.column(1)[own].to_pylist(), known, parts, met)
                if len(met) * (LENGTH + 300) >= FLUSH_BYTES:
                    yield from _met_rows(met)
                    met.clear()
        yield from _met_rows(met)

    return _keyed(docs).mapInArrow(lean(find), CONTEXT_DDL)


def _contexts_by_join(docs: DataFrame, blocks: DataFrame, filter_parts: int, parts: int) -> DataFrame:
    """The same where the filter is too large to be broadcast: chunks of texts are written, their distinct anchors go to the blocks, and
    chunks and answers meet."""

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in source:
            for own in parts_of(pc.binary_length(batch.column(1)).to_pylist(), 1_000, CHUNK_BYTES):
                n = own.stop - own.start
                yield pa.RecordBatch.from_arrays([pa.array([number] * n), batch.column(0)[own], batch.column(1)[own]], ["chunk", "key", "text"])
                number += 1

    def probe(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in source:
            chunk = np.asarray(batch.column(0))
            for c in np.unique(chunk).tolist():  # a batch's end may cut a chunk; then it asks twice
                h = np.unique(np.concatenate([np.empty(0, np.uint64), *(anchors(x, rolling)[3] for x in pieces(batch.column(1).filter(pa.array(chunk == c)).to_pylist()))]))
                part, keys = placed(h, filter_parts)
                for p in np.unique(part).tolist():
                    own = part == p
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([c]), pa.array([packed(keys[own])], pa.binary()), pa.array([h[own].tobytes()], pa.binary())], ["part", "chunk", "keys", "hashes"])

    def look_up(asked: pa.Table, block: pa.Table) -> pa.Table:
        known = LogFrequencyFilter([block.column("block")[0].as_py() if block.num_rows else b"\0" * 8])
        out = []
        for keys, hashes in zip(asked.column("keys").to_pylist(), asked.column("hashes").to_pylist(), strict=True):
            keys = unpacked(keys)
            out.append(np.frombuffer(hashes, np.uint64)[known.levels_at(np.zeros(len(keys), np.int64), keys) > 0].tobytes())
        return pa.table({"chunk": asked.column("chunk"), "hashes": pa.array(out, pa.binary())})

    def find(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        known, met = Members(np.frombuffer(b"".join(answers.column("hashes").to_pylist()), np.uint64)), {}
        rows = list(_contexts_of(chunk.column("key").to_pylist(), chunk.column("text").to_pylist(), known, parts, met))
        return pa.Table.from_batches([*rows, *_met_rows(met)], schema=_CONTEXT)

    chunks = staged(_keyed(docs).mapInArrow(lean(pack), "chunk long, key binary, text binary"), "anchor-chunks", row_group=32 << 20)
    probes = chunks.select("chunk", "text").mapInArrow(lean(probe), "part int, chunk long, keys binary, hashes binary")
    answers = probes.groupBy("part").cogroup(blocks.groupBy("part")).applyInArrow(look_up, "chunk long, hashes binary")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(find, CONTEXT_DDL)


class Members:
    """A filter that knows its members one by one."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return (self.hashes[at] == hashes).astype(np.int64)


def refine(texts: list[bytes], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, string) of every string of LENGTH bytes in the contexts that occurs more than once, contexts counting `times`."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    bucket = Rolling().of(data, Q)  # the initial bucket of each position

    def inside(size: int) -> tuple[np.ndarray, np.ndarray]:
        n = lengths - size + 1
        own = np.repeat(np.arange(len(texts)), n)
        return own, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)

    size, pointers = Q, bucket
    while size < LENGTH:
        # a position's new bucket: its old one together with the old one of the position `size` later
        own, at = inside(2 * size)
        left, right = pointers[at], pointers[at + size]
        if size > Q:
            alive = (left != 0) & (right != 0)  # 0: alone in its bucket, hence unique at any greater length
            own, at, left, right = own[alive], at[alive], left[alive], right[alive]
            code = left * _U64(len(data) + 1) + right  # pointers are ranks now
        else:
            code = mixed(left * ODD + right)
        _, rank = np.unique(code, return_inverse=True)
        members = np.bincount(rank, times[own])
        rank = np.where(members[rank] > 1, rank + 1, 0).astype(np.uint64)
        pointers = np.zeros(len(data), np.uint64)
        pointers[at] = rank
        size *= 2
    hit = rank > 0
    return own[hit], at[hit] - starts[own[hit]]


def _runs(own: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings of a context: context, first, last."""
    if not len(own):
        return own, string, string
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (string[1:] != string[:-1] + 1)])
    last = np.concatenate([new[1:], [True]])
    return own[new], string[new], string[last]


COVER_DDL = "id long, first int, last int"


def _refined(t: pa.Table) -> pa.Table:
    ids, inverse = np.unique(t.column("id").to_numpy(), return_inverse=True)
    times = np.bincount(inverse, t.column("times").to_numpy(), len(ids))
    where = np.zeros(len(ids), np.int64)
    where[inverse] = np.arange(len(inverse))
    texts = t.column("context").take(pa.array(where)).to_pylist()
    own, first, last = _runs(*refine(texts, times))
    return pa.table({"id": pa.array(ids[own]), "first": pa.array(first.astype(np.int32)), "last": pa.array(last.astype(np.int32))})


def _strings(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of the contexts of hot buckets: 128 bits of hash, context, place."""
    for batch in source:
        for i, c, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            digests = [xxhash.xxh3_128_digest(c[k : k + LENGTH]) for k in range(len(c) - LENGTH + 1)]
            m = len(digests)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([i] * m, pa.int64()), pa.array(range(m), pa.int32()), pa.array([n] * m, pa.int64())], ["string", "id", "place", "times"])


def covers(found: DataFrame, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(id, first, last): the runs of repeated strings of each context."""
    rows = found.filter("id is not null").select("id", "anchor", "part", "context", "times")
    hot = staged(rows.groupBy("anchor").count().filter(F.col("count") > hot_contexts).select("anchor"), "hot-anchors")
    if hot.isEmpty():
        return rows.select("part", "id", "context", "times").groupBy("part").applyInArrow(_refined, COVER_DDL)
    plain = rows.join(hot, "anchor", "left_anti").select("part", "id", "context", "times").groupBy("part").applyInArrow(_refined, COVER_DDL)
    once = rows.join(hot, "anchor", "left_semi").groupBy("id").agg(F.first("context").alias("context"), F.sum("times").alias("times"))
    strings = staged(once.mapInArrow(lean(_strings), "string binary, id long, place int, times long"), "hot-strings")
    many = strings.groupBy("string").agg(F.sum("times").alias("n")).filter("n > 1").select("string")
    single = strings.join(many, "string", "left_semi").select("id", F.col("place").alias("first"), F.col("place").alias("last"))
    return plain.unionByName(single)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, spans): for each different text with a repeat, its repeated bytes as pairs of start and end, unmerged, in a flat array."""
    parts = max(64, 8 * shuffle_parts(docs.sparkSession))
    blocks, filter_parts = repeated_anchors(docs)
    found = staged(contexts(docs, blocks, filter_parts, parts, MAX_BROADCAST_BYTES), "contexts", row_group=32 << 20)
    cover = staged(covers(found), "covers")
    texts = found.filter("key is not null").groupBy("key").agg(F.first(F.struct("contexts", "firsts")).alias("x"))
    places = texts.select("key", F.explode(F.arrays_zip(F.col("x.contexts").alias("id"), F.col("x.firsts").alias("at"))).alias("p")).select("key", F.col("p.id").alias("id"), F.col("p.at").alias("at"))
    spans = places.join(cover, "id").select("key", F.array(F.col("at") + F.col("first"), F.col("at") + F.col("last") + LENGTH).alias("span"))
    return staged(spans.groupBy("key").agg(F.flatten(F.collect_list("span")).alias("spans")), "spans")


def merged(spans: list[int] | np.ndarray | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the pairs of start and end cover."""
    if spans is None or not len(spans):
        return []
    pairs = np.asarray(spans, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > ends[:-1]])
    last = np.concatenate([new[1:], [True]])
    return list(zip(pairs[new, 0].tolist(), ends[last].tolist(), strict=True))


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def with_spans(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str, str]:
    """The columns `keep` of docs with the text's bytes and its repeated spans, and the names of these two columns. AQE splits the join
    where many rows have one text."""
    text_bytes, key, spans = unused(docs, "text_bytes", "text_key", "repeated_spans")
    found = repeated_spans(docs).select(F.col("key").alias(key), F.col("spans").alias(spans))
    rows = docs.select(*[F.col(c) for c in keep], utf8("text").alias(text_bytes), F.unhex(F.md5(utf8("text"))).alias(key))
    return rows.join(found, key, "left").drop(key), text_bytes, spans


def deduplicated(docs: DataFrame, least_kept: int = 0) -> DataFrame:
    """docs with the repeated bytes cut out of text (bytes that no longer form a character are dropped; a null text stays null); all other
    columns as they are. Rows whose text has then fewer than least_kept characters go."""
    names = docs.columns
    [no_text] = unused(docs, "no_text")
    rest = [f for f in docs.schema if f.name != "text"]
    rows, text_bytes, spans = with_spans(docs.withColumn(no_text, F.col("text").isNull()), [*(f.name for f in rest), no_text])

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            n = len(rest)
            texts = [None if none else kept_bytes(t, merged(s)).decode("utf-8", "ignore") for none, t, s in zip(*(batch.column(n + k).to_pylist() for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], [*[f.name for f in rest], "text"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "text string"])
    rows = rows.select(*[f.name for f in rest], no_text, text_bytes, spans)
    return rows.mapInArrow(lean(cut), ddl).select(*names).filter(F.coalesce(F.length("text"), F.lit(0)) >= least_kept)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed of each document's bytes as strings of 200 that repeat; see the module's defined results."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def judge(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts, runs = batch.column(1).to_pylist(), [merged(s) for s in batch.column(2).to_pylist()]
            removed = [sum(b - a for a, b in r) for r in runs]
            digests = [hashlib.sha256(kept_bytes(t, r)).hexdigest() for t, r in zip(texts, runs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    rows, text_bytes, spans = with_spans(docs, ["doc_id"])
    return rows.select("doc_id", text_bytes, spans).mapInArrow(lean(judge), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
