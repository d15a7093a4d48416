"""Benchmark decontamination with a distributed positional inverted index.

The index holds every token of the training texts. It is split by document into segments, each of which is one row: its documents, and
the postings of its terms (term hashes, list lengths, positions) as packed arrays. A query reads the lists of the benchmark's terms
only: corpus frequencies come from the list lengths; each window is then looked up from its rarest term, whose positions, moved back by
the term's offset, are the candidate starts, and is intersected with the offset-adjusted lists of its other terms in order of rarity.
Building and matching are narrow: no posting is ever shuffled, and a hot term is spread over all segments.

The benchmark is a stated query set of any size: it is read a few megabytes at a time and matched in blocks of BLOCK_WINDOWS windows
against the whole index, so neither the driver nor a task ever holds more of it than a block. Rows of the index have numbers of their own,
by which what several blocks found of a document comes together.

Terms are held by 64-bit hash. Defined results: null text has no words and is never hit; rows that share a doc id are judged each for
itself; items without words never match; items that share an id count once, those without one together as one that the list of ids
leaves out; an empty index or benchmark matches nothing. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, parts_of, staged, table, utf8, word_hashes, words_by_text

WINDOW = 13
SEGMENT_BYTES = 1 << 19
#: Windows of a block of the benchmark, some 200 bytes each; and how much of the benchmark is fetched at a time.
BLOCK_WINDOWS, FETCH_BYTES = 300_000, 8 << 20
SEGMENT_DDL = "segment long, doc_ids binary, null_ids binary, n_words binary, terms binary, lengths binary, positions binary"
_SEGMENT = pa.schema([("segment", pa.int64()), *((n, pa.binary()) for n in ("doc_ids", "null_ids", "n_words", "terms", "lengths", "positions"))])
#: Bytes of words are kept (A-Z as a-z), all others become spaces.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _segment(number: int, doc_ids: list, words: list[np.ndarray]) -> dict[str, bytes | int]:
    lengths = np.array([len(w) for w in words], "<u4")
    # one position is left free between documents, so that no window can cross
    starts = np.concatenate([[0], np.cumsum(lengths.astype(np.int64) + 1)])[:-1]
    all_words = np.concatenate(words) if words else np.empty(0, np.uint64)
    positions = (np.arange(len(all_words)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)).astype(np.uint32)
    by = np.argsort(all_words, kind="stable")
    terms, counts = np.unique(all_words[by], return_counts=True)
    return {
        "segment": number, "doc_ids": np.array([d or 0 for d in doc_ids], "<i8").tobytes(), "null_ids": np.array([d is None for d in doc_ids], "u1").tobytes(), "n_words": lengths.tobytes(),
        "terms": terms.astype("<u8").tobytes(), "lengths": counts.astype("<u4").tobytes(), "positions": positions[by].astype("<u4").tobytes(),
    }


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of docs (doc_id, text), written to the shared folder, one row a segment."""

    def build(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, held, number = [], [], 0, TaskContext.get().partitionId() << 32
        for batch in source:
            for own in parts_of(pc.binary_length(batch.column(1)).to_pylist(), 1000, SEGMENT_BYTES):
                texts = batch.column(1)[own].to_pylist()
                for doc_id, text, found in zip(batch.column(0)[own].to_pylist(), texts, words_by_text(texts, WORD_TABLE), strict=True):
                    ids.append(doc_id)
                    words.append(found)
                    held += len(text) + 16
                    if held >= SEGMENT_BYTES:
                        yield pa.RecordBatch.from_pylist([_segment(number, ids, words)], schema=_SEGMENT)
                        ids, words, held, number = [], [], 0, number + 1
        if ids:
            yield pa.RecordBatch.from_pylist([_segment(number, ids, words)], schema=_SEGMENT)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return staged(rows.mapInArrow(lean(build), SEGMENT_DDL), "postings", row_group=16 << 20)


class Segment:
    """One row of the index, with the lists of the terms asked for."""

    def __init__(self, row: dict[str, bytes | int]):
        self.number = row["segment"]
        ids, null = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["null_ids"], "u1")
        self.doc_ids = [None if n else int(i) for i, n in zip(ids, null, strict=True)]
        self.n_words = np.frombuffer(row["n_words"], "<u4").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.n_words + 1)])[:-1].astype(np.int64)
        self.size = int(self.n_words.sum() + len(self.n_words))
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.first = np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], "<u4"), dtype=np.int64)])
        self.positions = np.frombuffer(row["positions"], "<u4")

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the posting lists of these term hashes in self.positions; equal bounds: not here."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        found = self.terms[at] == terms
        return np.where(found, self.first[at], 0), np.where(found, self.first[at + 1], 0)


def corpus_frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each term occurs in the whole index; one partial sum a task reaches the driver's terms."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, total = shared.value, np.zeros(len(shared.value), np.int64)
        for batch in source:
            for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t, n = np.frombuffer(t, "<u8"), np.frombuffer(n, "<u4")
                if len(t):
                    at = np.minimum(np.searchsorted(t, asked), len(t) - 1)
                    total += np.where(t[at] == asked, n[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "n"])

    sums = index.select("terms", "lengths").mapInArrow(lean(count), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(terms), np.int64)
    for r in sums.collect():
        out[r[0]] = r[1]
    return out


class Windows:
    """The distinct windows of a block of items (id, word hashes): matrix of term numbers, each with the order in which its terms are
    intersected, and the items it is in."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], size: int):
        some = [i for i, (_, words) in enumerate(items) if len(words)]
        counts = [max(1, len(items[i][1]) - size + 1) for i in some]
        table = np.zeros((sum(counts), size + 1), np.uint64)  # the last column: the window's length
        at = 0
        for i, n in zip(some, counts, strict=True):
            words = items[i][1]
            if len(words) >= size:
                table[at : at + n, :size] = np.lib.stride_tricks.sliding_window_view(words, size)
            else:
                table[at, : len(words)] = words
            table[at : at + n, size] = min(size, len(words))
            at += n
        _, first, window = np.unique(table.view(f"V{8 * (size + 1)}").ravel(), return_index=True, return_inverse=True)
        pairs = np.unique(window.astype(np.int64) * max(1, len(items)) + np.repeat(np.array(some, np.int64), counts))
        self.item_ids = [i for i, _ in items]
        self.items = pairs % max(1, len(items))
        self.items_from = np.searchsorted(pairs // max(1, len(items)), np.arange(len(first) + 1))
        self.lengths = table[first, size].astype(np.int64)
        self.terms, inverse = np.unique(table[first, :size], return_inverse=True)
        self.matrix = inverse.reshape(len(first), size).astype(np.int32)

    def items_of(self, window: int) -> list[int]:
        return self.items[self.items_from[window] : self.items_from[window + 1]].tolist()

    def order(self, frequencies: np.ndarray) -> None:
        """From now on each window's terms are taken from the rarest in the corpus to the most frequent."""
        f = frequencies[self.matrix].astype(np.float64)
        f[np.arange(f.shape[1])[None, :] >= self.lengths[:, None]] = np.inf  # places that short windows lack
        self.by_rarity = np.argsort(f, axis=1, kind="stable").astype(np.int8)
        self.live = np.flatnonzero((np.where(np.isinf(f), 1, f) > 0).all(axis=1))  # a term that never occurs rules its windows out


def occurrences(segment: Segment, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every exact occurrence in the segment."""
    lo, hi = segment.lists(w.terms)
    here = w.live
    if len(here):
        present = (hi > lo)[w.matrix[here]] | (np.arange(w.matrix.shape[1])[None, :] >= w.lengths[here, None])
        here = here[present.all(axis=1)]
    if not len(here):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # which term stands at a position: the posting lists of the terms asked for, by position
    at = np.full(segment.size + w.matrix.shape[1], -1, np.int32)
    some = np.flatnonzero(hi > lo)
    for t in some:
        at[segment.positions[lo[t] : hi[t]]] = t
    rare = w.by_rarity[here, 0].astype(np.int64)
    anchor = w.matrix[here, rare]
    counts = hi[anchor] - lo[anchor]
    window = np.repeat(here, counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = segment.positions[np.repeat(lo[anchor], counts) + inside].astype(np.int64) - np.repeat(rare, counts)
    keep = start >= 0
    window, start = window[keep], start[keep]
    for k in range(1, w.matrix.shape[1]):
        offset = w.by_rarity[window, k].astype(np.int64)
        keep = (k >= w.lengths[window]) | (at[start + offset] == w.matrix[window, offset])
        window, start = window[keep], start[keep]
        if not len(window):
            break
    return window, start


def matches(index: DataFrame, items: list[tuple[str | None, np.ndarray]], size: int = WINDOW) -> DataFrame:
    """For each indexed document: segment and place, doc_id, n_words, spans (first and last hit word, merged, in a flat array), items
    (distinct ids with a window in it, null last). items: (id, word hashes) pairs of one block of the benchmark."""
    w = Windows(items, size)
    w.order(corpus_frequencies(index, w.terms) if len(w.terms) else np.zeros(0, np.int64))
    shared = index.sparkSession.sparkContext.broadcast(w)

    def match(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in source:
            for i in range(batch.num_rows):
                s = Segment({f.name: batch.column(k)[i].as_py() for k, f in enumerate(batch.schema)})
                window, start = occurrences(s, w)
                doc = np.searchsorted(s.starts, start, "right") - 1
                spans: list[list[int]] = [[] for _ in s.doc_ids]
                found: list[set] = [set() for _ in s.doc_ids]
                for k in np.argsort(start, kind="stable").tolist():
                    d = int(doc[k])
                    first = int(start[k] - s.starts[d])
                    last = first + int(w.lengths[window[k]]) - 1
                    found[d].update(w.items_of(window[k]))
                    if spans[d] and first <= spans[d][-1] + 1:
                        spans[d][-1] = max(spans[d][-1], last)
                    else:
                        spans[d] += [first, last]
                own = len(s.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s.number] * own, pa.int64()), pa.array(range(own), pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(s.n_words), pa.array(spans, pa.list_(pa.int32())), pa.array([sorted({w.item_ids[i] for i in x}, key=lambda i: (i is None, i)) for x in found], pa.list_(pa.string()))],
                    ["segment", "place", "doc_id", "n_words", "spans", "items"],
                )

    return index.mapInArrow(lean(match), "segment long, place int, doc_id long, n_words long, spans array<int>, items array<string>")


def proximity(index: DataFrame, words: list[str], within: int) -> DataFrame:
    """(doc_id, first, last): the closest stretches of at most `within` words that hold all the words, in any order: for each occurrence
    of the rarest word, the nearest occurrence of each other on either side."""
    terms = np.unique(word_hashes([x.encode() for x in words], WORD_TABLE)[0])
    by_rarity = np.argsort(corpus_frequencies(index, terms), kind="stable")

    def near(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                s = Segment(row)
                lo, hi = s.lists(terms)
                if not len(terms) or (hi == lo).any():
                    continue
                lists = [np.sort(s.positions[lo[t] : hi[t]].astype(np.int64)) for t in by_rarity]
                out = set()
                for p in lists[0].tolist():
                    close = [x[(x > p - within) & (x < p + within)] for x in lists[1:]]
                    if all(len(x) for x in close):
                        for first in [p, *(int(v) for x in close for v in x[x <= p])]:
                            last = max([p, *(int(x[x >= first][0]) if (x >= first).any() else first + within for x in close)])
                            d = int(np.searchsorted(s.starts, first, "right")) - 1
                            if last - first < within and last < s.starts[d] + s.n_words[d]:
                                out.add((d, first - int(s.starts[d]), last - int(s.starts[d])))
                best = [(d, a, b) for d, a, b in out if not any(e == d and a <= a2 and b2 <= b and (a2, b2) != (a, b) for e, a2, b2 in out)]
                if best:
                    yield pa.RecordBatch.from_arrays([pa.array([s.doc_ids[d] for d, _, _ in best], pa.int64()), pa.array([a for _, a, _ in best], pa.int64()), pa.array([b for _, _, b in best], pa.int64())], ["doc_id", "first", "last"])

    return index.mapInArrow(lean(near), "doc_id long, first long, last long")


def contaminated(n_hit, n_words):
    """The rule: at least a twentieth of the document's words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def blocks_of(benchmark: DataFrame, size: int = WINDOW) -> Iterator[list[tuple[str | None, np.ndarray]]]:
    """The benchmark's items as (id, word hashes), in blocks of BLOCK_WINDOWS windows; an item of more is spread over several."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), utf8("text").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    block, held = [], 0
    for r in rows.repartition(max(1, -(-total // FETCH_BYTES))).toLocalIterator():
        [words] = words_by_text([bytes(r[1])], WORD_TABLE)
        windows = max(1, len(words) - size + 1) if len(words) else 0
        for at in range(0, windows, BLOCK_WINDOWS):
            block.append((r[0], words[at : at + BLOCK_WINDOWS + size - 1]))
            held += min(BLOCK_WINDOWS, windows - at)
            if held >= BLOCK_WINDOWS:
                yield block
                block, held = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans, items for each row of docs; the benchmark is taken in blocks."""
    index, found, several = build_index(docs), None, False
    blocks = blocks_of(benchmark, size)
    block, after = next(blocks, []), next(blocks, None)
    while True:
        part = matches(index, block, size)
        several = several or after is not None
        if several:  # only what was found, and one row a document
            part = staged(part.filter("size(spans) > 0") if found is not None else part, "block-matches")
        found = part if found is None else found.unionByName(part)
        if after is None:
            break
        block, after = after, next(blocks, None)
    if several:
        found = found.groupBy("segment", "place").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
    return found.drop("segment", "place")


def hit_words(spans):
    """How many words the spans cover; spans of several blocks may overlap."""
    pairs = F.transform(F.sequence(F.lit(0), (F.size(spans) / 2 - 1).cast("int")), lambda i: F.struct(F.element_at(spans, (2 * i + 1).cast("int")).alias("a"), F.element_at(spans, (2 * i + 2).cast("int")).alias("b")))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n"))
    total = F.aggregate(F.array_sort(pairs), start, lambda s, p: F.struct(F.greatest(s["last"], p["b"]).alias("last"), (s["n"] + F.greatest(F.lit(0), p["b"] - F.greatest(s["last"] + 1, p["a"]) + 1)).alias("n")), lambda s: s["n"])
    return F.when(F.size(spans) > 0, total).otherwise(0).cast("long")


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = decontaminate(docs, benchmark).withColumn("n_hit", hit_words(F.col("spans")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of each document lie in windows of benchmark items; see the module's defined results."""
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
