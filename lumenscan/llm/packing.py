"""Best-fit packing of documents into sequences, by hierarchical residuals.

Every task packs its own pieces by best-fit decreasing and emits the bins that are nearly full. Others travel on as items: groups of
tasks' underfull bins are packed again by best fit, and so on up a tree, until one group is left. A bin keeps its members, so an item
never has to be looked up again, and only underfull bins are ever shuffled.

After a round no two bins of a group fit together, so at most one of them is at most half full, and only such bins can still go into
others. A group therefore hands on its OPEN_BINS bins with most room and emits all others: a later round brings FAN_IN groups together,
that is at most FAN_IN bins that look for a place, and each finds one among the bins handed on if it finds one at all. No round ever
holds more than FAN_IN x OPEN_BINS bins, whatever the lengths of the documents.

Defined results: null text is an empty one and gives a piece that holds only the end id; rows that share a doc id are packed each for
itself; an empty table packs to nothing. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, staged, table
from .tokens import slices, tokenizer

SEQUENCE = 2048
#: A bin with no more free places than this is emitted before the last round.
NEARLY_FULL = 4
#: Underfull bins of so many groups meet in one of the next round, and so many of each at most, more than FAN_IN.
FAN_IN, OPEN_BINS = 16, 512
MEMBERS = "array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"
BIN_DDL = f"grp long, done boolean, sequence_id long, fill int, members {MEMBERS}"
_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BIN = pa.schema([("grp", pa.int64()), ("done", pa.bool_()), ("sequence_id", pa.int64()), ("fill", pa.int32()), ("members", pa.list_(_MEMBER))])


def best_fit(lengths: list[int] | np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest bin that still takes it. Returns the items of each bin.

    Bins are kept by their free room (there are at most `capacity` different rooms), so the time is items x log(rooms)."""
    order = np.argsort(-np.asarray(lengths), kind="stable").tolist()
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted, those with a bin
    for i in order:
        size = int(lengths[i])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= size
        if room:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(b)
    return bins


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the first may be shorter."""
    first = total % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def _bins_of(items: list[list[dict]], fills: list[int], capacity: int, last: bool, prefix: int, open_bins: int = OPEN_BINS) -> list[dict]:
    """Bins of items (each the members of a bin so far). Done are all in the last round, else those nearly full and all but the
    open_bins with most room."""
    out = []
    for n, chosen in enumerate(best_fit(fills, capacity)):
        members, at = [], 0
        for i in chosen:
            members += [m | {"offset": m["offset"] + at} for m in items[i]]
            at += fills[i]
        out.append({"grp": 0, "done": last or capacity - at <= NEARLY_FULL, "sequence_id": prefix + n, "fill": at, "members": members})
    for b in sorted((b for b in out if not b["done"]), key=lambda b: b["fill"])[open_bins:]:
        b["done"] = True
    return out


def local_bins(docs: DataFrame, path: str, end_id: int, capacity: int = SEQUENCE, chunk: int = 50_000, open_bins: int = OPEN_BINS) -> DataFrame:
    """The first round, where the texts are: tokenize, cut, pack the pieces of a task, `chunk` at a time together with the bins that the
    chunks before left open."""

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        prefix, items, fills = part << 32, [], []

        def flush(end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal prefix, items, fills
            bins = [b | {"grp": part} for b in _bins_of(items, fills, capacity, False, prefix, open_bins)]
            left = [] if end else [b for b in bins if not b["done"]]
            prefix, items, fills = prefix + len(bins), [b["members"] for b in left], [b["fill"] for b in left]
            bins = [b for b in bins if end or b["done"]]
            for k in range(0, len(bins), 5_000):
                yield pa.RecordBatch.from_pylist(bins[k : k + 5_000], schema=BIN)

        for batch in source:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for piece in slices(texts):
                for doc_id, ids in zip(doc_ids[piece], tokenizer(path).encode(texts[piece]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        crc = zlib.crc32(ids[start : start + length].tobytes())
                        items.append([{"doc_id": doc_id, "piece": k, "start": start, "length": length, "ids_crc32": crc, "offset": 0}])
                        fills.append(length)
                if len(items) >= chunk + open_bins:
                    yield from flush(False)
        if items:
            yield from flush(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(pack), BIN_DDL)


def _repacker(capacity: int, last: bool, prefix: int):
    def repack(t: pa.Table) -> pa.Table:
        grp = t.column("grp")[0].as_py()
        rows = _bins_of(t.column("members").to_pylist(), t.column("fill").to_pylist(), capacity, last, prefix + (grp << 32))
        return pa.Table.from_pylist([r | {"grp": grp} for r in rows], schema=BIN)

    return repack


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document."""
    bins = staged(local_bins(docs, path, end_id, capacity), "bins")
    finished, open_bins, level = [bins.filter("done")], bins.filter("not done"), 1
    while True:
        groups = open_bins.agg(F.countDistinct("grp")).first()[0]
        if not groups:
            break
        last = groups <= FAN_IN
        joined = open_bins.withColumn("grp", F.lit(0).cast("long") if last else F.floor(F.col("grp") / FAN_IN))
        bins = staged(joined.groupBy("grp").applyInArrow(_repacker(capacity, last, level << 56), BIN_DDL), "bins")
        finished.append(bins.filter("done"))
        open_bins, level = bins.filter("not done"), level + 1
        if last:
            break
    out = finished[0]
    for x in finished[1:]:
        out = out.unionByName(x)
    return out.select("sequence_id", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")


def sequences(docs: DataFrame, places: DataFrame, path: str, end_id: int) -> DataFrame:
    """The packed token ids: sequence_id, ids. Needs unique doc ids. A sequence holds at most its capacity, whatever the corpus."""

    def encode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids = tokenizer(path).encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[*x.tolist(), end_id] for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(encode), "doc_id long, ids array<int>")
    pieces = ids.join(places, "doc_id").select("sequence_id", "offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids"))
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return rows.select("sequence_id", F.flatten(F.transform("x", lambda p: p["ids"])).alias("ids"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document is in sequences of 2048 tokens; see the module's defined results."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)
