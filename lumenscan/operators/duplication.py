"""Duplicate blocks: runs of at least min_lines lines and min_tokens tokens whose normalized text occurs more than once.

A stretch of R lines that occurs twice holds some R x R / 2 such blocks, each a group of its own, so groups are never listed on the way.
They are kept as `families`: a row (start, class, lo, hi) says that the block of l lines at `start` belongs to the group (class, l) for
every l from lo to hi. At each start the shortest block that counts is hashed; equal ones form a class. All members of a class are
compared with one of them, the same file's for neighbouring starts, by prefix hashes: hi is how far a member agrees with it. Members that
part from it at the same length and go on alike form a class of longer blocks, and so on; the member is chosen by a hash of its file, so
that a class of m members takes about log m rounds. Rows are as many as repeated lines, times rounds.

Blocks of a group that follow each other within a file are merged. For one file and class that divides the lengths into ranges within
which the same starts are merged (`pieces`); how many instances a group has, and which is its first, is found by ranges of lengths too
(`profile`). Groups are ordered by line count, then by their first instance, and hashes are digests of the normalized text.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenscan.functions.sequences import CONFIRM, Windows, common, scrambled
from lumenscan.functions.text import lines as lines_of
from lumenscan.operators.work import cut, shuffled
from lumenscan.sources.files import numbered

MIN_LINES, MIN_TOKENS, GAP = 10, 50, 5
#: Words that identifier renaming leaves alone.
KEYWORDS = frozenset(
    "if else elif for while do switch case default break continue return fn func function def class struct enum impl trait pub private protected public let const var import export from "
    "async await try catch finally throw new this self super true false null nil None Some Ok Err Result Option Vec String str int float bool void int32 int64 uint string object any never".split()
)


def normalized(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, r"(?U)\s+", " "), r"\A | \z", "")


def renamed_identifiers(line: str) -> str:
    """Identifiers that are no keyword as $_1, $_2, ... in order of appearance, also where they are part of longer words."""
    import re

    names: dict[str, str] = {}
    for word in re.findall(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b", line):
        if word not in KEYWORDS and word not in names:
            names[word] = f"$_{len(names) + 1}"
    for word, name in names.items():
        line = line.replace(word, name)
    return line


def tokens(line: Column) -> Column:
    """White-space tokens of more than one byte."""
    return F.size(F.filter(F.split(line, r"(?U)\s+", -1), lambda t: F.octet_length(t) > 1))


def _renamed(all_lines: pd.Series) -> pd.Series:
    return all_lines.map(lambda x: [renamed_identifiers(line) for line in x])


def _files(file_rows: DataFrame, ignore_whitespace: bool = True, ignore_identifiers: bool = False) -> DataFrame:
    rows = numbered(file_rows).withColumn("raw", lines_of(F.col("content")))
    rows = rows.select("file_ord", "path", "raw", (F.transform("raw", normalized) if ignore_whitespace else F.col("raw")).alias("norm"))
    if ignore_identifiers:  # names are numbered in order of appearance, which no built-in function can do
        rows = rows.withColumn("norm", F.pandas_udf(_renamed, "array<string>")("norm"))
    return rows


# --- families ---

CLS = ("cls_file", "cls_start", "lo")


def _measured(rows: DataFrame) -> DataFrame:
    """file_ord, path, hashes and token numbers of the lines."""
    return rows.select("file_ord", "path", F.transform("norm", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("norm", tokens).alias("tokens"))


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    ends, values = np.asarray(column.offsets), np.asarray(column.values)
    return (values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))


def _ends(counts: np.ndarray, min_lines: int, min_tokens: int) -> np.ndarray:
    """Where the shortest block ends that starts at each line; beyond the last line if there is none."""
    sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    n = len(counts)
    return np.maximum(np.searchsorted(sums, sums[:n] + min_tokens), np.arange(n) + min_lines)


def _seeds(measured: DataFrame, min_lines: int, min_tokens: int, within_files: bool) -> DataFrame:
    """file_ord, start, lo, key: the shortest block at each line that has one. The files of a batch are gone through at once, as one sequence
    in which no block reaches beyond its file."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            hashes, counts, at = batch.column(1).flatten(), batch.column(2).flatten(), np.asarray(batch.column(1).offsets).astype(np.int64)
            at, hashes, counts = at - at[0], np.asarray(hashes), np.asarray(counts)
            of = np.repeat(np.arange(len(at) - 1), np.diff(at))
            ends = _ends(counts, min_lines, min_tokens)
            start = np.flatnonzero(ends <= at[of + 1])
            if not len(start):
                continue
            size, of = ends[start] - start, of[start]
            key, file_ord = Windows(hashes).hash(start, size), np.asarray(batch.column(0))[of]
            if within_files:
                key = scrambled(key ^ scrambled(file_ord.astype(np.int64).view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(file_ord), pa.array((start - at[of]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(key.view(np.int64))], ["file_ord", "start", "lo", "key"])

    return measured.select("file_ord", "hashes", "tokens").mapInArrow(run, "file_ord long, start int, lo int, key long")


def _classed(members: DataFrame, key: str) -> DataFrame:
    """Members whose key others have too, with the one that all are compared with, chosen by a hash of its file."""
    chosen = F.min(F.struct(F.xxhash64("file_ord").alias("by"), "file_ord", "start")).alias("x")
    shared = members.groupBy(key).agg(F.count("*").alias("n"), chosen).filter("n > 1")
    return members.join(shuffled(shared.select(key, F.col("x.file_ord").alias("cls_file"), F.col("x.start").alias("cls_start"))), key).drop(key)


def _stretches(members: DataFrame, measured: DataFrame, min_lines: int, min_tokens: int) -> DataFrame:
    """file_ord, stretch (its first line), hashes, tokens of the runs of lines that repeated blocks can reach."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = []
            for file_ord, runs, hashes, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch.column(2)), _arrays(batch.column(3)), strict=True):
                ends = np.append(_ends(counts, min_lines, min_tokens), len(counts) + 1)
                for r in runs:
                    end = min(len(counts), int(ends[r["last"] + 1]) - 1)  # the next line's shortest block is not repeated
                    out.append((file_ord, r["stretch"], hashes[r["stretch"] : end], counts[r["stretch"] : end]))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.list_(pa.int32()))], ["file_ord", "stretch", "hashes", "tokens"])

    runs = members.groupBy("file_ord", "stretch").agg(F.max("start").alias("last")).groupBy("file_ord").agg(F.collect_list(F.struct("stretch", "last")).alias("runs"))
    return _dealt(runs.join(shuffled(measured.select("file_ord", "hashes", "tokens")), "file_ord")).mapInArrow(run, "file_ord long, stretch int, hashes array<long>, tokens array<int>")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of few bytes each of which costs some time, over all cores: by their bytes they would be put together for one task."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def _compared(members: DataFrame, stretches: DataFrame) -> DataFrame:
    """Members but those that the others are compared with, with hi and, where the stretch goes on, a key of class, hi and the next line."""
    own = members.filter((F.col("file_ord") != F.col("cls_file")) | (F.col("start") != F.col("cls_start")))
    own = own.groupBy("file_ord", "stretch", "cls_file").agg(F.collect_list("start").alias("starts"), F.collect_list("cls_start").alias("cls_starts"), F.collect_list("lo").alias("los"), F.min("cls_start").alias("least"), F.max("cls_start").alias("most"))
    theirs = stretches.select(F.col("file_ord").alias("cls_file"), F.col("stretch").alias("cls_stretch"), F.col("hashes").alias("cls_hashes"))
    pairs = own.join(shuffled(stretches.drop("tokens")), ["file_ord", "stretch"]).join(shuffled(theirs), "cls_file")
    pairs = pairs.filter((F.col("cls_stretch") <= F.col("most")) & (F.col("cls_stretch") + F.size("cls_hashes") > F.col("least")))
    pairs = pairs.select("file_ord", "stretch", "cls_file", "cls_stretch", "starts", "cls_starts", "los", "hashes", "cls_hashes")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = []
            for file_ord, stretch, cls_file, cls_stretch, start, cls_start, lo, hashes, cls_hashes in zip(*(batch.column(i).to_pylist() for i in range(4)), *(_arrays(batch.column(i)) for i in range(4, 9)), strict=True):
                here = (cls_start >= cls_stretch) & (cls_start < cls_stretch + len(cls_hashes))
                start, cls_start, lo = start[here], cls_start[here], lo[here]
                i = (start - stretch).astype(np.int64)
                hi = common(Windows(hashes, CONFIRM), i, Windows(cls_hashes, CONFIRM), (cls_start - cls_stretch).astype(np.int64))
                keep = hi >= lo  # else the hashes met by chance
                start, cls_start, lo, hi, i = start[keep], cls_start[keep], lo[keep], hi[keep], i[keep]
                goes_on = i + hi < len(hashes)
                key = scrambled(np.array([cls_file], np.int64).view(np.uint64) + scrambled(cls_start.astype(np.uint64) << np.uint64(32) | lo.astype(np.uint64)))
                key = scrambled(key ^ scrambled(hi.astype(np.uint64)) ^ hashes[np.minimum(i + hi, len(hashes) - 1)].view(np.uint64))
                out.append((np.full(len(start), file_ord), np.full(len(start), stretch, np.int32), start, np.full(len(start), cls_file), cls_start, lo, hi.astype(np.int32), key.view(np.int64), ~goes_on))
            if out:
                *columns, keys, ends_here = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(keys, mask=ends_here)], ["file_ord", "stretch", "start", "cls_file", "cls_start", "lo", "hi", "key"])

    return _dealt(pairs).mapInArrow(run, "file_ord long, stretch int, start int, cls_file long, cls_start int, lo int, hi int, key long")


def families(measured: DataFrame, min_lines: int = MIN_LINES, min_tokens: int = MIN_TOKENS, within_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """(families, stretches). Families: file_ord, stretch, start (a line, from 0), cls_file, cls_start, lo, hi; those of one class share
    the three columns in CLS. Stretches: the lines that they are in."""
    seeds = _classed(_seeds(measured, min_lines, min_tokens, within_files), "key")
    by_start = Window.partitionBy("file_ord").orderBy("start")
    runs = seeds.withColumn("run", F.col("start") - F.row_number().over(by_start))
    members = cut(runs.withColumn("stretch", F.min("start").over(Window.partitionBy("file_ord", "run"))).drop("run"))
    stretches = cut(_stretches(members, measured, min_lines, min_tokens))
    found = None
    while found is None or not members.isEmpty():
        compared = cut(_compared(members, stretches))
        reached = compared.groupBy(*CLS).agg(F.max("hi").alias("hi"))
        chosen = members.filter((F.col("file_ord") == F.col("cls_file")) & (F.col("start") == F.col("cls_start"))).join(shuffled(reached), list(CLS))
        part = compared.drop("key").unionByName(chosen.select("file_ord", "stretch", "start", *CLS, "hi"))
        found = part if found is None else found.unionByName(part)
        members = cut(_classed(compared.filter("key is not null").drop(*CLS).withColumn("lo", F.col("hi") + 1).drop("hi"), "key"))
    return cut(found), stretches


# --- pieces and profiles: ranges of lengths ---


def merged_starts(starts: np.ndarray, his: np.ndarray, lo: int) -> list[tuple[int, int, int, int, int]]:
    """(first length, last length, first start, last start, number of starts) of every instance that the blocks of one group and file at
    sorted starts merge to. Blocks of l lines merge if their starts are at most l + GAP - 1 apart."""
    out: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    size = lo
    while len(starts):
        gaps = np.diff(starts)
        apart = gaps > size + GAP - 1
        later = min([int(his.min()) + 1, *([int(gaps[apart].min()) - GAP + 1] if apart.any() else [])])
        edges = np.concatenate([[0], np.flatnonzero(apart) + 1, [len(starts)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            ranges = out.setdefault((int(starts[a]), int(starts[b - 1]), b - a), [])
            if ranges and ranges[-1][1] == size - 1:
                ranges[-1] = (ranges[-1][0], later - 1)
            else:
                ranges.append((size, later - 1))
        size = later
        alive = his >= size
        starts, his = starts[alive], his[alive]
    return [(x, y, a, b, k) for (a, b, k), ranges in out.items() for x, y in ranges]


def pieces(found: DataFrame) -> DataFrame:
    """CLS, file_ord, x, y, a, b, k: for l from x to y lines, the group (class, l) has in the file an instance of k blocks, the first at a, the
    last at b."""
    same = found.groupBy(*CLS, "file_ord").agg(F.sort_array(F.collect_list(F.struct("start", "hi"))).alias("s"))
    one = same.filter(F.size("s") == 1).select(*CLS, "file_ord", F.col("lo").alias("x"), F.col("s")[0]["hi"].alias("y"), F.col("s")[0]["start"].alias("a"), F.col("s")[0]["start"].alias("b"), F.lit(1).alias("k"))
    several = same.filter(F.size("s") > 1).select(*CLS, "file_ord", F.col("s.start").alias("starts"), F.col("s.hi").alias("his"))
    names = [*CLS, "file_ord", "x", "y", "a", "b", "k"]

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in source:
            rows = [(f, s, lo, o, *piece) for f, s, lo, o, starts, his in frame.itertuples(index=False) for piece in merged_starts(np.asarray(starts), np.asarray(his), lo)]
            yield pd.DataFrame(rows, columns=names)

    return one.unionByName(_dealt(several).mapInPandas(run, "cls_file long, cls_start int, lo int, file_ord long, x int, y int, a int, b int, k int"))


def _overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys whose ranges x to y overlap, with the common range."""
    right = right.withColumnsRenamed({"x": "x2", "y": "y2"})
    both = left.join(shuffled(right), keys).filter((F.col("x") <= F.col("y2")) & (F.col("x2") <= F.col("y")))
    return both.withColumns({"x": F.greatest("x", "x2"), "y": F.least("y", "y2")}).drop("x2", "y2")


def profile(found: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profile, numbers). Profile: CLS, x, y, first_file, first_start, shift, first_k for lengths with at least two instances: where the
    group's first instance starts, by how many lines more than l it is long, and of how many blocks it is. Numbers: CLS, x, y, n
    instances."""
    events = parts.select(*CLS, F.explode(F.array(F.struct(F.col("x").alias("at"), F.lit(1).alias("by")), F.struct((F.col("y") + 1).alias("at"), F.lit(-1).alias("by")))).alias("e"))
    events = events.select(*CLS, "e.at", "e.by").groupBy(*CLS, "at").agg(F.sum("by").alias("by"))
    order = Window.partitionBy(*CLS).orderBy("at")
    numbers = events.select(*CLS, F.col("at").alias("x"), (F.lead("at").over(order) - 1).alias("y"), F.sum("by").over(order).alias("n")).filter("n > 1")
    new = F.coalesce((F.col("x") != F.lag("y").over(Window.partitionBy(*CLS).orderBy("x")) + 1).cast("int"), F.lit(1))
    several = numbers.withColumn("new", new).withColumn("island", F.sum("new").over(Window.partitionBy(*CLS).orderBy("x"))).groupBy(*CLS, "island").agg(F.min("x").alias("x"), F.max("y").alias("y")).drop("island")
    # the first of the starts that reach a length: a staircase that only changes where it must
    steps = found.groupBy(*CLS, "hi").agg(F.min(F.struct("file_ord", "start")).alias("first"))
    longer = Window.partitionBy(*CLS).orderBy(F.desc("hi"))
    steps = steps.select(*CLS, "hi", F.min("first").over(longer).alias("first"), (F.coalesce(F.lead("hi").over(longer) + 1, F.col("lo"))).alias("x"))
    firsts = steps.groupBy(*CLS, "first").agg(F.min("x").alias("x"), F.max("hi").alias("y")).select(*CLS, "x", "y", F.col("first.file_ord").alias("first_file"), F.col("first.start").alias("first_start"))
    at_first = parts.select(*CLS, F.col("file_ord").alias("first_file"), F.col("a").alias("first_start"), "x", "y", (F.col("b") - F.col("a")).alias("shift"), F.col("k").alias("first_k"))
    return _overlap(_overlap(firsts, at_first, [*CLS, "first_file", "first_start"]), several, list(CLS)), numbers


# --- what users ask for ---


def _found(rows: DataFrame, min_lines: int, min_tokens: int, within_files: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """families, stretches, pieces, profile, numbers"""
    found, stretches = families(cut(_measured(rows)), min_lines, min_tokens, within_files)
    parts = cut(pieces(found))
    shape, numbers = profile(found, parts)
    return found, stretches, parts, cut(shape), numbers


def _digests(shape: DataFrame, rows: DataFrame) -> DataFrame:
    """CLS, l, hash, tokens of every group: digests of the first instance's block, each line hashed once a start."""
    names = [*CLS, "l", "hash", "tokens"]

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in source:
            out = []
            for cls_file, cls_start, lo, x, y, start, norm in frame.itertuples(index=False):
                sha, n = hashlib.sha256(), 0
                for size in range(1, y + 1):
                    line = norm[start + size - 1]
                    sha.update((line if size == 1 else "\n" + line).encode())
                    n += sum(len(t.encode()) > 1 for t in line.split())
                    if size >= x:
                        out.append((cls_file, cls_start, lo, size, sha.hexdigest()[:16], n))
            yield pd.DataFrame(out, columns=names)

    texts = rows.select(F.col("file_ord").alias("first_file"), "norm")
    asked = shape.select(*CLS, "x", "y", "first_file", "first_start").join(shuffled(texts), "first_file").select(*CLS, "x", "y", "first_start", "norm")
    return asked.mapInPandas(run, "cls_file long, cls_start int, lo int, l int, hash string, tokens int")


def instances(file_rows: DataFrame, min_lines: int = MIN_LINES, min_tokens: int = MIN_TOKENS, within_files: bool = False, **normalizer: bool) -> DataFrame:
    """Every instance of every group with at least two, listed: hash, token_count and line_count (of the group's first), file_ord, path,
    line_start, line_end, preview, and the group's first instance for ordering. As many rows as there are blocks; percentages() and
    group_counts() answer without the list. normalizer: ignore_whitespace (by default) and ignore_identifiers (not)."""
    rows = _files(file_rows, **normalizer)
    _, _, parts, shape, _ = _found(rows, min_lines, min_tokens, within_files)
    listed = _overlap(parts, shape, list(CLS)).withColumn("l", F.explode(F.sequence("x", "y"))).join(shuffled(_digests(shape, rows)), [*CLS, "l"])
    paths = rows.select(F.col("file_ord").alias("first_file"), F.col("path").alias("first_path"))
    listed = listed.join(shuffled(rows.select("file_ord", "path", "raw")), "file_ord").join(shuffled(paths), "first_file")
    return listed.select(
        "hash", "file_ord", "path", (F.col("a") + 1).alias("line_start"), (F.col("b") + F.col("l")).alias("line_end"), F.array_join(F.slice("raw", F.col("a") + 1, 3), "\n").alias("preview"),
        (F.col("first_k") * F.col("tokens")).cast("long").alias("token_count"), (F.col("l") + F.col("shift")).alias("line_count"), "first_path", (F.col("first_start") + 1).alias("first_line"),
    )


def groups(file_rows: DataFrame, min_lines: int = MIN_LINES, min_tokens: int = MIN_TOKENS, **normalizer: bool) -> DataFrame:
    """hash, token_count, line_count, instances, the longest first."""
    rows = instances(file_rows, min_lines, min_tokens, **normalizer)
    own = F.struct("file_ord", "line_start", F.col("path").alias("file_path"), "line_end", F.col("preview").alias("content_preview"))
    out = rows.groupBy("hash", "token_count", "line_count", "first_path", "first_line").agg(F.array_sort(F.collect_list(own)).alias("x"))
    shown = F.transform("x", lambda i: F.struct(i["file_path"].alias("file_path"), i["line_start"].alias("line_start"), i["line_end"].alias("line_end"), i["content_preview"].alias("content_preview")))
    return out.orderBy(F.desc("line_count"), "first_path", "first_line", "hash").select("hash", "token_count", "line_count", shown.alias("instances"))


def group_counts(file_rows: DataFrame, min_lines: int = MIN_LINES, min_tokens: int = MIN_TOKENS, **normalizer: bool) -> DataFrame:
    """line_count, token_count, n (instances), n_groups: how many groups there are of each kind. Groups are counted by ranges of lengths
    where their lines are."""
    rows = _files(file_rows, **normalizer)
    found, stretches, _, shape, numbers = _found(rows, min_lines, min_tokens, False)
    at = found.select(F.col("file_ord").alias("first_file"), F.col("start").alias("first_start"), "stretch").distinct()
    ranges = _overlap(shape, numbers, list(CLS)).join(shuffled(at), ["first_file", "first_start"])
    ranges = ranges.groupBy("first_file", "stretch").agg(F.collect_list(F.struct("first_start", "x", "y", "shift", "first_k", F.col("n").cast("int").alias("n"))).alias("ranges"))
    lines = stretches.select(F.col("file_ord").alias("first_file"), "stretch", "tokens")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[tuple[int, int, int]] = Counter()
        for batch in source:
            for stretch, own, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch.column(2)), strict=True):
                sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                for r in own:
                    i, size = r["first_start"] - stretch, np.arange(r["x"], r["y"] + 1)
                    counted.update(zip((size + r["shift"]).tolist(), ((sums[i + size] - sums[i]) * r["first_k"]).tolist(), [r["n"]] * len(size), strict=True))
            if len(counted) > 1_000_000:
                yield _counted(counted)
                counted.clear()
        yield _counted(counted)

    every = ranges.join(shuffled(lines), ["first_file", "stretch"]).select("stretch", "ranges", "tokens").mapInArrow(run, "line_count int, token_count long, n long, n_groups long")
    return every.groupBy("line_count", "token_count", "n").agg(F.sum("n_groups").alias("n_groups"))


def _counted(counted: Counter) -> pa.RecordBatch:
    keys = list(zip(*counted, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int32()), pa.array(keys[1], pa.int64()), pa.array(keys[2], pa.int64()), pa.array(list(counted.values()), pa.int64())], ["line_count", "token_count", "n", "n_groups"])


class Taken:
    """Disjoint ranges of lines, in order."""

    def __init__(self) -> None:
        self.ranges: list[tuple[int, int]] = []

    def next_of(self, line: int) -> tuple[int, int] | None:
        """The first range that ends at the line or later."""
        i = bisect_left(self.ranges, (line,))
        if i and self.ranges[i - 1][1] >= line:
            return self.ranges[i - 1]
        return self.ranges[i] if i < len(self.ranges) else None

    def add(self, first: int, last: int) -> None:
        insort(self.ranges, (first, last))


def duplicated_lines(candidates: list[tuple]) -> int:
    """Lines that the instances of one file count, in group order: an instance counts its group's lines unless it overlaps one counted
    before. candidates: (first_path, first_line, shift, x, y, a, b) of pieces; a piece comes up with its longest instance, and again with
    the longest that still ends before what has been counted."""
    heap = [(-(y + shift), path, line, -y, a, b, shift, x) for path, line, shift, x, y, a, b in candidates]
    heapq.heapify(heap)
    taken, total = Taken(), 0
    while heap:
        by, path, line, size, a, b, shift, x = heapq.heappop(heap)
        last = b - size - 1
        met = taken.next_of(a)
        if met is None or met[0] > last:
            taken.add(a, last)
            total -= by
        elif met[0] > a and (left := met[0] - b) >= x:
            heapq.heappush(heap, (-(left + shift), path, line, -left, a, b, shift, x))
    return total


def percentages(file_rows: DataFrame, min_lines: int = MIN_LINES, min_tokens: int = MIN_TOKENS, within_files: bool = False, **normalizer: bool) -> DataFrame:
    """duplication_percentage, of all files together (one row) or of each by itself (file_ord)."""
    rows = numbered(file_rows)
    _, _, parts, shape, _ = _found(_files(rows, **normalizer), min_lines, min_tokens, within_files)
    shown = _overlap(parts, shape, list(CLS)).join(shuffled(rows.select(F.col("file_ord").alias("first_file"), F.col("path").alias("first_path"))), "first_file")
    per_file = shown.select("file_ord", F.col("first_path"), "first_start", "shift", "x", "y", "a", "b")

    def fold(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            n = [duplicated_lines([tuple(x.values()) for x in own]) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["file_ord", "duplicated"])

    # a row a file, many to a batch: a file by itself costs a task more than its few pieces
    listed = per_file.groupBy("file_ord").agg(F.collect_list(F.struct(*per_file.columns[1:])).alias("own"))
    counted = listed.mapInArrow(fold, "file_ord long, duplicated long")
    sizes = rows.select("file_ord", F.size(lines_of(F.col("content"))).cast("long").alias("lines"))
    both = sizes.join(shuffled(counted), "file_ord", "left").withColumn("duplicated", F.coalesce("duplicated", F.lit(0)))
    share = lambda d, n: F.when(n > 0, d / n * 100.0).otherwise(0.0).alias("duplication_percentage")
    if within_files:
        return both.select("file_ord", share(F.col("duplicated"), F.col("lines")))
    return both.agg(F.coalesce(F.sum("duplicated"), F.lit(0)).alias("d"), F.coalesce(F.sum("lines"), F.lit(0)).alias("n")).select(share(F.col("d"), F.col("n")))
