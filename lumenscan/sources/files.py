"""Row producers: files, directories, lines, unified diffs, diff chunks and shell embedded in CI files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenscan.functions.paths import is_ci_path, matches_ignore
from lumenscan.functions.text import lines as lines_of
from lumenscan.functions.text import trimmed


def files(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(path, content) rows from memory."""
    return spark.createDataFrame(rows, "path string, content string")


def directory(spark: SparkSession, folder: str, max_files: int | None = None, ignored: tuple[str, ...] = (), ignore_paths: list[str] | None = None) -> DataFrame:
    """(path, content) of the regular files below a folder; content that is not UTF-8 reads as empty. Paths are judged when files are
    listed: what matches `ignored` (regular expressions) or `ignore_paths`, or comes after the first max_files paths in order (ignored
    ones count), is never opened. Files are put together into partitions by their bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    listed = F.col("_metadata.file_path")  # a filter on it alone is applied to the listing
    if max_files is not None:
        last = raw.select(listed.alias("path")).orderBy("path").limit(max_files).agg(F.max("path")).first()[0]
        raw = raw.filter(listed <= F.lit(last)) if last is not None and max_files > 0 else raw.limit(0)
    for p in ignored:
        raw = raw.filter(~listed.rlike(p))
    if ignore_paths:
        raw = raw.filter(~matches_ignore(listed, ignore_paths))
    content = F.when(F.is_valid_utf8(F.col("content")), F.col("content").cast("string")).otherwise("")
    return raw.select(F.regexp_replace("path", r"\Afile:/+", "/").alias("path"), content.alias("content"))


def numbered(file_rows: DataFrame) -> DataFrame:
    """Files with file_ord, their place in scan order: that of the rows."""
    return file_rows if "file_ord" in file_rows.columns else file_rows.withColumn("file_ord", F.monotonically_increasing_id())


def lines(file_rows: DataFrame) -> DataFrame:
    """file_ord, path, line_number (from 1), content of every line."""
    rows = numbered(file_rows).select("file_ord", "path", F.posexplode(lines_of(F.col("content"))).alias("pos", "line"))
    return rows.select("file_ord", "path", (F.col("pos") + 1).alias("line_number"), F.col("line").alias("content"))


# --- unified diffs ---


#: The new file's first line in a hunk's head, up to the first `+`.
HUNK_START = re.compile(r"[^+]*\+([0-9]+)(?=[,\t\n\x0b\f\r ]|\Z)")


def _hunk_start(raw: str) -> int:
    m = HUNK_START.match(raw)
    return int(m[1]) if m and int(m[1]) < 2**63 else 1


def _last(flags: np.ndarray) -> np.ndarray:
    """The last place up to each that is flagged, -1 before the first."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), -1))


def _begins(raw: pa.Array, text: str) -> np.ndarray:
    return np.asarray(pc.starts_with(raw, text).cast(pa.uint8())).view(bool)


def _placed(raw: pa.Array, first: np.ndarray, is_file: np.ndarray, context: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Lines of several diffs, one after the other (`first` flags each diff's first line, `is_file` the `diff --git` lines): the places of the
    lines asked for, each one's section and number, then the paths of the sections that name one and these sections.

    Sections are numbered over all the diffs. Running maxima tell each line the section and the hunk that are open."""
    is_path, is_hunk, is_context = _begins(raw, "+++ "), _begins(raw, "@@ "), _begins(raw, " ")
    added = _begins(raw, "+") & ~_begins(raw, "+++")
    step, wanted = added | is_context, added | is_context if context else added
    section, hunk = np.cumsum(is_file | first) - 1, _last(is_hunk)
    is_open = hunk >= _last(is_file | first)  # a new section closes the hunk
    hunks, steps = np.flatnonzero(is_hunk), np.cumsum(step)
    starts = np.ones(len(raw), np.int64)
    starts[hunks] = [_hunk_start(x) for x in raw.take(pa.array(hunks)).to_pylist()]
    at = np.flatnonzero(is_open & wanted)
    number = starts[hunk[at]] + (steps[at] - 1 - steps[hunk[at]])
    places = np.flatnonzero(is_path)
    paths = {int(section[i]): re.sub(r"\A(b/)+", "", x[4:]) for i, x in zip(places, raw.take(pa.array(places)).to_pylist(), strict=True) if x != "+++ /dev/null"}
    named = np.array(sorted(paths), np.int64)
    return at, section[at], number, [paths[s] for s in named.tolist()], named


def diff_lines(diffs: DataFrame, only_new_code: bool = True) -> DataFrame:
    """diffs: diff_id, diff. Added lines (and context lines unless only_new_code) with their file and line number:
    diff_id, file_ord, path, line_number, content; a file without such lines gives one row without line number.

    A diff is a row, so its lines never leave its task: many diffs' lines are classed and numbered at once, in arrays. A section (between
    `diff --git` lines) belongs to the path named last in it; sections that never name one pass their lines on to the next that does."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            raw, ends = batch.column(1).flatten(), np.asarray(batch.column(1).offsets).astype(np.int64)
            ends = ends - ends[0]
            if not len(raw):
                continue
            first, is_file, diff = np.zeros(len(raw), bool), _begins(raw, "diff --git "), np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            first[ends[:-1][np.diff(ends) > 0]] = True
            at, section, number, paths, named = _placed(raw, first, is_file, not only_new_code)
            of = diff[is_file | first]  # each section's diff, and its number in it
            before = np.concatenate([[0], np.cumsum(is_file)])
            file_ord = before[1:][is_file | first] - before[ends[:-1]][of]
            owner = np.searchsorted(named, section)
            known = owner < len(named)
            known[known] = of[named[owner[known]]] == of[section[known]]
            at, number, owner = at[known], number[known], owner[known]
            empty = np.setdiff1d(np.arange(len(named)), owner)
            every = named[np.concatenate([owner, empty])]
            none = np.arange(len(every)) >= len(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of[every])), pa.array(file_ord[every]), pa.array(paths, pa.string()).take(pa.array(np.concatenate([owner, empty]))),
                 pa.array(np.concatenate([number, np.zeros(len(empty), np.int64)]), mask=none), pa.concat_arrays([pc.utf8_slice_codeunits(raw.take(pa.array(at)), 1), pa.nulls(len(empty), raw.type)])],
                ["diff_id", "file_ord", "path", "line_number", "content"],
            )

    rows = diffs.select("diff_id", lines_of(F.col("diff")).alias("lines"))
    return rows.mapInArrow(run, f"diff_id {rows.schema['diff_id'].dataType.simpleString()}, file_ord long, path string, line_number long, content string")


def chunk_starts(sizes: np.ndarray, max_lines: int, max_bytes: int) -> np.ndarray:
    """The first line of each chunk, from the lines' byte lengths. The line that ends a chunk which starts at any given one is found by
    prefix sums; the chunks are then those that the first line leads to, by following the pointers in strides that double."""
    n = len(sizes)
    sums = np.concatenate([[0], np.cumsum(sizes.astype(np.int64) + 1)])
    at = np.arange(n)
    after = np.append(np.minimum(np.minimum(at + max_lines, n), np.maximum(at + 1, np.searchsorted(sums, sums[:n] + max_bytes) - 1)), n)
    found = np.zeros(1, np.int64)
    while n and found[-1] < n:
        found, after = np.unique(np.concatenate([found, after[found]])), after[after]
    return found[found < n]


def diff_chunks(diffs: DataFrame, max_lines: int = 200, max_chars: int = 4000) -> DataFrame:
    """diff_id, chunk (from 0), text: pieces of at most max_lines lines (50 at least) and about max_chars bytes (2,000 at least), greedily
    filled; blank diffs give none."""
    most, size = max(50, max_lines), max(2000, max_chars)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for k, own in enumerate(batch.column(1)):
                lines = own.values
                starts = chunk_starts(np.asarray(pc.binary_length(lines)), most, size).tolist()
                texts = ["\n".join([*lines[a:b].to_pylist(), ""]) for a, b in zip(starts, [*starts[1:], len(lines)], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(starts), pa.int32())), pa.array(range(len(starts)), pa.int32()), pa.array(texts, pa.string())], ["diff_id", "chunk", "text"])

    rows = diffs.filter(trimmed(F.col("diff")) != "").select("diff_id", lines_of(F.col("diff")).alias("lines"))
    return rows.mapInArrow(run, f"diff_id {rows.schema['diff_id'].dataType.simpleString()}, chunk int, text string")


# --- shell embedded in CI files ---

#: Keys whose value is shell, those that open a list of commands when alone on a line, and marks of a block.
SHELL_KEYS = ("run", "script", "before_script", "after_script", "bash", "inlineScript")
LIST_KEYS = ("script:", "before_script:", "after_script:")
BLOCK_MARKS = ("|", ">", "|-", ">-", "|+", ">+")


#: Lines of a file are looked through in blocks of so many for those that begin a part.
BLOCK_LINES = 10_000


def _in_parts(line_rows: DataFrame, begins: Column) -> DataFrame:
    """line_rows with `part`: the number of the last line of the file up to this one that begins a part, 0 before the first. Found in
    each block of lines by itself, then carried over the blocks of a file, so that no task has to see a whole file."""
    file = ["file_ord", "path"]
    rows = line_rows.withColumns({"block": F.floor(F.col("line_number") / BLOCK_LINES), "begins": F.when(begins, F.col("line_number").cast("long"))})
    in_block, before = Window.partitionBy(*file, "block").orderBy("line_number"), Window.partitionBy(*file).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("part", F.max("begins").over(in_block))
    carried = rows.groupBy(*file, "block").agg(F.max("begins").alias("last")).select(*file, "block", F.max("last").over(before).alias("carried"))
    return rows.join(carried, [*file, "block"]).withColumn("part", F.coalesce("part", "carried", F.lit(0).cast("long"))).drop("block", "begins", "carried")


def embedded_shell(line_rows: DataFrame) -> DataFrame:
    """Shell lines of CI files among lines (file_ord, path, line_number, content): same columns, content being the command.

    What a line is depends on the block or list that lines before it opened. A line without indent ends both, whatever they are, so a
    file is divided before each such line, and the lines of a part are folded in order."""
    ci = line_rows.filter(is_ci_path(F.col("path"))).filter("content is not null")
    ci = _in_parts(ci, ~F.col("content").rlike(r"(?U)\A(\s|\z)"))
    entry = F.struct("line_number", "content")
    per_part = ci.groupBy("file_ord", "path", "part").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    none = F.lit(None).cast("int")
    start = F.struct(none.alias("block"), none.alias("list"), F.array().cast("array<struct<line_number:bigint,content:string>>").alias("out"))

    def mapped(text: Column) -> Column:
        return F.regexp_extract(text, rf"(?s)\A\s*(?:{'|'.join(SHELL_KEYS)})\s*:(.*)\z", 1)

    def is_mapping(text: Column) -> Column:
        return text.rlike(rf"\A\s*(?:{'|'.join(SHELL_KEYS)})\s*:")

    def step(s: Column, line: Column) -> Column:
        content, number = line["content"], line["line_number"].cast("long")
        text = trimmed(content)
        indent = F.length(F.regexp_extract(content, r"(?U)\A(\s*)", 1))
        closes = lambda level: (text != "") & (indent <= level)
        in_block = s["block"].isNotNull() & ~closes(s["block"])
        block = F.when(in_block, s["block"])
        in_list = ~in_block & s["list"].isNotNull() & ~closes(s["list"])
        as_list = F.when(s["list"].isNotNull() & ~closes(s["list"]), s["list"])
        deep = s["block"] + 2
        inside = F.when(F.octet_length(content) > deep, F.substring(content, deep + 1, F.length(content))).otherwise(text)
        item = F.when(text.startswith("- "), trimmed(F.substring(text, 3, 2**31 - 1)))
        item_block = in_list & item.isin(*BLOCK_MARKS)
        bare = F.when(item.isNotNull() & is_mapping(item), item).otherwise(text)
        value = trimmed(mapped(bare))
        is_map = ~in_block & ~in_list & is_mapping(bare)
        map_block = is_map & value.isin(*BLOCK_MARKS)
        emitted = F.when(in_block, inside).when(in_list & item.isNotNull() & ~item_block & (item != ""), item).when(is_map & ~map_block & (value != ""), value)
        return F.struct(
            F.when(item_block | map_block, indent).otherwise(block).alias("block"),
            F.when(in_block, s["list"]).when(is_map & (value == "") & text.isin(*LIST_KEYS), indent).otherwise(as_list).alias("list"),
            F.when(emitted.isNotNull(), F.concat(s["out"], F.array(F.struct(number.alias("line_number"), emitted.alias("content"))))).otherwise(s["out"]).alias("out"),
        )

    folded = per_part.select("file_ord", "path", F.explode(F.aggregate("all", start, step, lambda s: s["out"])).alias("x"))
    return folded.select("file_ord", "path", "x.line_number", "x.content")
