"""Code metrics: lines of code, metrics of functions and files, alerts."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.functions.complexity import cognitive, cyclomatic, stripped_lines
from lumenscan.functions.paths import is_traversal, metrics_language
from lumenscan.functions.text import lines as lines_of
from lumenscan.functions.text import trimmed
from lumenscan.operators import duplication
from lumenscan.sources.files import numbered


#: Files of more bytes are counted in blocks of so many lines, by several tasks.
LONG_FILE, BLOCK_LINES = 4 << 20, 10_000


#: What a trimmed line is by itself, as bits: it is blank; is a comment where none is open; leaves a block open if none was before it; and if
#: one was.
BLANK, ALONE, OPENS, STAYS = 1, 2, 4, 8


def _kind(t: Column) -> Column:
    """The bits of a trimmed line. Most lines begin with none of the characters that a mark begins with."""
    mark = lambda *xs: functools.reduce(operator.or_, (t.startswith(x) for x in xs))
    stays = F.when(F.contains(t, F.lit("*/")), 0).otherwise(STAYS)
    slashed = F.when(F.contains(t, F.lit("*/")), ALONE).otherwise(ALONE | OPENS | STAYS)
    angled = F.when(F.contains(t, F.lit("-->")), ALONE).otherwise(ALONE | OPENS) + stays
    marked = F.when(mark("//", "#", "=end"), ALONE + stays).when(mark("/*"), slashed).when(mark("<!--"), angled).when(mark("=begin", "'''", '"""'), (ALONE | OPENS) + stays).otherwise(stays)
    return F.when(t == "", BLANK | STAYS).when(F.ascii(t).isin(*map(ord, "/#=<'\"")), marked).otherwise(stays)


def _folded(all_lines: Column, is_open: bool) -> Column:
    """struct<open, code, comment, blank>: what lines come to, and whether a comment block is open behind them, if one is open or not
    before them. Only `*/` (or a quote line) closes a block, so lines are folded in order, but where no block is ever open they are counted."""
    start = F.struct(F.lit(is_open).alias("open"), *[F.lit(0).cast("long").alias(n) for n in ("code", "comment", "blank")])
    has = lambda x, bit: x.bitwiseAND(F.lit(bit)) != 0

    def step(s: Column, x: Column) -> Column:
        blank = has(x, BLANK)
        comment = ~blank & (s["open"] | has(x, ALONE))
        return F.struct(
            F.when(s["open"], has(x, STAYS)).otherwise(has(x, OPENS)).alias("open"), (s["code"] + (~blank & ~comment).cast("long")).alias("code"), (s["comment"] + comment.cast("long")).alias("comment"), (s["blank"] + blank.cast("long")).alias("blank")
        )

    def counted(kinds: Column) -> Column:
        blank, comment = F.size(F.filter(kinds, lambda x: has(x, BLANK))).cast("long"), F.size(F.filter(kinds, lambda x: has(x, ALONE))).cast("long")
        return F.struct(F.lit(False).alias("open"), (F.size(kinds) - blank - comment).alias("code"), comment.alias("comment"), blank.alias("blank"))

    fold = lambda kinds: F.aggregate(kinds, start, step)
    kinds = F.transform(F.transform(all_lines, trimmed), _kind)
    if is_open:
        return fold(kinds)
    return F.transform(F.array(kinds), lambda k: F.when(F.exists(k, lambda x: has(x, OPENS)), fold(k)).otherwise(counted(k)))[0]


def loc(text: Column) -> Column:
    """struct<total_lines, code_lines, comment_lines, blank_lines>, whatever the language."""
    named = lambda s: F.struct((s["code"] + s["comment"] + s["blank"]).alias("total_lines"), s["code"].alias("code_lines"), s["comment"].alias("comment_lines"), s["blank"].alias("blank_lines"))
    return F.transform(F.array(_folded(lines_of(text), False)), named)[0]


def long_file_loc(file_rows: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """file_ord, path, loc columns of files of any length. A block of lines is a function of whether a comment is open before it: it is
    folded for both cases, wherever its lines are sent, and a file's few blocks are then composed in order."""
    rows = numbered(file_rows)
    line = rows.select("file_ord", F.posexplode(lines_of(F.col("content"))).alias("pos", "line")).withColumn("block", F.floor(F.col("pos") / block_lines))
    blocks = line.groupBy("file_ord", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"))
    both = blocks.select("file_ord", F.struct("block", F.size("lines").cast("long").alias("n"), _folded(F.col("lines"), False).alias("shut"), _folded(F.col("lines"), True).alias("open")).alias("x"))
    zero = F.struct(F.lit(False).alias("open"), *[F.lit(0).cast("long").alias(n) for n in ("total", "code", "comment", "blank")])

    def after(s: Column, x: Column) -> Column:
        own = F.when(s["open"], x["open"]).otherwise(x["shut"])
        return F.struct(own["open"].alias("open"), (s["total"] + x["n"]).alias("total"), *[(s[n] + own[n]).alias(n) for n in ("code", "comment", "blank")])

    folded = both.groupBy("file_ord").agg(F.aggregate(F.array_sort(F.collect_list("x")), zero, after).alias("s"))
    counts = [F.coalesce(F.col(f"s.{n}"), F.lit(0).cast("long")).alias(f"{n}_lines") for n in ("total", "code", "comment", "blank")]
    return rows.select("file_ord", "path").join(folded, "file_ord", "left").select("file_ord", "path", *counts)


def total_lines(text: Column) -> Column:
    return F.size(lines_of(text)).cast("long")


def code_lines(text: Column) -> Column:
    return loc(text)["code_lines"]


def file_loc(file_rows: DataFrame, long_file: int = LONG_FILE) -> DataFrame:
    """file_ord, path, loc columns: files as they come where they are, those of more than long_file bytes in blocks. Short ones are told
    apart where they are counted: a filter would be moved before the texts are made, and make them for itself."""
    rows = numbered(file_rows)
    is_long = F.octet_length("content") > long_file
    own = F.filter(F.array("content"), lambda x: F.coalesce(F.octet_length(x) <= long_file, F.lit(True)))
    short = rows.select("file_ord", "path", F.explode(F.transform(own, loc)).alias("x")).select("file_ord", "path", "x.*")
    return short.unionByName(long_file_loc(rows.filter(is_long)))


def pr_size(total_lines: Column) -> Column:
    return F.when(total_lines <= 50, "XS").when(total_lines <= 200, "Small").when(total_lines <= 400, "Medium").when(total_lines <= 1000, "Large").otherwise("XL")


def halstead(operators: Column, operands: Column, unique_operators: Column, unique_operands: Column) -> list[Column]:
    """The derived measures, as named columns; time_minutes is the effort over 18."""
    vocabulary, length = unique_operators + unique_operands, operators + operands
    volume = F.when(vocabulary > 0, length * F.log2(vocabulary)).otherwise(0.0)
    difficulty = F.when(unique_operands > 0, unique_operators / 2.0 * (operands / unique_operands)).otherwise(0.0)
    effort = volume * difficulty
    named = {"vocabulary": vocabulary.cast("long"), "program_length": length.cast("long"), "volume": volume, "difficulty": difficulty, "effort": effort, "time_minutes": effort / 18.0, "bugs_estimate": volume / 3000.0}
    return [c.alias(n) for n, c in named.items()]


#: A function of a text, and the files whose text that is.
SPAN_DDL = (
    "language string, function_ord int, name string, line_start int, line_end int, length int, parameter_count int, parameters array<string>, "
    "operators long, operands long, unique_operators long, unique_operands long, body string, at array<struct<file_ord: long, path: string>>"
)
_SPAN_TYPES = [
    pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
    pa.list_(pa.struct([("file_ord", pa.int64()), ("path", pa.string())])),
]
_SPAN_SCHEMA = pa.schema([(x.split()[0], t) for x, t in zip(SPAN_DDL.split(", ", len(_SPAN_TYPES) - 1), _SPAN_TYPES, strict=True)])
#: A task remembers the functions of texts of so many characters together, and sends so many rows (of functions and files) at once.
REMEMBERED, SENT_ROWS = 8 << 20, 20_000


def _spans(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file_ord, path, language, content: each text of a batch once, whatever files have it; those met before are not parsed again."""
    from lumenscan.functions.halstead import counts
    from lumenscan.functions.spans import spans

    known: dict[tuple[str, str], list[tuple]] = {}
    held = 0
    for batch in source:
        at: dict[tuple[str, str], list[dict]] = {}
        for ord_, path, language, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at.setdefault((language, content or ""), []).append({"file_ord": ord_, "path": path})
        rows, n = [], 0
        for key, files in at.items():
            if key not in known:
                if held > REMEMBERED:
                    known, held = {}, 0
                language, content = key
                known[key] = [(language, i, s.name, s.start, s.end, s.end - s.start + 1, len(s.parameters), s.parameters, *counts(s.body, language), s.body) for i, s in enumerate(spans(content, language))]
                held += 100 + len(content)
            for own in known[key]:
                rows.append((*own, files))
                n += len(files)
                if n >= SENT_ROWS:
                    yield _span_batch(rows)
                    rows, n = [], 0
        if rows:
            yield _span_batch(rows)


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SPAN_SCHEMA, strict=True)], schema=_SPAN_SCHEMA)


def functions(file_rows: DataFrame) -> DataFrame:
    """A row for each function of each file with its complexity and Halstead measures. Where a function ends depends on a scan ahead, and
    which symbol comes next on the one before, so both run as batches of files in Python; all else are expressions. Measures are those of a
    text: copies of it that meet in a batch are measured once."""
    rows = numbered(file_rows).select("file_ord", "path", metrics_language(F.col("path")).alias("language"), "content")
    found = rows.mapInArrow(_spans, SPAN_DDL).withColumn("lines", stripped_lines(F.col("body"))).drop("body")
    found = found.withColumns({"cyclomatic": cyclomatic(F.col("lines"), F.col("language")), "cognitive": cognitive(F.col("lines"), F.col("language"))})
    measured = found.select(
        "language", "function_ord", "name", "line_start", "line_end", "length", F.col("cyclomatic").alias("cyclomatic_complexity"), F.col("cognitive.total").alias("cognitive_complexity"),
        F.col("cognitive.deepest").alias("max_nesting_depth"), "parameter_count", "parameters", "operators", "operands", "unique_operators", "unique_operands",
        *halstead(*(F.col(c) for c in ("operators", "operands", "unique_operators", "unique_operands"))), "at",
    )
    return measured.select("*", F.explode("at").alias("file")).select("file.file_ord", "file.path", *[c for c in measured.columns if c != "at"])


def files(file_rows: DataFrame) -> DataFrame:
    """file_ord, file_path, language, lines, loc columns, n_functions, average_complexity, duplication_percentage (within the file)."""
    rows = numbered(file_rows)
    rows = rows.filter(~is_traversal(F.col("path")))
    per_function = functions(rows).groupBy("file_ord").agg(F.count("*").alias("n_functions"), F.avg("cyclomatic_complexity").alias("average_complexity"))
    own = duplication.percentages(rows, within_files=True)
    out = file_loc(rows).withColumn("language", metrics_language(F.col("path"))).join(per_function, "file_ord", "left").join(own, "file_ord", "left")
    return out.select(
        "file_ord", F.col("path").alias("file_path"), "language", F.col("total_lines").alias("lines"), "total_lines", "code_lines", "comment_lines", "blank_lines", F.coalesce("n_functions", F.lit(0)).alias("n_functions"),
        F.coalesce("average_complexity", F.lit(0.0)).alias("average_complexity"), F.coalesce("duplication_percentage", F.lit(0.0)).alias("duplication_percentage"),
    )


@dataclass
class Thresholds:
    pr_size: tuple[float, float] = (400, 1000)
    files_changed: tuple[float, float] = (10, 20)
    cyclomatic: tuple[float, float] = (10, 20)
    cognitive: tuple[float, float] = (15, 25)
    function_length: tuple[float, float] = (50, 100)
    file_length: tuple[float, float] = (300, 500)
    nesting_depth: tuple[float, float] = (4, 6)
    duplication: tuple[float, float] = (5.0, 10.0)


#: Complexity bases of languages (cyclomatic, cognitive, function length).
LANGUAGE_BASES = {"rust": (10, 15, 50), "go": (15, 20, 60), "python": (10, 15, 40), "java": (10, 15, 50), "dotnet": (10, 15, 50), "typescript": (10, 15, 40)}
DEFAULT_BASES = (10, 15, 50)

#: Alert kind, threshold, and how its message starts at error and at warning; {v} is the value, {f} the function.
ALERTS = (
    ("PR_SIZE", "pr_size", "PR size ({v} lines)", "PR size ({v} lines)"),
    ("FILES_CHANGED", "files_changed", "Too many files changed ({v})", "Many files changed ({v})"),
    ("DUPLICATION", "duplication", "Code duplication ({v}%)", "Code duplication ({v}%)"),
    ("FILE_LENGTH", "file_length", "File too long ({v} lines)", "File is long ({v} lines)"),
    ("CYCLOMATIC_COMPLEXITY", "cyclomatic", "High cyclomatic complexity ({v}) in '{f}'", "Elevated cyclomatic complexity ({v}) in '{f}'"),
    ("COGNITIVE_COMPLEXITY", "cognitive", "High cognitive complexity ({v}) in '{f}'", "Elevated cognitive complexity ({v}) in '{f}'"),
    ("FUNCTION_LENGTH", "function_length", "Function too long ({v} lines) in '{f}'", "Function is long ({v} lines) in '{f}'"),
    ("NESTING_DEPTH", "nesting_depth", "Deep nesting ({v} levels) in '{f}'", "Deep nesting ({v} levels) in '{f}'"),
)


def alerts(measures: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """measures: metric_type, file_path, function_name, line_number, value (double). Values above a threshold, errors before warnings,
    then by path; a threshold must be exceeded, and an error stands for the warning too."""
    thresholds = thresholds or Thresholds()
    spark = measures.sparkSession
    rows = [(i, kind, *map(float, getattr(thresholds, name)), error, warning) for i, (kind, name, error, warning) in enumerate(ALERTS)]
    table = F.broadcast(spark.createDataFrame(rows, "kind_ord int, metric_type string, warning_at double, error_at double, error_says string, warning_says string"))
    found = measures.join(table, "metric_type").filter(F.col("value") > F.least("warning_at", "error_at"))
    is_error, share = F.col("value") > F.col("error_at"), F.col("metric_type") == "DUPLICATION"
    found = found.filter(is_error | (F.col("value") > F.col("warning_at")))
    at = F.when(is_error, F.col("error_at")).otherwise(F.col("warning_at"))
    shown = lambda c: F.when(share, F.format_string("%.1f", c)).otherwise(c.cast("long").cast("string"))
    says = F.replace(F.replace(F.when(is_error, F.col("error_says")).otherwise(F.col("warning_says")), F.lit("{v}"), shown(F.col("value"))), F.lit("{f}"), F.coalesce("function_name", F.lit("")))
    message = F.concat(says, F.lit(" exceeds "), F.when(is_error, "error").otherwise("warning"), F.lit(" threshold ("), shown(at), F.when(share, "%)").otherwise(")"))
    found = found.withColumn("level", F.when(is_error, "error").otherwise("warning"))
    out = found.select("metric_type", "level", "file_path", "function_name", "line_number", F.col("value").cast("int").alias("current_value"), at.cast("int").alias("threshold"), message.alias("message"), "kind_ord")
    return out.orderBy("level", "file_path", "kind_ord", "line_number").drop("kind_ord")


def measures_of(file_metrics: DataFrame, function_metrics: DataFrame) -> DataFrame:
    """What alerts() takes, from files() and functions()."""
    per_file = file_metrics.select(F.lit("FILE_LENGTH").alias("metric_type"), "file_path", F.lit(None).cast("string").alias("function_name"), F.lit(None).cast("int").alias("line_number"), F.col("lines").cast("double").alias("value"))
    kinds = {"CYCLOMATIC_COMPLEXITY": "cyclomatic_complexity", "COGNITIVE_COMPLEXITY": "cognitive_complexity", "FUNCTION_LENGTH": "length", "NESTING_DEPTH": "max_nesting_depth"}
    pairs = ", ".join(f"'{k}', cast({c} as double)" for k, c in kinds.items())
    per_function = function_metrics.select(F.expr(f"stack({len(kinds)}, {pairs}) as (metric_type, value)"), F.col("path").alias("file_path"), F.col("name").alias("function_name"), F.col("line_start").alias("line_number"))
    return per_file.unionByName(per_function.select(*per_file.columns))


def change_measures(file_rows: DataFrame, lines_added: int, lines_removed: int, duplication_percentage: DataFrame) -> DataFrame:
    """PR_SIZE, FILES_CHANGED and DUPLICATION of a change."""
    one = file_rows.agg(F.count("*").cast("double").alias("n")).crossJoin(duplication_percentage.select("duplication_percentage"))  # two single rows
    row = one.select(F.expr(f"stack(3, 'PR_SIZE', cast({lines_added + lines_removed} as double), 'FILES_CHANGED', n, 'DUPLICATION', duplication_percentage) as (metric_type, value)"))
    return row.select("metric_type", F.lit("").alias("file_path"), F.lit(None).cast("string").alias("function_name"), F.lit(None).cast("int").alias("line_number"), "value")


def summary(file_rows: DataFrame, lines_added: int, lines_removed: int) -> DataFrame:
    """One row for a change: sizes, maxima and means over functions and files (null without any), duplication across files."""
    rows = numbered(file_rows)
    kept = rows.filter(~is_traversal(F.col("path")))
    f = functions(kept).agg(
        F.max("cyclomatic_complexity").alias("max_cyclomatic_complexity"), F.avg("cyclomatic_complexity").alias("avg_cyclomatic_complexity"), F.max("cognitive_complexity").alias("max_cognitive_complexity"),
        F.avg("cognitive_complexity").alias("avg_cognitive_complexity"), F.max("length").alias("max_function_length"), F.avg("length").alias("avg_function_length"), F.max("max_nesting_depth").alias("max_nesting_depth"),
    )
    size = F.size(lines_of(F.col("content")))
    g = kept.agg(F.max(size).alias("max_file_length"), F.avg(size).alias("avg_file_length"))
    h = rows.agg(F.count("*").alias("total_files_changed"))
    total = F.lit(lines_added + lines_removed)
    head = h.select(F.lit(lines_added).alias("total_lines_added"), F.lit(lines_removed).alias("total_lines_removed"), "total_files_changed", pr_size(total).alias("pr_size_category"))
    return head.crossJoin(f).crossJoin(g).crossJoin(duplication.percentages(rows).select("duplication_percentage"))  # single rows
