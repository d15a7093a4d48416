"""What a query's work must not hang on as its tables grow: the number of splits, windows over whole diffs, a group a file."""

import math
import os
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenscan.functions import text as X
from lumenscan.operators import duplication, secrets
from lumenscan.plans import queries as core
from lumenscan.sources.files import diff_lines, files

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.exists(f"{DIR}/part.parquet"), reason="no tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@tables
@pytest.mark.parametrize("corpus", [core.code_files])
def test_small_columns_are_dealt_out(spark, corpus):
    """a table of a few bytes a row is one split, whatever is made of it."""
    rows = corpus(spark, DIR)
    n = spark.sparkContext.defaultParallelism
    assert rows.rdd.getNumPartitions() >= n
    assert sum(1 for k in rows.rdd.glom().map(len).collect() if k) >= n


def test_white_space_is_what_the_pattern_takes(spark):
    """trimming without a pattern takes the same characters."""
    rows = spark.createDataFrame([(chr(c) + "a" + chr(c),) for c in [*range(1, 0xD800), *range(0xE000, 0x11000)]], "t string")
    assert rows.filter(X.trimmed(F.col("t")) != F.regexp_replace("t", r"(?U)\A\s+|\s+\z", "")).count() == 0
    assert rows.filter(X.trimmed(F.col("t")) == "a").count() == len(X.WHITE_SPACE)


def test_files_are_folded_many_at_once(spark):
    """no group by itself for each file, and the same shares."""
    block = [f"some words of line {i} here" for i in range(12)]
    texts = ["\n".join([*block, *(f"x {k} {j}" for j in range(7)), *block]) for k in range(5)] + ["\n".join(block), ""]
    found = duplication.percentages(files(spark, [(f"f{i}", t) for i, t in enumerate(texts)]).withColumn("file_ord", F.substring("path", 2, 9).cast("long")), within_files=True)
    assert "FlatMapGroups" not in plan(found)
    assert {r[0]: round(r[1], 6) for r in found.collect()} == {**{i: round(2 * 12 / 31 * 100, 6) for i in range(5)}, 5: 0.0, 6: 0.0}


@tables
def test_entropy_lines_are_dealt_out(spark):
    """lines of customers in as many tasks as there are cores."""
    assert core.entropy_in_lines(spark, DIR).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_entropy_goes_through_a_text_once(spark):
    """the characters are split and sorted once, not once a different character; all of one kind need no stack."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcé😀ß+/=_-Z9\n", k=n)) for n in (0, 1, 20, 300)] + ["a" * 100_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.entropy(F.col("t")).alias("e"))
    assert plan(rows).count("split(") == 1
    for t, e in rows.collect():
        size = len(t.encode())
        assert math.isclose(e, -sum(n / size * math.log2(n / size) for n in Counter(t).values()) if t else 0.0, abs_tol=1e-9)
    found = secrets.high_entropy_tokens(spark.createDataFrame([(1, "x k7Rq2Zx9Lm4Vt8Bn3Wp6Hd5 TESTk7Rq2Zx9Lm4Vt8Bn3Wp6 aaaaaaaaaaaaaaaaaaaaaaaa")], "id int, content string"))
    assert [r["token"] for r in found.collect()] == ["k7Rq2Zx9Lm4Vt8Bn3Wp6Hd5"]


def test_diffs_are_read_where_they_are(spark):
    """no shuffle, window or sort of a diff's lines; several diffs in a batch do not run into each other."""
    one = "+lost\ndiff --git a/x b/x\n@@ -1 +5 @@\n a\n+b\ndiff --git a/y b/y\n+++ b/b/y\n@@ -1 +99999999999999999999 @@\n+c\n+++ no\n+d\n"
    rows = [(i, t) for i, t in enumerate([one, None, "", "@@ -1 +3 @@\n+no path\n", "diff --git a/z b/z\n+++ b/z\n", one, "+++ b/q\n@@ - +8, @@\n+e"])]
    found = diff_lines(spark.createDataFrame(rows, "diff_id long, diff string").coalesce(1))
    assert not any(x in plan(found) for x in ("Exchange", "Window", "Sort"))
    first = [("no", 2, 1, "c"), ("no", 2, 2, "d"), ("no", 2, 6, "b")]
    assert sorted((r["diff_id"], r["path"], r["file_ord"], r["line_number"], r["content"]) for r in found.filter("line_number IS NOT NULL").collect()) == [(0, *x) for x in first] + [(5, *x) for x in first] + [(6, "q", 0, 8, "e")]
    assert [(r["diff_id"], r["path"], r["file_ord"]) for r in found.filter("line_number IS NULL").collect()] == [(4, "z", 1)]


@tables
@pytest.mark.parametrize("query", [core.function_metrics, core.code_loc])
def test_files_are_measured_in_many_tasks(spark, query):
    """functions and lines of code of a table's files, in as many tasks as there are cores."""
    assert query(spark, DIR).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_copies_of_a_text_are_measured_once(spark):
    """files of a batch with the same text share a row of measures, also when a later batch has it; every file gets its own rows back."""
    from lumenscan.operators import metrics

    texts = ["def f(a):\n    return a\ndef g():\n    pass\n", "def h(x, y):\n    return x or y\n", "", None]
    names = ["file_ord", "path", "language", "content"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, (i, f"p{i}.py", "python", texts[i % 4]), strict=True)) for i in range(400)])
    sent = [x for b in metrics._spans(iter([batch, batch])) for x in b.to_pylist()]
    assert len(sent) == 6 and [len(x["at"]) for x in sent] == [100] * 6
    rows = [(f"p{i}.{x}", t) for x in ("py", "go") for i, t in enumerate(texts * 3)]
    found = metrics.functions(files(spark, rows).coalesce(1)).groupBy("path", "language").agg(F.sort_array(F.collect_list("name")).alias("names")).collect()
    wanted = {f"p{i}.py": names for i, names in enumerate([["f", "g"], ["h"], [], []] * 3) if names}
    assert {r["path"]: r["names"] for r in found if r["language"] == "python"} == wanted


def test_lines_are_counted_as_they_are_folded(spark):
    """the texts of short files are not made once more for a filter of their own; counts are those of a fold line by line."""
    from lumenscan.operators import metrics

    def fold(text):
        lines, opened, out = (re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", text)) if text else []), False, [0, 0, 0]
        for t in (x.strip() for x in lines):
            closes, single, quoted = "*/" in t, t.startswith(("//", "#")), t.startswith(("'''", '"""'))
            alone = single or quoted or t.startswith(("/*", "<!--", "=begin", "=end"))
            out[2 if not t else 1 if opened or alone else 0] += 1
            if opened:
                opened = not t or not closes
            elif t and not single:
                opened = not closes if t.startswith("/*") else "-->" not in t if t.startswith("<!--") else quoted or t.startswith("=begin")
        return (len(lines), *out)

    rng, parts = random.Random(5), ["x = 1", "", "  ", "// a", "# b", "/* c", "/* c */", "d */ e", "<!-- f", "<!-- f -->", "<!-- g */", "=begin", "=end", "'''", '"""doc"""', "/x", "<y", "=z", "'w'", "# */"]
    texts = ["\n".join(rng.choices(parts if i % 2 else parts[:5], k=rng.randrange(12))) for i in range(400)] + [None]
    rows = files(spark, [(f"f{i}", t) for i, t in enumerate(texts)])
    found = metrics.file_loc(rows, long_file=60).collect()
    assert {r["path"]: tuple(r[2:]) for r in found} == {f"f{i}": fold(t or "") for i, t in enumerate(texts)}
    made = spark.range(9).selectExpr("id AS file_ord", "'p' AS path", "repeat(concat('a', chr(10)), cast(id AS int)) AS content")
    shown = metrics.file_loc(made)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    short = [x for x in shown if x.startswith(":")]  # the first part of the union
    assert any("Generate explode" in x for x in short) and not any("- Filter" in x for x in short)


def test_a_function_is_gone_through_few_times(spark):
    """a keyword or operator is counted in all lines at once, in the whole text."""
    from lumenscan.functions.complexity import cyclomatic

    rows = spark.createDataFrame([(["if a && b {", "} else if x", "iffy &", "& If"], "go")], "lines array<string>, language string")
    found = rows.select(cyclomatic(F.col("lines"), F.col("language")).alias("n"))
    assert found.first()["n"] == 1 + 3 + 1 + 1
    assert plan(rows.select(cyclomatic(F.col("lines"), F.lit("go")).alias("n"))).count("transform(") == 0


@tables
@pytest.mark.parametrize("query", [core.rule_metadata, core.iac_file_issues])
def test_generated_rows_are_not_sorted_in_one_task(spark, query):
    """rows made of a table's keys are dealt out before they are made, and sorted, in tasks."""
    assert "RoundRobinPartitioning" in plan(query(spark, DIR))


@tables
def test_lines_of_orders_are_dealt_out(spark):
    """lines of code in as many tasks as there are cores, and a path's language found once a line."""
    from lumenscan.catalog.loader import RuleBundle
    from lumenscan.operators.sast import file_language

    assert "RoundRobinPartitioning" in plan(core.code_issues_ranked(spark, DIR))
    rows = spark.createDataFrame([("a/b.py",), ("x/Dockerfile",), ("n",), ("",), (None,)], "path string")
    found = rows.select(file_language(F.col("path"), RuleBundle()).alias("language"))
    assert plan(found).count("regexp_extract(") == 1
    assert found.first()["language"] == "python"


def test_blocks_of_many_files_come_in_one_batch(spark):
    """F7, F8: the shortest blocks of a batch of files are found at once, not a batch of Arrow for each file."""
    rows = [(f"f{i}", "\n".join(f"many words {j % 4} of a line" for j in range(n))) for i, n in enumerate((14, 0, 3, 12, 40))]
    measured = duplication._measured(duplication._files(files(spark, rows).withColumn("file_ord", F.substring("path", 2, 9).cast("long")).coalesce(1)))
    seeds = duplication._seeds(measured, 10, 50, False)
    batches = seeds.mapInArrow(lambda source: (b.select([0]).slice(0, 1) for b in source), "file_ord long")
    assert batches.count() == 1
    assert Counter(r["file_ord"] for r in seeds.collect()) == {0: 2, 4: 28}  # four tokens a line, so 13 lines


def test_stretches_are_compared_in_many_tasks(spark):
    """F7, F8: pairs of stretches are a few bytes and cost some time each; put together by their bytes they were one task's work."""
    block = [f"some words of line {i} here" for i in range(12)]
    rows = files(spark, [(f"f{i}", "\n".join([f"x {i}", *block, f"y {i}"])) for i in range(64)])
    measured = duplication._measured(duplication._files(rows))
    seeds = duplication._classed(duplication._seeds(measured, 10, 50, False), "key").withColumn("stretch", F.lit(1))
    stretches = duplication._stretches(seeds, measured, 10, 50)
    compared = duplication._compared(seeds, stretches)
    assert sum(1 for n in compared.rdd.glom().map(len).collect() if n) == spark.sparkContext.defaultParallelism


def test_blocks_are_joined_without_the_driver(spark, monkeypatch):
    """files that a rule makes of a few bytes a row count as next to nothing, yet the driver must not put their lines together."""
    shown, cut = [], duplication.cut
    monkeypatch.setattr(duplication, "cut", lambda df: shown.append(plan(df)) or cut(df))
    block = "transform(sequence(1, 12), i -> concat('some words of line ', i, ' here'))"
    rows = spark.range(64).selectExpr("id AS file_ord", "concat('f', id) AS path", f"concat('x ', id, chr(10), array_join({block}, chr(10)), chr(10), 'y ', id, chr(10), if(id < 32, array_join({block}, chr(10)), '')) AS content")
    once = duplication._found(duplication._files(rows), 10, 50, False)
    monkeypatch.setattr(duplication, "_found", lambda *a: once)
    found = duplication.instances(rows).select("file_ord", "line_start", "line_end")
    shares, counts = duplication.percentages(rows), duplication.group_counts(rows)
    shown += map(plan, (found, shares, counts))
    assert sum("SortMergeJoin" in x for x in shown) > 7 and not any("Broadcast" in x for x in shown)
    wanted = [(i, 2 + a, (15 if i < 32 else 2) + b) for i in range(64) for a in range(12) for b in range(a + 9, 12)]  # copies in a file are merged
    assert sorted(map(tuple, found.collect())) == wanted
