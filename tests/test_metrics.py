"""Lines of code, functions, complexity, Halstead, duplication, alerts, detection."""

import math
import random

import pytest
from brute_complexity import complexity
from pyspark.sql import functions as F

from lumenscan.functions.comments import without_inline_comment
from lumenscan.functions import complexity as C
from lumenscan.functions.halstead import counts
from lumenscan.functions.spans import in_range, spans
from lumenscan.operators import detect, duplication, metrics
from lumenscan.sources.files import files


def _loc(spark, text):
    r = metrics.file_loc(files(spark, [("a", text)])).first()
    assert r["code_lines"] + r["comment_lines"] + r["blank_lines"] == r["total_lines"]
    return r["total_lines"], r["code_lines"], r["comment_lines"], r["blank_lines"]


@pytest.mark.parametrize(("text", "expected"), [
    ("fn main() {\n    x();\n}\n", (3, 3, 0, 0)), ("a\n\nb\n\nc\n", (5, 3, 0, 2)), ("// a\n# b\nc // d\n", (3, 1, 2, 0)), ("/* a\n b\n*/ c\nd\n", (4, 1, 3, 0)), ('"""doc"""\nx = 1\n\n', (3, 0, 2, 1)), ("", (0, 0, 0, 0)),
    ("<!-- a\nb */\nc\n", (3, 1, 2, 0)), ("=begin\n=end\nx\n", (3, 0, 3, 0)), ("/* a */\nb\n", (2, 1, 1, 0)),
])
def test_loc(spark, text, expected):
    assert _loc(spark, text) == expected


@pytest.mark.parametrize(("line", "code"), [("a = 1 // b", "a = 1 "), ("x # y", "x "), ("s = \"a // b\" # c", "s = \"a // b\" "), ("u = 'it\\'s # no' / 2", "u = 'it\\'s # no' / 2"), ("q = `open # ", "q = `open # "), ("#", ""), ("", "")])
def test_inline_comments(line, code):
    assert without_inline_comment(line) == code


def test_line_helpers(spark):
    r = spark.createDataFrame([("a\n// b\n\n",)], "t string").select(metrics.total_lines(F.col("t")).alias("n"), metrics.code_lines(F.col("t")).alias("c")).first()
    assert (r["n"], r["c"]) == (3, 1)


SPANS = [
    ("python", "@dec\nasync def f(a, b=1, *c):\n    return a\n\nclass X:\n    def g(self): pass\n", [("f", 1, 3, ["a", "b"]), ("g", 6, 6, ["self"])]),
    ("rust", "// fn no()\npub async fn add<T>(mut a: T, &self, b: Vec<(u8, u8)>) {\n  let s = \"}\"; // }\n}\ntrait T {\n    fn t(&self);\n}\n", [("add", 2, 4, ["a", "b"]), ("t", 6, 6, [])]),
    ("go", "func (s *Srv) Do(a, b int, c string) error {\n  return nil\n}\n", [("Srv.Do", 1, 3, ["a", "b", "c"])]),
    ("typescript", "export const f = (a: number, b = 2) => {\n return a;\n};\nconst g = (x) =>\n  x + 1;\n", [("f", 1, 3, ["a", "b"]), ("g", 4, 5, ["x"])]),
    ("typescript", "function plain(a, ...b) {\n}\nif (x) {\n}\n", [("plain", 1, 2, ["a", "b"])]),
    ("java", "public class A {\n  public A(int x) {\n  }\n  public static int f(Map<K, V> a, int b) throws E {\n return 1;\n }\n}", [("A", 2, 3, ["x"]), ("f", 4, 6, ["a", "b"])]),
    ("dotnet", "class A {\n public A(int x)\n {\n }\n public int F(int? a, out int b) {\n }\n public int G();\n}", [("A", 2, 4, ["x"]), ("F", 5, 6, ["a", "b"])]),
    ("cpp", "int add(int a,\n  const char *b)\n{\n return a;\n}\nint x = f(1);\n", [("add", 1, 5, ["a", "b"])]),
    ("php", "public function go(string $a, $b = 1) {\n}\n", [("go", 1, 2, ["a", "b"])]),
    ("kotlin", "fun <T> List<T>.go(a: Int, vararg b: String): Int {\n return 1\n}\n", [("go", 1, 3, ["a", "b"])]),
    ("ruby", "def go(a, b: 1, *c, &d)\n  a\nend\ndef self.x?\n y\nend\n", [("go", 1, 2, ["a", "b", "c", "d"]), ("x?", 4, 5, [])]),
]


@pytest.mark.parametrize(("language", "text", "expected"), SPANS)
def test_spans(language, text, expected):
    found = spans(text, language)
    assert [(s.name, s.start, s.end, s.parameters) for s in found] == expected
    assert in_range(found, 1, 10**6) == found and in_range(found, 10**6, 10**7) == []


def test_complexity():
    assert complexity("fn f() {\n    x();\n}", "rust") == (1, 0, 0)
    cyclomatic, cognitive, nesting = complexity("fn f() {\n    if a {\n        if b && c {\n        }\n    }\n}", "rust")
    assert cyclomatic == 4 and nesting == 2 and cognitive == 2
    assert complexity("fn f(x: u8) -> u8 {\n    match x {\n        1 => 2,\n        _ => 3,\n    }\n}", "rust")[0] == 3
    assert complexity("def f():\n    for x in y:\n        pass", "python")[0] == 3  # `for` holds `or`
    assert complexity("// if\nx", "go")[0] == 2 and complexity("x // if", "go")[0] == 1  # only on the last line


def test_complexity_columns(spark):
    """The Column expressions against the same measures line by line, over code of all languages and lines put together at random."""
    rng = random.Random(4)
    bits = [
        "if (a && b) {", "} else if (c) {", "else if x", "}", "{", "match v {", "  1 => 2,", "  _ => { f(); }", "// => no", "switch (x) {", "case 1:", "  default: y ?? z?.w", "select {", "for x in y:", "while (a || b) {", "do {", "  doubled = 1",
        'x = "if { \\" } for"', "y = 'case'", "z = `match {`", "/* if { */ while", "# for", "catch (e) {", "except E:", "elsif x unless y", "Ünïf", "\t  return a ? b : c;", "", "If IF iffy", "loop { break; }", "end }}", 'open "string', "// last",
    ]
    rows = [(language, text) for language, text, _ in SPANS] + [(language, "\n".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))) for language in (*C.KEYWORDS, "cpp", "kotlin") for _ in range(40)] + [("go", ""), ("rust", '"' + "a" * 200_000 + '"')]
    found = spark.createDataFrame(rows, "language string, text string").withColumn("lines", C.stripped_lines(F.col("text")))
    found = found.select("language", "text", C.cyclomatic(F.col("lines"), F.col("language")).alias("c"), C.cognitive(F.col("lines"), F.col("language")).alias("g"))
    for r in found.collect():
        assert (r["c"], r["g"]["total"], r["g"]["deepest"]) == complexity(r["text"], r["language"]), r


def test_halstead(spark):
    assert counts("a == b", "go") == (2, 2, 1, 2)
    assert counts("x = 1_000", "go") == (1, 3, 1, 3)
    assert counts("fn f() { let x = \"a\"; }", "rust")[0] >= 4
    row = spark.range(1).select(*metrics.halstead(*(F.lit(n) for n in (4, 6, 2, 3)))).first()
    assert row["vocabulary"] == 5 and row["program_length"] == 10 and row["volume"] == pytest.approx(10 * math.log2(5))
    assert row["difficulty"] == pytest.approx(2.0) and row["time_minutes"] == pytest.approx(row["effort"] / 18)
    assert spark.range(1).select(*metrics.halstead(*(F.lit(0) for _ in range(4)))).first()["volume"] == 0


BLOCK = "".join(f"let value_{i} = compute({i}) + other({i});\n" for i in range(11))


def test_duplication(spark):
    rows = files(spark, [("a.rs", BLOCK), ("b.rs", "x\n" + BLOCK.replace(" = ", "  =  "))])
    found = duplication.groups(rows, 3, 10).collect()
    top = found[0]
    assert top["line_count"] == 11 and [(i["file_path"], i["line_start"], i["line_end"]) for i in top["instances"]] == [("a.rs", 1, 11), ("b.rs", 2, 12)]
    assert duplication.percentages(rows, 3, 10).first()[0] == pytest.approx(22 / 23 * 100)
    assert duplication.percentages(files(spark, [("a.rs", "x\ny\n")])).first()[0] == 0.0
    assert duplication.percentages(files(spark, [("a", "")])).first()[0] == 0.0


def test_duplication_of_renamed_code(spark):
    """Files that differ in names only are duplicates if identifiers are ignored; white space counts if it is not."""
    rows = files(spark, [("a.rs", BLOCK), ("b.rs", BLOCK.replace("value", "other_name").replace("compute", "work")), ("c.rs", BLOCK.replace(" = ", "  = "))])
    pairs = lambda **options: {tuple(i["file_path"] for i in g["instances"]) for g in duplication.groups(rows, 11, 10, **options).collect()}
    assert pairs() == {("a.rs", "c.rs")} and pairs(ignore_identifiers=True) == {("a.rs", "b.rs", "c.rs")}
    assert pairs(ignore_whitespace=False) == set()
    assert duplication.renamed_identifiers("let foo = bar(foo, 1);") == "let $_1 = $_2($_1, 1);"


def test_duplication_against_all_windows(spark):
    """Every window, normalized and grouped, as the definition has it."""
    texts = {"a": "q\n" + BLOCK + "z\n", "b": BLOCK + BLOCK, "c": "one two\n" * 30}
    least, tokens = 4, 12
    groups = {}
    for path, text in texts.items():
        lines = text.splitlines()
        for i in range(len(lines) - least + 1):
            for j in range(i + least, len(lines) + 1):
                block = [" ".join(x.split()) for x in lines[i:j]]
                if sum(len(t) > 1 for x in block for t in x.split()) >= tokens:
                    groups.setdefault("\n".join(block), {}).setdefault(path, []).append([i + 1, j])
    expected = set()
    for key, per_file in groups.items():
        merged = []
        for path, spans_ in per_file.items():
            out = []
            for a, b in sorted(spans_):
                if out and a <= out[-1][1] + 5 and b > out[-1][1]:
                    out[-1][1] = b
                else:
                    out.append([a, b])
            merged += [(path, a, b) for a, b in out]
        if len(merged) > 1:
            expected.add(tuple(merged))
    found = duplication.groups(files(spark, list(texts.items())), least, tokens).collect()
    assert {tuple((i["file_path"], i["line_start"], i["line_end"]) for i in r["instances"]) for r in found} == expected


def test_identifiers():
    assert duplication.renamed_identifiers("let foo = bar(foo)") == "let $_1 = $_2($_1)"


def test_alerts(spark):
    rows = spark.createDataFrame([("FILE_LENGTH", "a", None, None, 301.0), ("FILE_LENGTH", "b", None, None, 500.0), ("NESTING_DEPTH", "c", "f", 3, 7.0), ("DUPLICATION", "", None, None, 5.04), ("PR_SIZE", "", None, None, 400.0)], "metric_type string, file_path string, function_name string, line_number int, value double")
    found = [(r["metric_type"], r["level"], r["current_value"], r["threshold"], r["message"]) for r in metrics.alerts(rows).collect()]
    assert found == [
        ("NESTING_DEPTH", "error", 7, 6, "Deep nesting (7 levels) in 'f' exceeds error threshold (6)"), ("DUPLICATION", "warning", 5, 5, "Code duplication (5.0%) exceeds warning threshold (5.0%)"),
        ("FILE_LENGTH", "warning", 301, 300, "File is long (301 lines) exceeds warning threshold (300)"), ("FILE_LENGTH", "warning", 500, 300, "File is long (500 lines) exceeds warning threshold (300)"),
    ]


def test_summary(spark):
    rows = files(spark, [("a.py", "def f(a):\n    if a:\n        return 1\n"), ("../b.py", "def g():\n    pass\n")])
    r = metrics.summary(rows, 30, 5).first()
    assert r["total_files_changed"] == 2 and r["pr_size_category"] == "XS" and r["max_cyclomatic_complexity"] == 2 and r["max_file_length"] == 3
    none = metrics.summary(files(spark, [("a.txt", "x\n")]), 350, 0).first()
    assert none["pr_size_category"] == "Medium" and none["max_cyclomatic_complexity"] is None
    per_file = metrics.files(rows)
    assert [x["file_path"] for x in per_file.collect()] == ["a.py"]
    assert metrics.measures_of(per_file, metrics.functions(rows)).count() == 9


def test_projects(spark):
    paths = spark.createDataFrame([(p,) for p in ("apps/web/package.json", "crates/core/Cargo.toml", "services/api/pyproject.toml", "node_modules/x/package.json", ".github/workflows/ci.yml", "a/Dockerfile")], "path string")
    assert [(r["root"], r["language"]) for r in detect.projects(paths).collect()] == [("apps/web", "typescript"), ("crates/core", "rust"), ("services/api", "python")]
    p = detect.profile(paths).first()
    assert p["languages"] == ["rust", "typescript", "python"] and p["primary_language"] == "rust" and p["is_polyglot"] and p["label"] == "polyglot"
    assert {(r["path"], r["key"], r["kind"]) for r in detect.auxiliary_targets(paths).collect()} >= {(".github/workflows", "github-actions", "cicd"), ("a/Dockerfile", "dockerfile", "iac")}
    assert [r["command"] for r in detect.build_targets(detect.projects(paths)).collect()] == ["npm run build --prefix apps/web", "cargo build --manifest-path crates/core/Cargo.toml", "python -m compileall services/api"]
    empty = detect.profile(paths.limit(0)).first()
    assert empty["label"] == "unknown" and empty["primary_language"] == "unknown"
