"""SQL of the corpora, which Spark and DuckDB read alike, and DuckDB SQL that answers the queries independently."""

from __future__ import annotations

import re

from lumenscan.catalog.loader import DEFAULT_SUGGESTION, IMPORT_SUGGESTIONS, RuleBundle, SecretRule, builtin_iac_rules, builtin_secret_rules
from lumenscan.functions.paths import IAC_IGNORED, LANGUAGES, METRICS_SUFFIXES, SECRET_IGNORED
from lumenscan.functions.halstead import COMMON, OPERATOR_WORDS, OTHER_OPERATOR_WORDS, OTHER_TYPE_WORDS, SYMBOLS, TYPE_WORDS
from lumenscan.functions.text import GLOBAL_ALLOWLIST, IAC_PLACEHOLDERS, SECRET_PLACEHOLDERS
from lumenscan.operators.iac import DEFAULT_SUGGESTION as IAC_SUGGESTION
from lumenscan.operators.metrics import ALERTS
from lumenscan.operators.secrets import BASE64, HEX, ROTATION
from lumenscan.operators.secrets import TOKEN as ENTROPY_TOKEN
from lumenscan.plans.examples import iac_examples, secret_examples

# --- corpora ---

_H = "md5(cast(c_custkey AS string))"
SECRET_PATH = "concat(CASE WHEN c_custkey % 11 = 0 THEN 'vendor/lib/' WHEN c_custkey % 7 = 0 THEN 'secret/skip/' WHEN c_custkey % 13 = 0 THEN '../up/' ELSE 'src/app/' END, 'f', cast(c_custkey AS string), '.env')"
SECRET_LINE = (
    f"CASE c_custkey % 10 WHEN 0 THEN concat('AWS_KEY=AKIA', upper(substr({_H}, 1, 16))) WHEN 1 THEN concat('token: ghp_', {_H}, substr({_H}, 1, 4)) WHEN 2 THEN concat('password = \"', substr({_H}, 1, 12), '\"') "
    f"WHEN 3 THEN concat('api_key: \"', {_H}, '\"') WHEN 4 THEN concat('postgres://user:', substr({_H}, 1, 8), '@db.host/', substr({_H}, 9, 4)) WHEN 5 THEN concat('EXAMPLE_KEY=AKIAEXAMPLE', upper(substr({_H}, 1, 9))) "
    f"WHEN 6 THEN concat('stripe sk_live_', {_H}) WHEN 7 THEN concat('slack key = ', {_H}, {_H}) WHEN 8 THEN concat('nothing here ', substr({_H}, 1, 5)) "
    f"ELSE concat('jwt eyJ', substr({_H}, 1, 10), '.eyJ', substr({_H}, 5, 10), '.', {_H}) END"
)
TOKEN = f"CASE c_custkey % 6 WHEN 0 THEN substr({_H}, 1, 7) WHEN 1 THEN substr({_H}, 1, 11) WHEN 2 THEN {_H} WHEN 3 THEN concat('test', substr({_H}, 1, 9)) WHEN 4 THEN concat('aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa', substr({_H}, 1, 1)) ELSE concat('é', substr({_H}, 1, 20), 'ß') END"
#: Rules of a user's own: what the first one's allowlist takes, the second one reports.
OWN_RULES = [
    SecretRule("OWN-1", "own/1", "Key", "A key.", "high", ["AKIA[0-9A-Z]{16}"], "own", ["akia"], None, ["^AKIA[0-7]"]), SecretRule("OWN-2", "own/2", "Part", "A part.", "low", ["AKIA[0-9A-Z]{8}"], "own", ["AKI"]),
]
TREE_FOLDER = "CASE file_ord % 5 WHEN 0 THEN 'node_modules' WHEN 1 THEN 'skip' WHEN 2 THEN 'app' ELSE 'src' END"
ENTROPY_LINE = f"concat('key ', {_H}, ' ', substr('ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/=_-ghijklm', cast(c_custkey % 20 + 1 AS int), 30), {_H}, ' ', {_H}, md5({_H}), CASE WHEN c_custkey % 9 = 0 THEN ' TEST' ELSE ' ' END, {_H}, {_H})"
COMMENTED = (
    "CASE o_orderkey % 6 WHEN 0 THEN concat('x = ', o_orderkey, ' // note') WHEN 1 THEN concat('s = \"a // b\" # ', o_orderkey) WHEN 2 THEN concat('u = \"it # is\" / ', o_orderkey) "
    "WHEN 3 THEN concat('url = \"http://h/', o_orderkey, '\"') WHEN 4 THEN concat('k # ', o_orderkey, ' // z') ELSE concat('plain ', o_orderkey) END"
)
META_JSON = (
    "concat('{\"version\": \"1\", \"list\": [1], \"lang', p_partkey % 3, '\": {\"vulnerabilities\": [{\"id\": \"R', p_partkey % 97, '\", \"cwe\": [\"CWE-1\", \"CWE-2\"]', CASE WHEN p_size % 3 = 0 THEN concat(', \"name\": \"n', p_partkey, '\"') ELSE '' END, "
    "CASE WHEN p_size % 2 = 0 THEN ', \"severity\": \"MINOR\"' ELSE '' END, '}], \"bugs\": [{\"id\": \"B', p_partkey % 31, '\"}, {\"name\": \"no id\"}]}, \"alpha\": {\"code_smells\": [{\"id\": \"R', p_partkey % 53, '\", \"name\": \"smell\"}]}}')"
)
PATTERN_JSON = (
    "concat('{\"version\": \"2\", \"statistics\": {\"vulnerabilities\": [{\"ruleId\": \"S\", \"patterns\": [\"s\"], \"message\": \"s\"}]}, \"', CASE p_partkey % 5 WHEN 0 THEN 'py' WHEN 1 THEN 'Python' WHEN 2 THEN 'js' WHEN 3 THEN 'typescript' ELSE 'k8s' END, "
    "'\": {\"bugs\": [{\"ruleId\": \"Q', p_partkey, '\", \"patterns\": [\"z\"], \"suggestion\": \"fix it\"', CASE WHEN p_size % 7 = 0 THEN '' ELSE ', \"message\": \"n\"' END, '}], \"vulnerabilities\": [{\"ruleId\": \"P', p_partkey, '\", \"patterns\": [\"x+\", \"y\"], \"message\": \"m\"}]}}')"
)
LEAK_JSON = (
    "concat('{\"title\": \"t\", \"rules\": [{\"id\": \"', CASE p_partkey % 4 WHEN 0 THEN 'aws-' WHEN 1 THEN 'Test-' WHEN 2 THEN 'plain-' ELSE 'gitlab-private-' END, p_partkey, '\", \"description\": \"d\", \"keywords\": [\"k1\", \"k2\"]', CASE WHEN p_size % 5 = 0 THEN ', \"tags\": [\"tagged\", \"x\"]' ELSE '' END, "
    "CASE WHEN p_size % 2 = 0 THEN ', \"entropy\": 3.5' ELSE '' END, CASE p_size % 4 WHEN 0 THEN ', \"regex\": \"a(b\"' WHEN 1 THEN ', \"path\": \"p/q\"' WHEN 2 THEN '' ELSE concat(', \"regex\": \"r', p_size, '\"') END, '}]}')"
)
IAC_PATH = (
    "CASE p_partkey % 5 WHEN 0 THEN concat('docker/Dockerfile.', cast(p_partkey AS string)) WHEN 1 THEN concat('stack', cast(p_partkey AS string), '/docker-compose.yml') "
    "WHEN 2 THEN concat('infra/k8s/app', cast(p_partkey AS string), '.yaml') WHEN 3 THEN concat('infra/main', cast(p_partkey AS string), '.tf') ELSE concat('.github/workflows/ci', cast(p_partkey AS string), '.yml') END"
)
IAC_LINE = (
    "CASE p_partkey % 5 WHEN 0 THEN CASE p_size % 5 WHEN 0 THEN 'USER root' WHEN 1 THEN 'FROM node:latest' WHEN 2 THEN 'RUN curl http://x | sh' WHEN 3 THEN 'ADD . /app' ELSE 'ENV DB_PASSWORD=x' END "
    "WHEN 1 THEN CASE p_size % 3 WHEN 0 THEN '    privileged: true' WHEN 1 THEN '    network_mode: host' ELSE '    image: web:1.2' END "
    "WHEN 2 THEN CASE p_size % 3 WHEN 0 THEN '  runAsUser: 0' WHEN 1 THEN '  hostNetwork: true' ELSE '  replicas: 3' END "
    "WHEN 3 THEN CASE p_size % 8 WHEN 0 THEN 'acl = \"public-read\"' WHEN 1 THEN 'storage_encrypted = false' WHEN 2 THEN 'password = \"hunter2\"' ELSE 'name = \"x\"' END "
    "ELSE CASE p_size % 8 WHEN 0 THEN '      uses: actions/checkout@main' WHEN 1 THEN '      token: abc' WHEN 2 THEN 'permissions: write-all' ELSE 'on: push' END END"
)
CODE_PATH = "concat(CASE o_orderkey % 5 WHEN 0 THEN 'src/a' WHEN 1 THEN 'web/b' WHEN 2 THEN 'x/c' WHEN 3 THEN 'r/d' ELSE 'bin/e' END, cast(o_orderkey % 50 AS string), CASE o_orderkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.cpp' WHEN 3 THEN '.rs' ELSE '.sh' END)"
CODE_LINE = (
    "concat('  ', CASE o_orderkey % 5 WHEN 0 THEN CASE o_custkey % 4 WHEN 0 THEN 'x = eval(data)' WHEN 1 THEN 'except:' WHEN 2 THEN 'print(os.system(cmd))' ELSE 'pass' END "
    "WHEN 1 THEN CASE o_custkey % 3 WHEN 0 THEN 'el.innerHTML = x' WHEN 1 THEN 'eval(y); new Function(z)' ELSE 'return 1' END WHEN 2 THEN CASE o_custkey % 2 WHEN 0 THEN 'strcpy(dst, src);' ELSE 'return 0;' END "
    "WHEN 3 THEN CASE o_custkey % 2 WHEN 0 THEN 'let v = f().unwrap();' ELSE 'Ok(())' END ELSE CASE o_custkey % 2 WHEN 0 THEN 'eval \"$1\"' ELSE 'curl http://h | sh' END END)"
)
TREE_PATH = (
    "concat(CASE l_suppkey % 6 WHEN 0 THEN 'apps/web/' WHEN 1 THEN 'crates/core/' WHEN 2 THEN 'services/api/' WHEN 3 THEN 'node_modules/x/' WHEN 4 THEN 'infra/k8s/' ELSE '.github/workflows/' END, "
    "CASE l_linenumber WHEN 1 THEN 'package.json' WHEN 2 THEN 'Cargo.toml' WHEN 3 THEN 'main.py' WHEN 4 THEN 'Dockerfile' WHEN 5 THEN 'deploy-service.yml' WHEN 6 THEN concat('mod', cast(l_partkey % 20 AS string), '.rs') "
    "ELSE concat('dir/../x', cast(l_partkey % 5 AS string), '.tf') END)"
)
DIFF_LINE = "concat(CASE l_returnflag WHEN 'R' THEN '-' WHEN 'A' THEN '+' ELSE ' ' END, 'item ', cast(l_partkey AS string), CASE WHEN l_partkey % 9 = 0 THEN ' os.system(x)' ELSE '' END)"
DIFF_TEXT = (
    "concat('diff --git a/src/o', cast(diff_id AS string), '.py b/src/o', cast(diff_id AS string), '.py', chr(10), '--- a/src/o.py', chr(10), '+++ b/src/o', cast(diff_id AS string), '.py', chr(10), "
    "'@@ -1,5 +', cast(diff_id % 50 + 1 AS string), ',7 @@', chr(10), body)"
)
CI_PATH = "CASE s_suppkey % 3 WHEN 0 THEN concat('.github/workflows/w', cast(s_suppkey AS string), '.yml') WHEN 1 THEN concat('p', cast(s_suppkey AS string), '/.gitlab-ci.yml') ELSE concat('notes/', cast(s_suppkey AS string), '.yml') END"
CI_TEXT = "concat('jobs:', chr(10), '  - run: |', chr(10), '      eval ', cast(s_suppkey AS string), chr(10), '    name: x', chr(10), '  script:', chr(10), '    - make', chr(10), '    - echo ', cast(s_suppkey AS string), chr(10), 'after_script: done', chr(10))"
#: A file of code by language: extension, name of its function, lines before the function, its text, a line that comes p_size % 8 times, its
#: closing, and how many parameters it has; {n} is p_size, `~` breaks lines.
CODE = {
    "python": (".py", "f{n}", "# file~", "def f{n}(a, b=1):~", "    if a and b:~        a = a + 1~", "    return b~", 2),
    "go": (".go", "S.Do{n}", "// file~", "func (s *S) Do{n}(a, b int) int {~", "  if a > 1 || b == 2 { a-- }~", "  return a~}~", 2),
    "typescript": (".ts", "g{n}", "/* file~*/~", "export const g{n} = (x: number) => {~", "  if (x > 1) {~    x = x - 1;~  } else if (x < 0) {~    x = x ? 1 : 2;~  }~", "  return x;~};~", 1),
    "rust": (".rs", "h{n}", "/// file~", "pub fn h{n}(x: u32) -> u32 {~    match x {~", "        7 => 2,~", "        _ => x,~    }~}~", 1),
    "javascript": (".js", "j{n}", "// file~", "async function j{n}(a, b, ...c) {~", "  for (const x of c) { a += x; }~", "  return a;~}~", 3),
    "java": (".java", "m{n}", "public class A {~", "  public int m{n}(int a, String b) {~", "    while (a > 1 && b != null) { a--; }~", "    return a;~  }~", 2),
    "dotnet": (".cs", "M{n}", "class A {~", "  public int M{n}(int a, int? b) {~", "    foreach (var x in xs) { a = b ?? a; }~", "    return a;~  }~", 2),
    "cpp": (".cpp", "c{n}", "// file~", "int c{n}(int a, const char *b) {~", "  for (int i = 0; i < a; i++) { a += 2; }~", "  return a;~}~", 2),
    "php": (".php", "p{n}", "<?php~", "public function p{n}($a, $b) {~", "  if ($a && $b) { $a = 1; } elseif ($b) { $b = 2; }~", "  return $a;~}~", 2),
    "kotlin": (".kt", "k{n}", "// file~", "fun k{n}(a: Int, vararg b: String): Int {~", "  while (a > 1) { a = a - 1 }~", "  return a~}~", 2),
    "ruby": (".rb", "r{n}", "# file~", "def r{n}(a, b: 1)~", "  a = 1 unless b~", "  a~", 2),
}
#: What follows the function.
AFTER = {"java": "}~", "dotnet": "}~", "ruby": "end~"}


def _text(x: str) -> str:
    """SQL for a text of CODE."""
    out = f"replace('{x}', '~', chr(10))"
    return f"replace({out}, '{{n}}', cast(p_size AS string))" if "{n}" in x else out


def _by_language(of) -> str:
    return "CASE p_partkey % 11 " + " ".join(f"WHEN {i} THEN {of(k, x)}" for i, (k, x) in enumerate(CODE.items())) + " END"


def _body(x: tuple) -> str:
    return f"concat({_text(x[3])}, repeat({_text(x[4])}, cast(p_size % 8 AS int)), {_text(x[5])})"


FILE_PATH = "concat('src/m', cast(p_partkey AS string), " + _by_language(lambda _, x: f"'{x[0]}'") + ")"
FILE_TEXT = _by_language(lambda k, x: f"concat({_text(x[2])}, {_body(x)}, {_text(AFTER.get(k, ''))})")
#: A measure a line item, of all kinds, around their thresholds.
MEASURE_KIND = "CASE l_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(("PR_SIZE", "FILES_CHANGED", "DUPLICATION", "FILE_LENGTH", "CYCLOMATIC_COMPLEXITY", "COGNITIVE_COMPLEXITY", "FUNCTION_LENGTH", "NESTING_DEPTH"))) + " END"
MEASURE = "cast(CASE l_orderkey % 8 WHEN 0 THEN l_quantity * 25 WHEN 1 THEN l_quantity WHEN 2 THEN l_quantity / 2 WHEN 3 THEN l_quantity * 15 WHEN 6 THEN l_quantity * 3 WHEN 7 THEN l_linenumber + 1 ELSE l_quantity END AS double)"
SECRET_FILE_PATH = "concat(CASE p_partkey % 5 WHEN 0 THEN 'vendor/x/' WHEN 1 THEN 'skip/y/' ELSE 'src/' END, 'f', cast(p_partkey AS string), '.py')"
IAC_FILE_DIR = "concat(CASE p_partkey % 4 WHEN 0 THEN 'node_modules/d' WHEN 1 THEN 'skip/d' ELSE 'd' END, cast(p_partkey AS string), '/')"
GLOB_PATH = "concat(CASE l_suppkey % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'src/gen/' WHEN 2 THEN 'docs/a/' ELSE 'lib/' END, CASE l_linenumber % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'test_y' ELSE 'z.min' END, CASE l_partkey % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.py' ELSE '.md' END)"
SEVERITY = "CASE o_orderkey % 9 WHEN 0 THEN 'BLOCKER' WHEN 1 THEN 'critical' WHEN 2 THEN 'Major' WHEN 3 THEN 'minor' WHEN 4 THEN 'info' WHEN 5 THEN 'high' WHEN 6 THEN 'Medium' WHEN 7 THEN 'low' ELSE 'odd' END"


# --- SQL pieces ---


def _q(x: object) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(v if isinstance(v, _Raw) else _q(v) for v in r) + ')' for r in rows)}) AS t({names})"


class _Raw(str):
    pass


def _list(words: list[str]) -> _Raw:
    return _Raw("CAST([" + ", ".join(_q(w) for w in words) + "] AS VARCHAR[])")


def _any(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def _lines(source: str) -> str:
    """id, path, line_number, content of the lines of `source` (id, path, content)."""
    parts = r"CASE WHEN content IS NULL OR content = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(regexp_replace(content, '\r?\n\z', ''), '\r?\n') END"
    return f"SELECT id, path, i AS line_number, parts[i] AS content FROM (SELECT id, path, {parts} AS parts FROM ({source}) s) p, unnest(range(1, len(parts) + 1)) u(i)"


_DOCS = "SELECT doc_id AS id, concat('docs/', doc_id, '.txt') AS path, text AS content FROM documents"
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _secret_hits(lines: str, rules: list[SecretRule] | None = None) -> str:
    """The first accepted match of each line of `lines` (id, path, line_number, content). A branch a pattern, so that each is compiled once."""
    branches = []
    for i, r in enumerate(rules or builtin_secret_rules()):
        allow = f" AND NOT regexp_matches(matched_text, {_q('|'.join(r.allowlist_patterns))})" if r.allowlist_patterns else ""
        keyword = "(" + " OR ".join(f"contains(low, {_q(k.lower())})" for k in r.keywords) + ") AND " if r.keywords else ""
        for j, p in enumerate(r.patterns):
            named = f"{i} AS rule_ord, {j} AS pattern_ord, {_q(r.rule_id)} AS rule_id, {_q(r.title)} AS title, {_q(r.message)} AS message, {_q(r.severity.lower())} AS severity, {_q(r.provider)} AS provider, CAST({_q(r.entropy)} AS DOUBLE) AS rule_entropy"
            branches.append(f"SELECT * FROM (SELECT id, path, line_number, content, {named}, regexp_extract(content, {_q(p)}) AS matched_text FROM lns WHERE {keyword}regexp_matches(content, {_q(p)})) WHERE TRUE{allow}")
    return f"""SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY id, line_number ORDER BY rule_ord, pattern_ord) AS n FROM (
        WITH lns AS MATERIALIZED (SELECT *, lower(content) AS low FROM ({lines})) {" UNION ALL ".join(branches)}) h
      WHERE NOT regexp_matches(matched_text, {_q('|'.join(GLOBAL_ALLOWLIST))}) AND NOT regexp_matches(upper(matched_text), {_q(_any(SECRET_PLACEHOLDERS))})
        AND NOT (strlen(matched_text) >= 4 AND len(list_distinct(string_split(matched_text, ''))) / strlen(matched_text) < 0.2)) WHERE n = 1"""


def _mask(x: str) -> str:
    return f"CASE WHEN strlen({x}) <= 8 THEN concat(left({x}, 2), '****') WHEN strlen({x}) <= 12 THEN concat(left({x}, 2), '****', right({x}, 2)) ELSE concat(left({x}, 4), '****', right({x}, 4)) END"


def _entropy(x: str) -> str:
    p = f"(len(list_filter(string_split({x}, ''), lambda y: y = c)) / strlen({x}))"
    return f"CASE WHEN {x} = '' THEN 0.0 ELSE list_sum(list_transform(list_distinct(string_split({x}, '')), lambda c: -{p} * log2({p}))) END"


def _confidence(x: str, e: str) -> str:
    return f"least(0.85 + least(strlen({x}) / 40.0, 0.1) + CASE WHEN {e} IS NULL THEN 0.0 ELSE least({e} / 10.0, 0.05) END, 0.99)"


_SECRET_LINES = f"SELECT c_custkey AS id, {SECRET_PATH} AS path, 1 AS line_number, {SECRET_LINE} AS content FROM customer"
_ENTROPY_LINES = f"SELECT c_custkey AS doc_id, {ENTROPY_LINE} AS text FROM customer"
_IAC_LINES = f"SELECT p_partkey AS id, {IAC_PATH} AS path, CAST(p_size AS INTEGER) AS line_number, {IAC_LINE} AS content FROM part"
_CODE_LINES = f"SELECT o_orderkey AS id, {CODE_PATH} AS path, CAST(o_orderkey % 97 + 1 AS INTEGER) AS line_number, {CODE_LINE} AS content FROM orders"
def _secret_catalog() -> str:
    rows = secret_examples()
    return f"SELECT p_partkey AS id, concat('src/app/f', p_partkey, '.env') AS path, 1 AS line_number, x.content FROM part JOIN (SELECT * FROM {_values(rows, 'i, content')}) x ON p_partkey % {len(rows)} = x.i"


def _secret_files() -> str:
    rows = secret_examples()
    values = f"(SELECT * FROM {_values(rows, 'i, content')})"
    return f"SELECT p_partkey AS id, {SECRET_FILE_PATH} AS path, concat(x.content, chr(10), 'plain', chr(13), chr(10), y.content, chr(10)) AS content FROM part JOIN {values} x ON p_partkey % {len(rows)} = x.i JOIN {values} y ON (p_partkey * 7 + 2) % {len(rows)} = y.i"


def _iac_catalog() -> str:
    rows = iac_examples()
    return f"SELECT p_partkey AS id, concat('d', p_partkey, '/', x.path) AS path, 1 AS line_number, x.content FROM part JOIN (SELECT * FROM {_values(rows, 'i, path, content')}) x ON p_partkey % {len(rows)} = x.i"


def _iac_files() -> str:
    rows = iac_examples()
    values = f"(SELECT * FROM {_values(rows, 'i, path, content')})"
    return f"SELECT p_partkey AS id, concat({IAC_FILE_DIR}, x.path) AS path, concat(x.content, chr(10), y.content, chr(10), chr(10), x.content, chr(10)) AS content FROM part JOIN {values} x ON p_partkey % {len(rows)} = x.i JOIN {values} y ON (p_partkey + 2) % {len(rows)} = y.i"


_CI_FILES = f"SELECT s_suppkey AS id, {CI_PATH} AS path, {CI_TEXT} AS content FROM supplier"
_PATHS = f"SELECT DISTINCT {TREE_PATH} AS path FROM lineitem"
_RANK = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
_TRAVERSAL = r"regexp_matches(replace(path, '\', '/'), '^/|^[A-Za-z]:|(^|/)\.\.(/|$)')"
_NAME = r"regexp_extract(path, '([^/]*)/*$', 1)"


def _iac_type(path: str = "path") -> str:
    name, low = rf"regexp_extract({path}, '([^/]*)/*$', 1)", f"lower({path})"
    return (
        f"CASE WHEN lower({name}) LIKE 'dockerfile%' OR {name} LIKE '%.dockerfile' THEN 'dockerfile' WHEN {name} LIKE '%docker-compose%' OR {name} IN ('compose.yml', 'compose.yaml') THEN 'docker-compose' "
        f"WHEN regexp_matches({low}, '/k8s/|/kubernetes/|/manifests/|/helm/') OR (regexp_matches({name}, '\\.ya?ml$') AND regexp_matches({low}, 'deployment|service|configmap')) THEN 'kubernetes' "
        f"WHEN regexp_matches({name}, '\\.(tf|tfvars)$') THEN 'terraform' WHEN {low} LIKE '%.github/workflows/%' THEN 'github-actions' WHEN {name} = '.gitlab-ci.yml' THEN 'gitlab-ci' WHEN {name} LIKE '%azure-pipelines%' THEN 'azure-pipelines' ELSE 'unknown' END"
    )


def _iac_hits(lines: str) -> str:
    rows = [(i, j, r.iac_type, r.rule_id, r.title, r.message, r.severity, r.suggestion or IAC_SUGGESTION, r.source, p) for i, r in enumerate(builtin_iac_rules()) for j, p in enumerate(r.patterns)]
    rules = _values(rows, "rule_ord, pattern_ord, iac_type, rule_id, title, message, severity, suggestion, source, pattern")
    return f"""SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY id, line_number ORDER BY rule_ord, pattern_ord) AS n FROM (
        SELECT l.*, r.*, regexp_extract(content, pattern) AS matched_pattern FROM (SELECT *, {_iac_type()} AS kind FROM ({lines})) l JOIN (SELECT * FROM {rules}) r ON r.iac_type = l.kind AND regexp_matches(content, pattern)) h
      WHERE NOT regexp_matches(upper(matched_pattern), {_q(_any(IAC_PLACEHOLDERS))})) WHERE n = 1"""


def _code_hits(lines: str, lang: str | None = None) -> str:
    bundle = RuleBundle()
    severity = {"BLOCKER": "critical", "CRITICAL": "critical", "MAJOR": "high", "MINOR": "medium", "INFO": "info"}
    category = {"Vulnerability": "security", "SecurityHotspot": "security", "Bug": "bug_risk"}
    rows = []
    for language in bundle.pattern_languages():
        for i, r in enumerate(bundle.patterns_for(language)):
            meta = bundle.find_rule(r["rule_id"])
            cwe = f" [CWE: {', '.join(meta['cwe'])}]" if meta["cwe"] else ""
            rows.append((i, language, r["rule_id"], severity[meta["severity"]], category.get(r["category"], "maintainability"), meta["name"], r["message"] + cwe, "|".join(f"(?:{p})" for p in r["patterns"])))
    rules = _values(rows, "rule_ord, language, rule_id, severity, category, title, description, pattern")
    lang = lang or "CASE regexp_extract(path, '\\.(\\w+)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'cpp' THEN 'cpp' WHEN 'rs' THEN 'rust' WHEN 'sh' THEN 'shell' END"
    return f"SELECT id, rule_ord, rule_id, path AS file_path, line_number AS line_start, severity, category, title, description, {_TRIM.format('content')} AS code_snippet FROM (SELECT *, {lang} AS lang FROM ({lines})) l JOIN (SELECT * FROM {rules}) r ON r.language = l.lang AND regexp_matches(content, pattern)"


def _loc(source: str) -> str:
    """path, total_lines, code_lines, comment_lines, blank_lines. A line maps the state before it (in a block or not) to the state after:
    to a constant, to itself, or to the other one; the state is the last constant, turned as often as lines since have turned it."""
    t = _TRIM.format("content")
    zero = "CASE WHEN t = '' THEN 0 WHEN t LIKE '//%' OR t LIKE '#%' THEN 0 WHEN t LIKE '/*%' THEN CASE WHEN contains(t, '*/') THEN 0 ELSE 1 END WHEN t LIKE '<!--%' THEN CASE WHEN contains(t, '-->') THEN 0 ELSE 1 END WHEN t LIKE '=begin%' THEN 1 WHEN t LIKE '=end%' THEN 0 WHEN t LIKE '''''''%' OR t LIKE '\"\"\"%' THEN 1 ELSE 0 END"
    return f"""WITH l AS (SELECT id, path, line_number, {t} AS t FROM ({_lines(source)})), f AS (SELECT *, {zero} AS f0, CASE WHEN t = '' OR NOT contains(t, '*/') THEN 1 ELSE 0 END AS f1 FROM l),
      g AS (SELECT *, CASE WHEN f0 = f1 THEN f0 END AS fixed, CASE WHEN f0 = 1 AND f1 = 0 THEN 1 ELSE 0 END AS turns FROM f),
      h AS (SELECT *, coalesce(sum(turns) OVER w, 0) AS turned FROM g WINDOW w AS (PARTITION BY id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
      s AS (SELECT *, last_value(CASE WHEN fixed IS NOT NULL THEN fixed * 1000000 + turned END IGNORE NULLS) OVER w AS mark, lag(turned, 1, 0) OVER (PARTITION BY id ORDER BY line_number) AS before FROM h
        WINDOW w AS (PARTITION BY id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      z AS (SELECT *, CASE WHEN mark IS NULL THEN before % 2 ELSE (mark // 1000000 + before - mark % 1000000) % 2 END AS inside FROM s)
      SELECT e.path, coalesce(count(z.t), 0) AS total_lines, coalesce(sum(CASE WHEN t <> '' AND NOT (inside = 1 OR t LIKE '//%' OR t LIKE '#%' OR t LIKE '/*%' OR t LIKE '<!--%' OR t LIKE '=begin%' OR t LIKE '=end%' OR t LIKE '''''''%' OR t LIKE '\"\"\"%') THEN 1 ELSE 0 END), 0)::BIGINT AS code_lines,
        coalesce(sum(CASE WHEN t <> '' AND (inside = 1 OR t LIKE '//%' OR t LIKE '#%' OR t LIKE '/*%' OR t LIKE '<!--%' OR t LIKE '=begin%' OR t LIKE '=end%' OR t LIKE '''''''%' OR t LIKE '\"\"\"%') THEN 1 ELSE 0 END), 0)::BIGINT AS comment_lines,
        coalesce(sum(CASE WHEN t = '' THEN 1 ELSE 0 END), 0)::BIGINT AS blank_lines FROM ({source}) e LEFT JOIN z ON z.id = e.id GROUP BY e.path, e.id"""


def _first(column: str, cases: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {condition} THEN {_q(value)}" for condition, value in cases) + f" ELSE {default} END"


_EXT = r"nullif(lower(regexp_extract(regexp_extract(path, '([^/]*)/*$', 1), '^.+\.([^.]*)$', 1)), '')"
_SOURCE_LANGUAGE = "CASE " + " ".join(f"WHEN {_EXT} IN ({', '.join(_q(e[1:]) for e in x[0])}) THEN {_q(k)}" for k, x in LANGUAGES.items()) + " END"
_LOW_NAME = f"lower({_NAME})"
_MARKER = (
    f"CASE WHEN {_LOW_NAME} LIKE '%.csproj' OR {_LOW_NAME} LIKE '%.sln' THEN 'dotnet' WHEN {_LOW_NAME} = 'cargo.toml' THEN 'rust' WHEN {_LOW_NAME} = 'go.mod' THEN 'go' WHEN {_LOW_NAME} IN ('pom.xml', 'settings.gradle', 'build.gradle') THEN 'java' "
    f"WHEN {_LOW_NAME} IN ('build.gradle.kts', 'settings.gradle.kts') THEN 'kotlin' WHEN {_LOW_NAME} = 'package.json' THEN 'typescript' WHEN {_LOW_NAME} IN ('pyproject.toml', 'requirements.txt', 'setup.py') THEN 'python' WHEN {_LOW_NAME} = 'composer.json' THEN 'php' "
    f"WHEN {_LOW_NAME} = 'gemfile' THEN 'ruby' WHEN {_LOW_NAME} IN ('makefile', 'cmakelists.txt') THEN 'cpp' WHEN {_LOW_NAME} LIKE '%.gemspec' THEN 'ruby' END"
)
_PARENT = r"CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"
_VISITED = f"SELECT path FROM ({_PATHS}) WHERE NOT regexp_matches(path, '(^|/)(node_modules|target|\\.git|__pycache__|vendor|dist|build|\\.next|bin|obj|\\.idea|\\.vscode|\\.venv|coverage)/')"
_PRIORITY = "CASE language " + " ".join(f"WHEN {_q(k)} THEN {i}" for i, k in enumerate(LANGUAGES)) + " END"
_PROJECTS = f"SELECT DISTINCT {_PARENT} AS root, {_MARKER} AS language, {_LOW_NAME} AS marker_file FROM ({_VISITED}) WHERE {_MARKER} IS NOT NULL"
_LANGUAGES = f"SELECT DISTINCT language, {_PRIORITY} AS priority FROM (SELECT {_SOURCE_LANGUAGE} AS language FROM ({_VISITED}) UNION ALL SELECT {_MARKER} FROM ({_VISITED})) WHERE language IS NOT NULL"
_KEY = f"CASE WHEN {_iac_type('lower(path)')} <> 'unknown' THEN {_iac_type('lower(path)')} WHEN {_EXT} IN ('jsp', 'jspx') THEN 'jsp' WHEN {_EXT} IN ('page', 'component') THEN 'vf' WHEN {_EXT} = 'xml' THEN 'xml' WHEN {_EXT} = 'json' THEN 'json' WHEN {_EXT} IN ('yaml', 'yml') THEN 'yaml' END"
_SCOPE = rf"CASE WHEN key = 'github-actions' AND regexp_extract(path, '(?i)^((?:.*/)?workflows)(?:/|$)', 1) <> '' THEN regexp_extract(path, '(?i)^((?:.*/)?workflows)(?:/|$)', 1) WHEN key IN ('dockerfile', 'docker-compose', 'gitlab-ci', 'azure-pipelines') THEN path ELSE {_PARENT} END"
_KIND = "CASE WHEN key IN ('dockerfile', 'docker-compose', 'kubernetes', 'terraform') THEN 'iac' WHEN key IN ('github-actions', 'gitlab-ci', 'azure-pipelines') THEN 'cicd' WHEN key IN ('jsp', 'vf') THEN 'template' ELSE 'config' END"
_TARGETS = f"SELECT scope AS path, key, {_KIND} AS kind, max_by(name, path) AS marker FROM (SELECT path, key, {_SCOPE} AS scope, {_LOW_NAME} AS name FROM (SELECT path, {_KEY} AS key FROM ({_VISITED})) WHERE key IS NOT NULL) GROUP BY scope, key"
_DIFF_ITEMS = f"SELECT l_orderkey AS diff_id, concat('src/o', l_orderkey, '.py') AS path, l_returnflag AS flag, substr({DIFF_LINE}, 2) AS content, l_orderkey % 50 + 1 + count(CASE WHEN l_returnflag <> 'R' THEN 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {DIFF_LINE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS line_number FROM lineitem"



_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_CODE_FILES = f"SELECT p_partkey AS id, {FILE_PATH} AS path, {FILE_TEXT} AS content FROM part"


def _duplicates(source: str, within: bool = False, as_written: bool = False) -> str:
    """CTEs up to `inst`: instances (id, path, s, e) of groups, with hash, line_count, token_count, first_path, first_line."""
    own, own_key = (", id", ", id") if within else ("", "")
    norm = "content" if as_written else f"regexp_replace(regexp_replace(content, '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g')"
    return f"""ll AS ({_lines(source)}), nl AS (SELECT id, path, line_number, {norm} AS norm FROM ll),
      f AS (SELECT id, any_value(path) AS path, list(norm ORDER BY line_number) AS norm, list(len(list_filter(string_split_regex(norm, '{_SPACE}+'), lambda t: strlen(t) > 1)) ORDER BY line_number) AS toks FROM nl GROUP BY id),
      seeds AS (SELECT id, s, array_to_string(norm[s : s + 9], chr(10)) AS seed FROM f, unnest(range(1, greatest(1, len(norm) - 8))) u(s)),
      hits AS (SELECT id, s FROM seeds SEMI JOIN (SELECT seed{own} FROM seeds GROUP BY seed{own_key} HAVING count(*) > 1) t USING (seed{own_key})),
      runs AS (SELECT id, min(s) AS a, max(s) AS b FROM (SELECT id, s, s - row_number() OVER (PARTITION BY id ORDER BY s) AS g FROM hits) GROUP BY id, g),
      blocks AS (SELECT id, s, e FROM runs, unnest(range(a, b + 1)) u(s), unnest(range(s + 9, b + 10)) v(e)),
      found AS (SELECT id, path, s, e, left(sha256(array_to_string(norm[s:e], chr(10))), 16) AS hash, list_sum(toks[s:e])::BIGINT AS n FROM blocks JOIN f USING (id) WHERE list_sum(toks[s:e]) >= 50),
      isles AS (SELECT *, sum(CASE WHEN s > before + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY hash, id ORDER BY s) AS isle FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY hash, id ORDER BY s), -1000000000) AS before FROM found)),
      merged AS (SELECT hash, id, path, min(s) AS s, max(e) AS e, sum(n)::BIGINT AS n FROM isles GROUP BY hash, id, path, isle),
      grp AS (SELECT hash{own}, first(n ORDER BY id, s) AS token_count, first(e - s + 1 ORDER BY id, s) AS line_count, first(path ORDER BY id, s) AS first_path, first(s ORDER BY id, s) AS first_line FROM merged GROUP BY hash{own_key} HAVING count(*) > 1),
      inst AS (SELECT m.id, m.path, m.s, m.e, g.* EXCLUDE (hash{own}), m.hash FROM merged m JOIN grp g ON m.hash = g.hash{" AND m.id = g.id" if within else ""})"""


def _duplicated(source: str, within: bool = False) -> str:
    """CTEs up to `dup` (id, d): the duplicated lines of each file, counted in group order, instances that overlap one counted left out."""
    return f"""{_duplicates(source, within)},
      x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_count DESC, first_path, first_line, hash, s, e) AS k FROM inst),
      walk AS (SELECT DISTINCT id, 0::BIGINT AS k, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]) AS taken, 0::BIGINT AS d FROM x
        UNION ALL SELECT w.id, x.k, CASE WHEN len(list_filter(taken, lambda t: x.s <= t.b AND x.e >= t.a)) > 0 THEN taken ELSE list_append(taken, {{'a': x.s::BIGINT, 'b': x.e::BIGINT}}) END,
          d + CASE WHEN len(list_filter(taken, lambda t: x.s <= t.b AND x.e >= t.a)) > 0 THEN 0 ELSE x.line_count END FROM walk w JOIN x ON x.id = w.id AND x.k = w.k + 1),
      dup AS (SELECT id, max(d) AS d FROM walk GROUP BY id)"""


def _share(source: str) -> str:
    return f"WITH RECURSIVE {_duplicated(source)} SELECT CASE WHEN count(*) = 0 THEN 0.0 ELSE coalesce((SELECT sum(d) FROM dup), 0) / count(*) * 100.0 END AS duplication_percentage FROM ll"


_COUNTED = {"python": ("if elif for while except finally", "and or"), "go": ("if for case default", "&& ||"), "typescript": ("if for while do case default catch", "&& || ? ?? ?."), "rust": ("if for while loop", "&& || ?"), "java": ("if for while do case default catch", "&& || ? ?? ?."),
            "dotnet": ("if elif for foreach while do case default catch when", "&& || ? ??"), "cpp": ("if else for while case catch", "&& ||"), "php": ("if elseif for foreach while do case default catch", "&& || ? ??"), "kotlin": ("if else for while case catch", "&& ||"), "ruby": ("if elsif unless for while until when rescue", "&& ||")}
_HEADS = {"python": "if elif for while", "go": "if for case default", "typescript": "if for while do case default", "rust": "if for while loop match", "java": "if for while do case default", "dotnet": "if elif for foreach while do case default", "cpp": "if else for while case", "php": "if elseif for foreach while do case default", "kotlin": "if else for while case", "ruby": "if elsif unless for while until when"}


def _times(text: str, what: str) -> str:
    return f"((length({text}) - length(replace({text}, {what}, ''))) // length({what}))"


def _functions() -> str:
    """CTEs up to `fn`: the functions of the code files with their metrics. Where they are and what they take is known from how the files are
    made; decisions, nesting, operators and operands are counted in their text. Each file has one function."""
    known = " UNION ALL ".join(
        f"SELECT p_partkey AS id, {FILE_PATH} AS path, '{'typescript' if k == 'javascript' else k}' AS language, replace('{x[1]}', '{{n}}', cast(p_size AS string)) AS name, {x[2].count('~') + 1} AS line_start, "
        f"{x[2].count('~') + x[3].count('~') + x[5].count('~')} + {x[4].count('~')} * (p_size % 8) AS line_end, {x[6]} AS parameter_count, {_body(x)} AS body FROM part WHERE p_partkey % 11 = {i}"
        for i, (k, x) in enumerate(CODE.items())
    )
    words = _values([(k, _list(w.split()), _list(o.split()), _list(_HEADS[k].split())) for k, (w, o) in _COUNTED.items()], "language, words, ops, heads")
    langs = sorted({*_COUNTED})
    lexed = _values([(k, "|".join([r"[A-Za-z_]\w*", *(re.escape(x) for x in SYMBOLS.get(k, COMMON)), r"[0-9][0-9.xXeE+\-bo_]*"]), _list(SYMBOLS.get(k, COMMON)), _list((OPERATOR_WORDS.get(k, OTHER_OPERATOR_WORDS) + " " + TYPE_WORDS.get(k, OTHER_TYPE_WORDS)).split())) for k in langs], "language, lexer, symbols, reserved")
    return f"""made AS ({known}), words AS (SELECT * FROM {words}), lexed AS (SELECT * FROM {lexed}),
      fl AS (SELECT id, language, n, lower(line) AS low, trim(line) AS text FROM (SELECT id, language, unnest(string_split(rtrim(body, chr(10)), chr(10))) AS line, generate_subscripts(string_split(rtrim(body, chr(10)), chr(10)), 1) AS n FROM made)),
      arms AS (SELECT id, count(*) AS arms FROM fl WHERE language = 'rust' AND contains(text, '=>') GROUP BY id),
      lm AS (SELECT fl.*, heads, len(list_filter(string_split_regex(low, '[^a-z]+'), lambda w: list_contains(words, w))) + len(regexp_extract_all(low, '(^|[^a-z])else if($|[^a-z])')) * CASE WHEN language IN ('python', 'cpp', 'kotlin', 'php', 'ruby') THEN 0 ELSE 1 END AS decisions,
          list_sum(list_transform(ops, lambda o: {_times('text', 'o')}))::BIGINT AS operators, CASE WHEN contains(low, 'match') THEN coalesce(arms, 0) ELSE 0 END AS arms,
          language NOT IN ('python', 'ruby') AND {_times('text', "'}'")} > {_times('text', "'{'")} AS ends FROM fl JOIN words USING (language) LEFT JOIN arms USING (id)),
      lh AS (SELECT *, NOT ends AND len(list_filter(heads, lambda h: starts_with(trim(low), h) OR contains(trim(low), concat(h, ' ')))) > 0 AS head FROM lm),
      nest AS (SELECT id, 0::BIGINT AS n, 0::BIGINT AS depth, 0::BIGINT AS deepest, 0::BIGINT AS total FROM made
        UNION ALL SELECT w.id, l.n, CASE WHEN head THEN depth + 1 WHEN ends AND depth > 0 THEN depth - 1 ELSE depth END, CASE WHEN head THEN greatest(deepest, depth + 1) ELSE deepest END,
          total + CASE WHEN head THEN greatest(depth, 1) + greatest(arms - 1, 0) ELSE 0 END + CASE WHEN (CASE WHEN head THEN depth + 1 WHEN ends AND depth > 0 THEN depth - 1 ELSE depth END) = 0 THEN operators ELSE 0 END
        FROM nest w JOIN lh l ON l.id = w.id AND l.n = w.n + 1),
      cog AS (SELECT id, max(deepest) AS max_nesting_depth, max(total) AS cognitive_complexity FROM nest GROUP BY id),
      cyc AS (SELECT id, 1 + sum(decisions + operators + arms) AS cyclomatic_complexity FROM lm GROUP BY id),
      tk AS (SELECT id, list_filter(t, lambda x: list_contains(symbols, x) OR list_contains(reserved, x)) AS op, list_filter(t, lambda x: NOT (list_contains(symbols, x) OR list_contains(reserved, x))) AS od FROM (SELECT id, symbols, reserved, regexp_extract_all(rtrim(body, chr(10)), lexer) AS t FROM made JOIN lexed USING (language))),
      hs AS (SELECT id, len(op)::BIGINT AS operators, len(od)::BIGINT AS operands, len(list_distinct(op))::BIGINT AS unique_operators, len(list_distinct(od))::BIGINT AS unique_operands FROM tk),
      hv AS (SELECT *, unique_operators + unique_operands AS vocabulary, operators + operands AS program_length, (operators + operands) * log2(unique_operators + unique_operands) AS volume, unique_operators / 2.0 * (operands / unique_operands) AS difficulty FROM hs),
      fn AS (SELECT id, path, language, 0 AS function_ord, name, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, CAST(line_end - line_start + 1 AS INTEGER) AS length, CAST(cyclomatic_complexity AS INTEGER) AS cyclomatic_complexity, CAST(cognitive_complexity AS INTEGER) AS cognitive_complexity,
          CAST(max_nesting_depth AS INTEGER) AS max_nesting_depth, parameter_count, operators, operands, unique_operators, unique_operands, vocabulary, program_length, volume, difficulty, volume * difficulty AS effort, volume * difficulty / 18.0 AS time_minutes, volume / 3000.0 AS bugs_estimate
        FROM made JOIN cyc USING (id) JOIN cog USING (id) JOIN hv USING (id))"""


def _shell_lines(source: str) -> str:
    """CTEs up to `shell` (id, path, line_number, content): what runs in a shell, found line by line with the open block's and list's indents."""
    keys = "run|script|before_script|after_script|bash|inlineScript"
    marks = "('|', '>', '|-', '>-', '|+', '>+')"
    return rf"""cl AS (SELECT id, path, line_number, content, trim(content) AS t, length(regexp_extract(content, '^(\s*)', 1)) AS ind,
        CASE WHEN starts_with(trim(content), '- ') THEN trim(substr(trim(content), 3)) END AS item FROM ({_lines(source)}) WHERE lower(path) LIKE '%.github/workflows/%' OR regexp_matches(lower(path), '(\.gitlab-ci\.yml|azure-pipelines\.ya?ml)$')),
      cm AS (SELECT *, CASE WHEN regexp_matches(coalesce(item, ''), '^\s*({keys})\s*:') THEN item ELSE t END AS bare FROM cl),
      cv AS (SELECT *, regexp_matches(bare, '^\s*({keys})\s*:') AS is_map, trim(regexp_extract(bare, '^\s*(?:{keys})\s*:(.*)$', 1)) AS val FROM cm),
      ci AS (SELECT DISTINCT id, path, 0::BIGINT AS line_number, CAST(NULL AS BIGINT) AS block, CAST(NULL AS BIGINT) AS lst, CAST(NULL AS VARCHAR) AS content FROM cv
        UNION ALL SELECT c.id, c.path, c.line_number,
          CASE WHEN w.block IS NOT NULL AND NOT (t <> '' AND ind <= w.block) THEN w.block WHEN (w.lst IS NOT NULL AND NOT (t <> '' AND ind <= w.lst) AND item IN {marks}) OR (NOT (w.lst IS NOT NULL AND NOT (t <> '' AND ind <= w.lst)) AND is_map AND val IN {marks}) THEN ind END,
          CASE WHEN w.block IS NOT NULL AND NOT (t <> '' AND ind <= w.block) THEN w.lst WHEN NOT (w.lst IS NOT NULL AND NOT (t <> '' AND ind <= w.lst)) AND is_map AND val = '' AND t IN ('script:', 'before_script:', 'after_script:') THEN ind WHEN w.lst IS NOT NULL AND NOT (t <> '' AND ind <= w.lst) THEN w.lst END,
          CASE WHEN w.block IS NOT NULL AND NOT (t <> '' AND ind <= w.block) THEN CASE WHEN strlen(c.content) > w.block + 2 THEN substr(c.content, w.block + 3) ELSE t END
            WHEN w.lst IS NOT NULL AND NOT (t <> '' AND ind <= w.lst) THEN CASE WHEN item IS NOT NULL AND item NOT IN {marks} AND item <> '' THEN item END
            WHEN is_map AND val NOT IN {marks} AND val <> '' THEN val END
        FROM ci w JOIN cv c ON c.id = w.id AND c.line_number = w.line_number + 1),
      shell AS (SELECT id, path, line_number, content FROM ci WHERE content IS NOT NULL)"""


def _chunks(source: str, most: int, size: int) -> str:
    """diff_id, chunk, n_bytes of greedily filled chunks: a walk over the lines."""
    return f"""WITH RECURSIVE l AS ({_lines(source)}),
      w AS (SELECT DISTINCT id, 0::BIGINT AS line_number, 0::BIGINT AS chunk, 0::BIGINT AS n, 0::BIGINT AS n_bytes FROM l
        UNION ALL SELECT w.id, l.line_number, CASE WHEN n_bytes > 0 AND (n >= {most} OR n_bytes + strlen(content) + 1 >= {size}) THEN chunk + 1 ELSE chunk END, CASE WHEN n_bytes > 0 AND (n >= {most} OR n_bytes + strlen(content) + 1 >= {size}) THEN 1 ELSE n + 1 END,
          CASE WHEN n_bytes > 0 AND (n >= {most} OR n_bytes + strlen(content) + 1 >= {size}) THEN 0 ELSE n_bytes END + strlen(content) + 1 FROM w JOIN l ON l.id = w.id AND l.line_number = w.line_number + 1)
      SELECT id AS diff_id, chunk, max(n_bytes) AS n_bytes FROM w WHERE line_number > 0 AND id IN (SELECT id FROM ({source}) WHERE {_TRIM.format("coalesce(content, '')")} <> '') GROUP BY id, chunk"""


def _fixed(issues: str) -> str:
    """Fixes of issues (file_path, line_start, rule_id, category, code_snippet), equal ones once."""
    rows = []
    for language, fixes in RuleBundle().fixes.items():
        for x in fixes:
            template = re.sub(r"\$\{?(\d+)\}?", r"\\\1", x["replaceTemplate"])
            rows.append((language, x["ruleId"], x["findPattern"], template, _Raw(str(float(x.get("confidence") or 0))), _Raw(str(bool(x.get("isSafe"))).upper()), len(x.get("breakingChanges") or [])))
    fixes = _values(rows, "language, rule_id, find, template, confidence, safe, breaking")
    return f"""SELECT DISTINCT concat(file_path, ':', line_start, ':', rule_id) AS issue_key, rule_id, regexp_replace(code_snippet, find, template) AS fixed_code, confidence::DOUBLE AS confidence, safe AND confidence >= 0.9 AND breaking = 0 AND category <> 'security' AS is_safe
      FROM ({issues}) i JOIN (SELECT * FROM {fixes}) x USING (rule_id) WHERE regexp_replace(code_snippet, find, template) <> code_snippet"""


_BUILD = (
    "CASE language WHEN 'dotnet' THEN concat('dotnet build', here, there, CASE WHEN own THEN '' ELSE concat('/', marker_file) END) WHEN 'typescript' THEN CASE WHEN own THEN 'npm run build' ELSE concat('npm run build --prefix ', root) END "
    "WHEN 'python' THEN concat('python -m compileall ', CASE WHEN own THEN '.' ELSE root END) WHEN 'go' THEN concat(CASE WHEN own THEN '' ELSE concat('cd ', root, ' && ') END, 'go build ./...') "
    "WHEN 'rust' THEN CASE WHEN own THEN 'cargo build' ELSE concat('cargo build --manifest-path ', root, '/Cargo.toml') END "
    "WHEN 'java' THEN CASE WHEN marker_file = 'pom.xml' THEN CASE WHEN own THEN 'mvn compile' ELSE concat('mvn -f ', root, '/pom.xml compile') END WHEN own THEN 'gradle build' ELSE concat('gradle -p ', root, ' build') END "
    "WHEN 'kotlin' THEN CASE WHEN own THEN 'gradle build' ELSE concat('gradle -p ', root, ' build') END "
    "WHEN 'cpp' THEN CASE WHEN marker_file = 'cmakelists.txt' THEN concat('cmake --build ', CASE WHEN own THEN '.' ELSE root END) WHEN own THEN 'make' ELSE concat('make -C ', root) END "
    "WHEN 'php' THEN CASE WHEN own THEN 'composer validate' ELSE concat('composer --working-dir ', root, ' validate') END WHEN 'ruby' THEN concat(CASE WHEN own THEN '' ELSE concat('cd ', root, ' && ') END, 'bundle exec rubocop') END"
)

_DIFF_LINES = f"SELECT row_number() OVER () AS id, path, line_number, content FROM ({_DIFF_ITEMS}) WHERE flag = 'A'"


def _tokens(kind: str, pattern: str, least: int, entropy: float, more: str = "TRUE", rows: str = "SELECT doc_id, text FROM documents") -> str:
    return f"SELECT doc_id, '{kind}' AS kind, token, round({_entropy('token')}, 6) AS entropy FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_q(pattern)})) AS token FROM ({rows})) WHERE strlen(token) >= {least} AND NOT regexp_matches(upper(token), {_q(_any(SECRET_PLACEHOLDERS))}) AND {_entropy('token')} >= {entropy} AND {more}"


def _stats(hits: str, dimensions: dict[str, str]) -> str:
    each = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {c} AS value, count(DISTINCT rule_id) AS rules, count(*) AS n FROM h GROUP BY {c}" for d, c in dimensions.items())
    return f"WITH h AS ({hits}) {each} UNION ALL SELECT 'total', '', count(DISTINCT rule_id), count(*) FROM h"


def oracle_sql() -> dict[str, str]:
    secret = _secret_hits(_SECRET_LINES)
    known = [k for k, *_ in ROTATION if k != "*"]
    rotation = _values([(k, name, severity, len(steps)) for k, name, _, _, severity, steps in ROTATION], "k, rotation_provider, rotation_severity, steps")
    not_repetitive = "NOT (strlen(token) >= 4 AND len(list_distinct(string_split(token, ''))) / strlen(token) < 0.2)"
    regexes = lambda patterns: "|".join(patterns)
    level = "CASE WHEN total_lines > 60 THEN 'error' ELSE 'warning' END"
    metrics_language = "CASE " + " ".join(f"WHEN lower(path) LIKE '%{s}' THEN '{lang}'" for s, lang in METRICS_SUFFIXES) + " ELSE 'unknown' END"
    s_rule = "CASE upper(s) WHEN 'BLOCKER' THEN 'critical' WHEN 'CRITICAL' THEN 'critical' WHEN 'MAJOR' THEN 'high' WHEN 'MINOR' THEN 'medium' WHEN 'INFO' THEN 'info' ELSE 'medium' END"
    s_known = "CASE WHEN lower(s) IN ('critical', 'high', 'medium', 'low') THEN lower(s) ELSE '{}' END"
    s_min = "CASE WHEN lower(s) IN ('critical', 'blocker') THEN 'critical' WHEN lower(s) IN ('high', 'major') THEN 'high' WHEN lower(s) IN ('medium', 'minor') THEN 'medium' WHEN lower(s) = 'low' THEN 'low' ELSE 'info' END"
    shown = "CASE WHEN kind = 'DUPLICATION' THEN printf('%.1f', {}) ELSE CAST(CAST(trunc({0}) AS BIGINT) AS VARCHAR) END".replace("{}", "{0}")
    limits = _values([(kind, *(_Raw(str(float(x))) for x in limit), error, warning) for (kind, _, error, warning), limit in zip(ALERTS, ((400, 1000), (10, 20), (5, 10), (300, 500), (10, 20), (15, 25), (50, 100), (4, 6)), strict=True)], "kind, warning_at, error_at, error_says, warning_says")
    out = {
        "file_length_alerts": f"SELECT 'FILE_LENGTH' AS metric_type, {level} AS level, path AS file_path, CAST(total_lines AS INTEGER) AS current_value, CASE WHEN total_lines > 60 THEN 60 ELSE 20 END AS threshold, "
        f"concat(CASE WHEN total_lines > 60 THEN 'File too long (' ELSE 'File is long (' END, total_lines, ' lines) exceeds ', {level}, ' threshold (', CASE WHEN total_lines > 60 THEN 60 ELSE 20 END, ')') AS message FROM ({_loc(_DOCS)}) WHERE total_lines > 20",
        "lines_of_documents": f"SELECT path, count(*) AS n_lines, sum(length(content))::BIGINT AS n_chars, max(strlen(content)) AS widest FROM ({_lines(_DOCS)}) GROUP BY path",
        "diff_added_lines": f"SELECT diff_id, path, line_number, content FROM ({_DIFF_ITEMS}) WHERE flag = 'A'",
        "diff_all_lines": f"SELECT diff_id, path, line_number, content FROM ({_DIFF_ITEMS}) WHERE flag <> 'R'",
        "ci_shell_lines": f"WITH RECURSIVE {_shell_lines(_CI_FILES)} SELECT path, line_number, content FROM shell",
        "ci_shell_issues": f"WITH RECURSIVE {_shell_lines(_CI_FILES)} SELECT rule_id, file_path, CAST(line_start AS INTEGER) AS line_start, severity, title, code_snippet FROM ({_code_hits('SELECT * FROM shell', "'shell'")})",
        "diff_chunk_sizes": _chunks("SELECT doc_id AS id, '' AS path, text AS content FROM documents", 50, 2000),
        "secret_catalog": f"SELECT rule_id, path AS file_path, severity, provider, matched_text, {_mask('matched_text')} AS masked_text, round({_confidence('matched_text', 'rule_entropy')}, 6) AS confidence FROM ({_secret_hits(_secret_catalog())})",
        "secrets_in_files": f"SELECT rule_id, path AS file_path, CAST(line_number AS INTEGER) AS line_number, severity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_number) AS n FROM ({_secret_hits('SELECT * FROM (' + _lines(_secret_files()) + ') WHERE NOT regexp_matches(path, ' + _q(regexes(SECRET_IGNORED)) + ') AND NOT contains(path, ' + _q('skip/') + ')')}) WHERE {_RANK} >= 3) WHERE n = 1",
        "iac_catalog": f"SELECT rule_id, path AS file_path, severity, iac_type, matched_pattern, source FROM ({_iac_hits(_iac_catalog())})",
        "iac_in_files": f"SELECT rule_id, path AS file_path, CAST(line_number AS INTEGER) AS line_number, severity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_number) AS n FROM ({_iac_hits('SELECT * FROM (' + _lines(_iac_files()) + ') WHERE NOT regexp_matches(path, ' + _q(regexes(IAC_IGNORED)) + ') AND NOT contains(path, ' + _q('skip/') + ')')})) WHERE n <= 2",
        "iac_file_issues": f"SELECT rule_id, severity, 'iac' AS category, title, description, source, count(*) AS issues FROM (SELECT *, message AS description FROM ({_iac_hits(_lines(_iac_files()))})) GROUP BY rule_id, severity, title, description, source",
        "ignored_globs": f"SELECT path, regexp_matches(path, '^src/gen/') OR path LIKE '%.min.js' OR path LIKE 'docs/%' OR regexp_matches(path, '^lib/[tz]') AS ignored FROM (SELECT DISTINCT {GLOB_PATH} AS path FROM lineitem)",
        "code_fixes": _fixed(_code_hits(_CODE_LINES)),
        "diff_analysis": f"SELECT 'static' AS source, category, severity, count(*) AS issues FROM (SELECT DISTINCT file_path, line_start, title, category, severity FROM ({_code_hits(_DIFF_LINES)})) GROUP BY category, severity UNION ALL SELECT 'secret-detection', 'secret', severity, count(*) FROM ({_secret_hits(_DIFF_LINES)}) GROUP BY severity",
        "function_metrics": f"WITH RECURSIVE {_functions()} SELECT * EXCLUDE (id) FROM fn",
        "file_metrics": f"WITH RECURSIVE {_functions()}, {_duplicated(_CODE_FILES, within=True)} SELECT fn.path AS file_path, language, total_lines AS lines, z.* EXCLUDE (path), 1::BIGINT AS n_functions, cyclomatic_complexity::DOUBLE AS average_complexity, coalesce(d / total_lines * 100.0, 0.0) AS duplication_percentage FROM fn JOIN ({_loc(_CODE_FILES)}) z ON z.path = fn.path LEFT JOIN dup ON dup.id = fn.id",
        "change_summary": f"WITH RECURSIVE {_functions()}, {_duplicated(_CODE_FILES)}, sizes AS (SELECT id, count(*) AS n FROM ll GROUP BY id) SELECT 300 AS total_lines_added, 45 AS total_lines_removed, (SELECT count(*) FROM part) AS total_files_changed, 'Medium' AS pr_size_category, max(cyclomatic_complexity) AS max_cyclomatic_complexity, "
        "avg(cyclomatic_complexity) AS avg_cyclomatic_complexity, max(cognitive_complexity) AS max_cognitive_complexity, avg(cognitive_complexity) AS avg_cognitive_complexity, max(length) AS max_function_length, avg(length) AS avg_function_length, max(max_nesting_depth) AS max_nesting_depth, "
        "(SELECT max(n)::INTEGER FROM sizes) AS max_file_length, (SELECT avg(n) FROM sizes) AS avg_file_length, coalesce((SELECT sum(d) FROM dup), 0) / (SELECT count(*) FROM ll) * 100.0 AS duplication_percentage FROM fn",
        "duplicate_blocks": f"WITH {_duplicates(_DOCS)} SELECT CAST(line_count AS INTEGER) AS line_count, token_count, n, count(*) AS n_groups FROM (SELECT hash, line_count, token_count, count(*) AS n FROM inst GROUP BY hash, line_count, token_count) GROUP BY line_count, token_count, n",
        "duplicate_blocks_as_written": f"WITH {_duplicates(_CODE_FILES, as_written=True)} SELECT hash, path, CAST(s AS INTEGER) AS line_start, CAST(e AS INTEGER) AS line_end, CAST(line_count AS INTEGER) AS line_count, token_count FROM inst",
        "duplicate_share": f"SELECT round(duplication_percentage, 6) AS duplication_percentage FROM ({_share(_DOCS)})",
        "threshold_alerts": f"SELECT kind AS metric_type, CASE WHEN value > error_at THEN 'error' ELSE 'warning' END AS level, file_path, function_name, line_number, CAST(trunc(value) AS INTEGER) AS current_value, CAST(CASE WHEN value > error_at THEN error_at ELSE warning_at END AS INTEGER) AS threshold, "
        f"concat(replace(replace(CASE WHEN value > error_at THEN error_says ELSE warning_says END, '{{v}}', {shown.format('value')}), '{{f}}', coalesce(function_name, '')), ' exceeds ', CASE WHEN value > error_at THEN 'error' ELSE 'warning' END, ' threshold (', {shown.format('CASE WHEN value > error_at THEN error_at ELSE warning_at END')}, CASE WHEN kind = 'DUPLICATION' THEN '%)' ELSE ')' END) AS message "
        f"FROM (SELECT {MEASURE_KIND} AS kind, {MEASURE} AS value, concat('f', l_partkey) AS file_path, CASE WHEN l_orderkey % 8 >= 4 THEN concat('fn', l_suppkey % 7) END AS function_name, CAST(l_linenumber AS INTEGER) AS line_number FROM lineitem) JOIN (SELECT * FROM {limits}) USING (kind) WHERE value > warning_at",
        "text_functions": f"SELECT c_custkey, regexp_matches(upper(token), {_q(_any(SECRET_PLACEHOLDERS))}) AS placeholder, strlen(token) >= 4 AND len(list_distinct(string_split(token, ''))) / strlen(token) < 0.2 AS repetitive, {_mask('token')} AS masked, "
        f"round({_entropy('token')}, 6) AS entropy, round({_confidence('token', 'CASE WHEN c_custkey % 3 = 0 THEN 4.5 END')}, 6) AS confidence, regexp_matches(token, {_q(regexes(GLOBAL_ALLOWLIST))}) AS allowlisted FROM (SELECT c_custkey, {TOKEN} AS token FROM customer)",
        "path_functions": f"SELECT path, {_TRAVERSAL} AS traversal, regexp_matches(path, {_q(regexes(SECRET_IGNORED))}) AS secret_ignored, regexp_matches(path, {_q(regexes(IAC_IGNORED))}) AS iac_ignored, {_iac_type()} AS iac_type, {metrics_language} AS metrics_language, "
        f"{_SOURCE_LANGUAGE} AS source_language, {_MARKER} AS marker_language, lower(path) LIKE '%.github/workflows/%' OR regexp_matches(lower(path), '(\\.gitlab-ci\\.yml|azure-pipelines\\.ya?ml)$') AS ci FROM ({_PATHS})",
        "severity_functions": f"SELECT DISTINCT s, {s_rule} AS of_rule, {s_known.format('high')} AS of_secret, {s_known.format('medium')} AS of_iac, {s_min} AS minimum, CASE {s_min} WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END AS rank FROM (SELECT {SEVERITY} AS s FROM orders)",
        "secrets_in_lines": f"SELECT rule_id, path AS file_path, severity, provider, matched_text, {_mask('matched_text')} AS masked_text, round({_confidence('matched_text', 'rule_entropy')}, 6) AS confidence FROM ({secret})",
        "secrets_in_diff": f"SELECT rule_id, path AS file_path, line_number, severity, provider, {_mask('matched_text')} AS masked_text FROM ({_secret_hits('SELECT * FROM (' + _SECRET_LINES + ') WHERE NOT ' + _TRAVERSAL + ' AND NOT regexp_matches(path, ' + _q(regexes(SECRET_IGNORED)) + ') AND NOT contains(path, ' + _q('secret/skip') + ')')}) WHERE {_RANK} >= 4 AND rule_id <> 'SEC-GH-001'",
        "secrets_in_documents": f"SELECT rule_id, path AS file_path, CAST(line_number AS INTEGER) AS line_number, severity, {_mask('matched_text')} AS masked_text, round({_confidence('matched_text', 'rule_entropy')}, 6) AS confidence FROM ({_secret_hits(_lines(_DOCS))})",
        "secret_rule_stats": _stats(_secret_hits(_secret_catalog()), {"provider": "provider", "severity": "severity"}),
        "secrets_with_allowlist": f"SELECT rule_id, path AS file_path, matched_text FROM ({_secret_hits(_SECRET_LINES, OWN_RULES)})",
        "secrets_in_tree": f"SELECT {TREE_FOLDER} AS folder, rule_id, severity, count(*) AS findings FROM (SELECT *, id AS file_ord FROM ({_secret_hits('SELECT * FROM (' + _secret_catalog() + ') WHERE NOT contains(content, chr(10))')})) WHERE {TREE_FOLDER} NOT IN ('skip', 'node_modules') GROUP BY ALL",
        "secret_issues": f"SELECT rule_id, severity, 'secret' AS category, 'secret-detection' AS source, count(*) AS issues, count(DISTINCT concat(message, {_mask('matched_text')})) AS descriptions FROM ({secret}) GROUP BY rule_id, severity",
        "secret_rotation": f"SELECT provider, rotation_provider, rotation_severity, count(*) AS findings, max(steps) AS steps FROM (SELECT *, CASE WHEN lower(provider) = 'google' THEN 'gcp' WHEN lower(provider) IN ({', '.join(map(_q, known))}) THEN lower(provider) ELSE '*' END AS k FROM ({secret})) JOIN (SELECT * FROM {rotation}) USING (k) GROUP BY provider, rotation_provider, rotation_severity",
        "entropy_tokens": " UNION ALL ".join((_tokens("token", ENTROPY_TOKEN, 20, 4.0), _tokens("base64", BASE64, 40, 5.0), _tokens("hex", HEX, 32, 3.8, not_repetitive))),
        "iac_in_lines": f"SELECT rule_id, path AS file_path, line_number, severity, iac_type, matched_pattern, source FROM ({_iac_hits(_IAC_LINES)})",
        "iac_in_diff": f"SELECT rule_id, path AS file_path, line_number, severity, iac_type FROM ({_iac_hits(_IAC_LINES)}) WHERE iac_type IN ('dockerfile', 'terraform') AND {_RANK} >= 4",
        "iac_rule_stats": _stats(_iac_hits(_iac_catalog()), {"type": "iac_type", "severity": "severity", "source": "source"}),
        "rule_metadata": "WITH e AS (SELECT p_partkey AS source_ord, 'alpha' AS language, 3 AS c, 'code_smells' AS category, concat('R', p_partkey % 53) AS rule_id, 'smell' AS name, NULL AS severity, '' AS cwe FROM part "
        "UNION ALL SELECT p_partkey, concat('lang', p_partkey % 3), 0, 'vulnerabilities', concat('R', p_partkey % 97), CASE WHEN p_size % 3 = 0 THEN concat('n', p_partkey) END, CASE WHEN p_size % 2 = 0 THEN 'MINOR' END, 'CWE-1,CWE-2' FROM part "
        "UNION ALL SELECT p_partkey, concat('lang', p_partkey % 3), 2, 'bugs', concat('B', p_partkey % 31), NULL, NULL, '' FROM part) "
        "SELECT rule_id, coalesce(name, rule_id) AS name, coalesce(severity, 'MAJOR') AS severity, cwe, source_ord, language, category FROM e QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY source_ord, language, c) = 1",
        "rule_patterns": "WITH e AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'py' WHEN 1 THEN 'Python' WHEN 2 THEN 'js' WHEN 3 THEN 'typescript' ELSE 'k8s' END AS key, p_size FROM part WHERE p_size % 7 <> 0), "
        "l AS (SELECT *, CASE lower(key) WHEN 'py' THEN 'python' WHEN 'js' THEN 'typescript' WHEN 'k8s' THEN 'kubernetes' ELSE lower(key) END AS language FROM e), k AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY language ORDER BY p_partkey DESC) = 1) "
        "SELECT language, 0 AS rule_ord, concat('P', p_partkey) AS rule_id, 'Vulnerability' AS category, 'x+ y' AS patterns, 'm' AS message, NULL AS suggestion FROM k UNION ALL SELECT language, 1, concat('Q', p_partkey), 'Bug', 'z', 'n', 'fix it' FROM k",
        "leak_rule_import": "WITH e AS (SELECT *, concat(CASE p_partkey % 4 WHEN 0 THEN 'aws-' WHEN 1 THEN 'Test-' WHEN 2 THEN 'plain-' ELSE 'gitlab-private-' END, p_partkey) AS id FROM part), "
        "i AS (SELECT concat('SEC-GL-', upper(id)) AS rule_id, concat('gitleaks/', id) AS external_id, CASE p_size % 4 WHEN 0 THEN 'a(b' WHEN 1 THEN 'p/q' ELSE concat('r', p_size) END AS patterns, CASE p_partkey % 4 WHEN 1 THEN 'low' WHEN 2 THEN 'high' ELSE 'critical' END AS severity, "
        f"CASE WHEN p_size % 5 = 0 THEN 'tagged' ELSE 'generic' END AS provider, CASE p_partkey % 4 WHEN 0 THEN {_q(IMPORT_SUGGESTIONS[0][1])} WHEN 3 THEN {_q(IMPORT_SUGGESTIONS[2][1])} ELSE {_q(DEFAULT_SUGGESTION)} END AS suggestion, CASE WHEN p_size % 2 = 0 THEN 3.5 END AS entropy, 'k1,k2' AS keywords FROM e WHERE p_size % 4 <> 2), "
        "b AS (SELECT concat('BASE-', s_suppkey) AS rule_id, concat('gitleaks/aws-', s_suppkey) AS external_id, 'x' AS patterns, 'low' AS severity, 'base' AS provider, 'none' AS suggestion, NULL::DOUBLE AS entropy, 'k' AS keywords FROM supplier) "
        "SELECT *, CASE WHEN patterns = 'a(b' THEN concat('bad pattern ', chr(39), 'a(b', chr(39)) END AS fault FROM (SELECT * FROM b UNION ALL SELECT * FROM i WHERE external_id NOT IN (SELECT external_id FROM b))",
        "rule_file_choice": "SELECT file, source_ord, text FROM (SELECT concat('f', l_partkey) AS file, l_orderkey * 10 + l_linenumber AS source_ord, concat('t', l_suppkey) AS text FROM lineitem WHERE l_orderkey % 3 <> 0) QUALIFY row_number() OVER (PARTITION BY file ORDER BY source_ord) = 1",
        "fix_order": "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 5 = 0, CASE WHEN l_partkey % 5 <> 0 THEN l_discount END DESC, l_linenumber) AS INTEGER) AS place FROM lineitem",
        "inline_comments": f"SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN concat('x = ', o_orderkey, ' ') WHEN 1 THEN 's = \"a // b\" ' WHEN 4 THEN 'k ' ELSE {COMMENTED} END AS code FROM orders",
        "entropy_in_lines": " UNION ALL ".join((_tokens("token", ENTROPY_TOKEN, 20, 4.5, rows=_ENTROPY_LINES), _tokens("base64", BASE64, 40, 5.0, rows=_ENTROPY_LINES), _tokens("hex", HEX, 32, 3.8, not_repetitive, _ENTROPY_LINES))),
        "code_issues": f"SELECT rule_id, file_path, line_start, severity, category, title, description, code_snippet FROM ({_code_hits(_CODE_LINES)})",
        "code_issues_ranked": f"SELECT rule_id, file_path, line_start, severity, title FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line_start, title ORDER BY {_RANK} DESC, id, rule_ord) AS n FROM ({_code_hits(_CODE_LINES)}) WHERE {_RANK} >= 4 AND rule_id <> 'PY-SHELL') WHERE n = 1 ORDER BY {_RANK} DESC, file_path, line_start, id, rule_ord LIMIT 100",
        "document_loc": _loc(_DOCS),
        "code_loc": _loc(_CODE_FILES),
        "pr_sizes": "SELECT l_suppkey AS change, CASE WHEN n % 1500 <= 50 THEN 'XS' WHEN n % 1500 <= 200 THEN 'Small' WHEN n % 1500 <= 400 THEN 'Medium' WHEN n % 1500 <= 1000 THEN 'Large' ELSE 'XL' END AS size FROM (SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY l_suppkey)",
        "project_list": _PROJECTS,
        "project_languages": f"SELECT language, CAST(priority AS INTEGER) AS priority FROM ({_LANGUAGES})",
        "project_targets": _TARGETS,
        "project_builds": f"SELECT language, root AS path, {_BUILD} AS command FROM (SELECT *, root IN ('', '.') AS own, '' AS here, CASE WHEN root IN ('', '.') THEN '' ELSE concat(' ', root) END AS there FROM ({_PROJECTS})) WHERE {_BUILD} IS NOT NULL",
        "project_profile": f"SELECT arg_min(language, priority) AS primary_language, (SELECT count(*) FROM (SELECT language FROM ({_LANGUAGES}) UNION SELECT key FROM ({_TARGETS}))) > 1 AS is_polyglot, (SELECT CASE count(*) WHEN 0 THEN 'unknown' WHEN 1 THEN min(k) ELSE 'polyglot' END FROM (SELECT language AS k FROM ({_LANGUAGES}) UNION SELECT key FROM ({_TARGETS}))) AS label, string_agg(language, ',' ORDER BY priority) AS languages, "
        f"(SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT language AS k FROM ({_LANGUAGES}) UNION SELECT key FROM ({_TARGETS}))) AS target_keys FROM ({_LANGUAGES})",
    }
    return out
