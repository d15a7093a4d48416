"""Rule catalogs: the built-in tables, JSON files, rule bundles with precedence, and imports of leak-scanner configurations.

Catalogs are small and live on the driver; `rule_frame` turns one into a DataFrame that plans broadcast.
"""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Names the directory of rule bundles.
RULES_DIR_VARIABLE = "LUMENSCAN_RULES_DIR"
HOME = Path(__file__).parent
BUNDLE_FILES = ("AllRules.json", "DetectionPatterns.json", "CodeAnalysisRules.json", "LanguagePrompts.json", "AutoFixPatterns.json")


class CatalogError(ValueError):
    """A catalog that cannot be used."""


@dataclass
class SecretRule:
    rule_id: str
    external_id: str
    title: str
    message: str
    severity: str
    patterns: list[str]
    provider: str
    keywords: list[str] = field(default_factory=list)
    suggestion: str | None = None
    allowlist_patterns: list[str] = field(default_factory=list)
    entropy: float | None = None


@dataclass
class IacRule:
    rule_id: str
    external_id: str
    title: str
    message: str
    severity: str
    patterns: list[str]
    iac_type: str
    suggestion: str | None = None
    source: str = "builtin-iac"
    cwe_id: str | None = None


def _table(path: Path, kind: type) -> list:
    with path.open(encoding="utf-8") as f:
        rows = [line.rstrip("\n").split("\t") for line in f if not line.startswith("#")]
    out = []
    for row in rows[1:]:
        x = dict(zip(rows[0], row, strict=True))
        for name in ("patterns", "keywords", "allowlist_patterns"):
            if name in x:
                x[name] = json.loads(x[name])
        x = {k: None if v == "" else v for k, v in x.items()}
        if x.get("entropy") is not None:
            x["entropy"] = float(x["entropy"])
        out.append(kind(**x))
    return out


def builtin_secret_rules() -> list[SecretRule]:
    return _table(HOME / "secret_rules.tsv", SecretRule)


def builtin_iac_rules() -> list[IacRule]:
    return _table(HOME / "iac_rules.tsv", IacRule)


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.title() for x in rest)


def _from_json(kind: type, item: dict):
    names = {f.name for f in fields(kind)}
    known = {_camel(n): n for n in names} | {n: n for n in names}
    return kind(**{known[k]: v for k, v in item.items() if k in known})


def load_rules(path: str | Path, kind: type) -> list:
    """A JSON array of rules."""
    return [_from_json(kind, x) for x in json.loads(Path(path).read_text(encoding="utf-8"))]


def save_rules(rules: list, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    items = [{_camel(k): v for k, v in asdict(r).items()} for r in rules]
    Path(path).write_text(json.dumps(items, indent=2, ensure_ascii=False), encoding="utf-8")


# --- imports of leak-scanner configurations ---

#: An imported rule whose id holds one of these is critical.
CRITICAL_WORDS = ("aws", "github", "gitlab", "stripe", "slack", "private", "secret", "password", "token", "api-key", "credential", "auth")
#: The suggestion of an imported rule by what its id holds, first hit first.
IMPORT_SUGGESTIONS = (
    (("aws",), "Remove the key from code and rotate it immediately. Use AWS Secrets Manager or environment variables."),
    (("github",), "Revoke this token immediately in GitHub Settings > Developer settings."),
    (("gitlab",), "Revoke this token in GitLab User Settings > Access Tokens."),
    (("private", "key"), "Remove this private key immediately and generate a new key pair."),
    (("password", "secret"), "Never hardcode passwords or secrets. Use environment variables."),
)
DEFAULT_SUGGESTION = "Remove this secret from the code and rotate it immediately. Use environment variables or a secrets manager."


def parse_leak_config(text: str, suffix: str = "") -> dict:
    """TOML or JSON, by suffix, else whichever parses."""
    if suffix.lower() != ".json":
        try:
            return tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            if suffix.lower() == ".toml":
                raise CatalogError(f"not TOML: {e}") from None
    try:
        return json.loads(text)
    except json.JSONDecodeError as e:
        raise CatalogError(f"neither TOML nor JSON: {e}") from None


def imported_severity(rule_id: str) -> str:
    low = rule_id.lower()
    if any(w in low for w in CRITICAL_WORDS):
        return "critical"
    return "low" if "test" in low or "example" in low else "high"


def imported_suggestion(rule_id: str) -> str:
    low = rule_id.lower()
    return next((text for words, text in IMPORT_SUGGESTIONS if any(w in low for w in words)), DEFAULT_SUGGESTION)


def import_leak_rules(config: dict) -> list[SecretRule]:
    """A rule without regex uses its path as one; without either it is left out."""
    out = []
    for r in config.get("rules", []):
        pattern = r.get("regex") or r.get("path")
        if not pattern:
            continue
        said = r.get("description", "")
        out.append(SecretRule(
            f"SEC-GL-{r['id'].upper()}", f"gitleaks/{r['id']}", said, f"A {said} was detected.", imported_severity(r["id"]), [pattern], (r.get("tags") or ["generic"])[0],
            r.get("keywords") or [], imported_suggestion(r["id"]), (r.get("allowlist") or {}).get("regexes", []), r.get("entropy"),
        ))
    return out


def merged_rules(imported: list[SecretRule], base: list[SecretRule] | None = None) -> list[SecretRule]:
    """The base rules, then those imported whose external id is new."""
    base = builtin_secret_rules() if base is None else base
    known = {r.external_id for r in base}
    return [*base, *(r for r in imported if r.external_id not in known)]


def validate(patterns: list[str]) -> None:
    for p in patterns:
        try:
            re.compile(python_regex(p))
        except re.error as e:
            raise CatalogError(f"bad pattern {p!r}: {e}") from None


def secret_rules(leak_config: str | Path | None = None, cache_file: str | Path | None = None, fallback: bool = True) -> list[SecretRule]:
    """Leak-scanner configuration, else cache file, else the built-in rules; what cannot be read is passed over."""
    if leak_config and Path(leak_config).exists():
        try:
            return merged_rules(import_leak_rules(parse_leak_config(Path(leak_config).read_text(encoding="utf-8"), Path(leak_config).suffix)))
        except (CatalogError, OSError, KeyError):
            pass
    if cache_file and Path(cache_file).exists():
        try:
            return load_rules(cache_file, SecretRule)
        except (OSError, ValueError, TypeError):
            pass
    if not fallback:
        raise CatalogError("no secret rules: nothing to read, and the built-in ones are switched off")
    return builtin_secret_rules()


def iac_rules(cache_file: str | Path | None = None, fallback: bool = True) -> list[IacRule]:
    if cache_file and Path(cache_file).exists():
        try:
            return load_rules(cache_file, IacRule)
        except (OSError, ValueError, TypeError):
            pass
    if not fallback:
        raise CatalogError("no infrastructure rules: nothing to read, and the built-in ones are switched off")
    return builtin_iac_rules()


# --- regular expressions: one dialect in, two out ---


def _anchored(pattern: str, end: str) -> str:
    """`$` means the end of the text only; in other dialects it also matches before a last line break."""
    if re.match(r"\(\?[a-z]*m", pattern):
        return pattern
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        in_class = c == "[" or (in_class and c != "]")
        out.append(end if c == "$" and not in_class else c)
        i += 1
    return "".join(out)


def java_regex(pattern: str) -> str:
    """For Spark: Unicode classes and cases, as rules are written for."""
    return "(?U)" + _anchored(pattern, r"\z")


def python_regex(pattern: str) -> str:
    """For Python, which has no `(?-i)` in the middle: the part before it gets a scoped flag."""
    found = re.match(r"\(\?i\)(.*)\(\?-i\)(.*)\Z", pattern, re.S)
    return _anchored(f"(?i:{found[1]}){found[2]}" if found else pattern, r"\Z")


def min_width(pattern: str) -> int:
    """No shorter text can match."""
    import re._parser as parser

    try:
        return int(parser.parse(python_regex(pattern)).getwidth()[0])
    except re.error:
        return 0


def rule_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- rule bundles ---

#: Language keys that mean another one.
LANGUAGE_ALIASES = {
    "ts": "typescript", "javascript": "typescript", "js": "typescript", "c#": "csharp", "py": "python", "golang": "go", "rs": "rust", "c++": "cpp", "c": "cpp", "cc": "cpp",
    "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "docker": "dockerfile", "compose": "docker-compose", "k8s": "kubernetes", "tf": "terraform", "yml": "yaml",
    "github_workflows": "github-actions", "gitlabci": "gitlab-ci", "azure": "azure-pipelines", "azure_pipelines": "azure-pipelines", "secret": "generic", "secrets": "generic",
}
#: Categories of rule metadata and of detection patterns, in order.
META_CATEGORIES = ("vulnerabilities", "security_hotspots", "bugs", "code_smells", "react")
PATTERN_CATEGORIES = {"vulnerabilities": "Vulnerability", "securityHotspots": "SecurityHotspot", "bugs": "Bug", "codeSmells": "CodeSmell", "react": "React"}
#: Keys of a pattern file that are no language.
NOT_LANGUAGES = ("$schema", "version", "description", "lastUpdated", "totalPatterns", "source", "totalRules", "statistics")


def language_key(language: str) -> str:
    low = language.lower()
    return LANGUAGE_ALIASES.get(low, low)


def resolved_rules_dir() -> Path | None:
    custom = os.environ.get(RULES_DIR_VARIABLE, "").strip()
    if custom:
        return Path(custom)
    try:
        return Path.home() / ".lumenscan" / "rules"
    except RuntimeError:
        return Path.cwd() / ".lumenscan" / "rules"


class RuleBundle:
    """Metadata, detection patterns, languages and fixes; each file from the directory, its cache folder or the built-in bundle."""

    def __init__(self, directory: str | Path | None = None):
        self.directory = Path(directory) if directory else None
        every, patterns, self.analysis, prompts, fixes = (self._read(n) for n in BUNDLE_FILES)
        if not isinstance(every.get("version"), str):
            raise CatalogError("the rules file has no version")
        self.version = every["version"]
        self.meta = self._meta(every)
        self.patterns = self._patterns(patterns)
        self.extensions, self.file_names = self._languages(prompts)
        self.fixes = {language_key(k): v for k, v in sorted((fixes.get("patterns") or {}).items()) if isinstance(v, list)}

    def reload(self) -> RuleBundle:
        return RuleBundle(self.directory)

    def _read(self, name: str) -> dict:
        places = [self.directory / name, self.directory / "cache" / name] if self.directory else []
        path = next((p for p in places if p.exists()), HOME / "bundle" / name)
        return json.loads(path.read_text(encoding="utf-8"))

    @staticmethod
    def _meta(every: dict) -> dict[str, dict]:
        out: dict[str, dict] = {}
        for _, language in sorted((k, v) for k, v in every.items() if isinstance(v, dict)):
            for category in META_CATEGORIES:
                for x in language.get(category) or []:
                    if isinstance(x.get("id"), str):  # the first of an id stays
                        out.setdefault(x["id"], {"name": x.get("name") or x["id"], "severity": x.get("severity") or "MAJOR", "cwe": x.get("cwe") or [], "owasp_top10": x.get("owaspTop10") or [], "owasp_asvs": x.get("owaspAsvs") or [], "compliance_standards": x.get("complianceStandards") or [], "canonical_category": x.get("canonicalCategory"), "canonical_subcategory": x.get("canonicalSubcategory")})
        return out

    @staticmethod
    def _patterns(raw: dict) -> dict[str, list[dict]]:
        out: dict[str, list[dict]] = {}
        for key, value in sorted((k, v) for k, v in raw.items() if k not in NOT_LANGUAGES and isinstance(v, dict)):
            try:
                rules = [{"rule_id": x["ruleId"], "category": c, "patterns": list(x["patterns"]), "message": x["message"], "suggestion": x.get("suggestion")} for k, c in PATTERN_CATEGORIES.items() for x in value.get(k) or []]
            except (KeyError, TypeError):
                continue  # a malformed language is passed over
            out[language_key(key)] = rules  # the last of a language stays
        return out

    @staticmethod
    def _languages(prompts: dict) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
        extensions: dict[str, list[str]] = {}
        names: dict[str, list[str]] = {}
        for key, x in sorted((prompts.get("languages") or {}).items()):
            for target, values in ((extensions, x.get("fileExtensions") or []), (names, x.get("fileNames") or [])):
                own = target.setdefault(language_key(key), [])
                own += [v for v in values if v.lower() not in {o.lower() for o in own}]
        return extensions, names

    def find_rule(self, rule_id: str) -> dict | None:
        return self.meta.get(rule_id)

    def pattern_languages(self) -> list[str]:
        return sorted(self.patterns)

    def patterns_for(self, language: str) -> list[dict]:
        low = language.lower()
        return self.patterns.get("typescript" if low in ("javascript", "js") else LANGUAGE_ALIASES.get(low, low), [])

    def fixes_for(self, language: str, rule_id: str) -> list[dict]:
        return [x for x in self.fixes.get(language_key(language), []) if x.get("ruleId") == rule_id]
