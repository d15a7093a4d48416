"""Secret detection: at most one finding a line, the first accepted match in rule and pattern order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenscan.catalog.loader import DEFAULT_SUGGESTION, SecretRule, builtin_secret_rules, java_regex, min_width
from lumenscan.functions.paths import SECRET_IGNORED, any_regex, is_traversal, matches_ignore
from lumenscan.functions.text import confidence, entropy, is_allowlisted, is_placeholder, is_repetitive, known_severity, masked, severity_rank
from lumenscan.operators.matching import longest_keyword, tested
from lumenscan.sources.files import directory, lines


@dataclass
class ScanOptions:
    ignore_paths: list[str] = field(default_factory=list)
    max_findings: int | None = None
    minimum_severity: str = "low"
    include_rules: list[str] = field(default_factory=list)
    exclude_rules: list[str] = field(default_factory=list)
    iac_types: list[str] = field(default_factory=list)


RULE_DDL = (
    "pattern_no int, rule_id string, title string, message string, severity string, provider string, suggestion string, keyword string, "
    "pattern string, width int, allowlist string, rule_entropy double"
)


def rule_patterns(spark: SparkSession, rules: list[SecretRule]) -> tuple[DataFrame, list[str]]:
    """A row for each pattern of each rule and each keyword that, found in a line, tells that the line holds one of the rule's own (the
    empty keyword for rules without): some hundred rows, which plans broadcast. Also the patterns by their number, in order of rules."""
    words = {k.lower() for r in rules for k in r.keywords}
    rows, patterns = [], []
    for r in rules:
        own = {k.lower() for k in r.keywords}
        told_by = {""} if not own or "" in own else {w for w in words if any(w.startswith(k) for k in own)}
        allow = "|".join(f"(?:{java_regex(p)})" for p in r.allowlist_patterns) or None
        for p in r.patterns:
            for k in sorted(told_by):
                rows.append((len(patterns), r.rule_id, r.title, r.message, r.severity, r.provider, r.suggestion or DEFAULT_SUGGESTION, k, java_regex(p), min_width(p), allow, r.entropy))
            patterns.append(java_regex(p))
    return spark.createDataFrame(rows, RULE_DDL), patterns


def line_matches(line_rows: DataFrame, rules: list[SecretRule] | None = None) -> DataFrame:
    """The first accepted match of each line. One pattern finds the longest keyword at each place of a line; those found are joined with
    the broadcast rules by equality, and a rule's own pattern is tried only then. Only the hits, which are few, are shuffled."""
    rules = builtin_secret_rules() if rules is None else rules
    table, patterns = rule_patterns(line_rows.sparkSession, rules)
    words = {k.lower() for r in rules for k in r.keywords} - {""}
    found = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(longest_keyword(words)), F.lit(1))) if words else F.array().cast("array<string>")
    bare = [min_width(p) for r in rules if not r.keywords or "" in r.keywords for p in r.patterns]
    if bare:  # rules without keywords need a line of their least length
        found = F.when(F.octet_length("content") >= min(bare), F.array_append(found, F.lit(""))).otherwise(found)
    text = F.expr("regexp_extract(content, pattern, 0)")
    allowed = F.col("allowlist").isNotNull() & F.coalesce(F.expr("regexp_extract(content, pattern, 0) rlike allowlist"), F.lit(False))
    accepted = ~allowed & ~is_allowlisted(text) & ~is_placeholder(text) & ~is_repetitive(text)
    pairs = line_rows.select("file_ord", "path", "line_number", "content", F.explode(found).alias("keyword")).join(F.broadcast(table), "keyword")
    # nested cases, not a conjunction: the optimizer would move the costly tests of a conjunction to the front
    matches = F.when(tested(F.col("pattern_no"), F.col("content"), patterns), accepted).otherwise(False)
    hits = pairs.filter(F.when(F.octet_length("content") >= F.col("width"), matches).otherwise(False)).withColumn("matched_text", text)
    first = F.min_by(F.struct("rule_id", "title", "message", "severity", "provider", "suggestion", "matched_text", "rule_entropy"), "pattern_no").alias("x")
    return hits.groupBy("file_ord", "path", "line_number").agg(first).select("file_ord", "path", "line_number", "x.*")


def finding_rows(matches: DataFrame) -> DataFrame:
    return matches.select(
        "file_ord", "rule_id", F.col("path").alias("file_path"), F.col("line_number").cast("int").alias("line_number"), "matched_text", masked(F.col("matched_text")).alias("masked_text"),
        known_severity(F.col("severity"), "high").alias("severity"), "title", "message", "suggestion", "provider", confidence(F.col("matched_text"), F.col("rule_entropy")).alias("confidence"),
    )


def selected(findings: DataFrame, options: ScanOptions) -> DataFrame:
    """Severity and rule filters; they come after the first match, so leaving a rule out reveals no other on its line."""
    out = findings.filter(severity_rank(F.col("severity")) >= severity_rank(F.lit(options.minimum_severity)))
    if options.include_rules:
        out = out.filter(F.col("rule_id").isin(options.include_rules))
    return out.filter(~F.col("rule_id").isin(options.exclude_rules)) if options.exclude_rules else out


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc(severity_rank(F.col("severity"))), "file_path", "line_number", "file_ord")


def first_findings(findings: DataFrame, most: int | None, each_file: bool) -> DataFrame:
    """The first ones in scan order, of all files together or of each."""
    if most is None:
        return findings
    if not each_file:
        return findings.orderBy("file_ord", "line_number").limit(most)
    order = Window.partitionBy("file_ord").orderBy("line_number")
    return findings.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n")


def scannable(path: Column, options: ScanOptions, ignored: tuple[str, ...]) -> Column:
    return ~matches_ignore(path, options.ignore_paths) & ~any_regex(path, ignored)


def scan_lines(line_rows: DataFrame, options: ScanOptions | None = None, rules: list[SecretRule] | None = None) -> DataFrame:
    """Added lines of a diff (file_ord, path, line_number, content): no traversal, no ignored paths; max_findings for all files together."""
    options = options or ScanOptions()
    path = F.col("path")
    rows = line_rows.filter("content is not null").filter(~is_traversal(path) & scannable(path, options, SECRET_IGNORED))
    return by_severity(first_findings(selected(finding_rows(line_matches(rows, rules)), options), options.max_findings, each_file=False)).drop("file_ord")


def scan_contents(file_rows: DataFrame, options: ScanOptions | None = None, rules: list[SecretRule] | None = None) -> DataFrame:
    """Whole contents, whatever their path; max_findings for each file."""
    options = options or ScanOptions()
    found = selected(finding_rows(line_matches(lines(file_rows), rules)), options)
    return by_severity(first_findings(found, options.max_findings, each_file=True)).drop("file_ord")


def scan_files(file_rows: DataFrame, options: ScanOptions | None = None, rules: list[SecretRule] | None = None) -> DataFrame:
    """Files as read from a directory: ignored paths are passed over."""
    options = options or ScanOptions()
    return scan_contents(file_rows.filter(scannable(F.col("path"), options, SECRET_IGNORED)), options, rules)


def scan_directory(spark: SparkSession, folder: str, options: ScanOptions | None = None, rules: list[SecretRule] | None = None, max_files: int | None = None) -> DataFrame:
    """The files below a folder; ignored ones are never opened."""
    options = options or ScanOptions()
    return scan_contents(directory(spark, folder, max_files, SECRET_IGNORED, options.ignore_paths), options, rules)


def as_issues(findings: DataFrame) -> DataFrame:
    number = F.col("line_number").cast("int")
    return findings.select(
        "rule_id", "file_path", number.alias("line_start"), number.alias("line_end"), "severity", F.lit("secret").alias("category"), "title",
        F.concat("message", F.lit(" (detected: "), "masked_text", F.lit(")")).alias("description"), "suggestion", F.col("matched_text").alias("code_snippet"), "confidence", F.lit("secret-detection").alias("source"),
    )


def rule_rows(spark: SparkSession, rules: list[SecretRule] | None = None) -> DataFrame:
    """rule_id, provider, severity of a catalog."""
    rows = [(r.rule_id, r.provider, r.severity) for r in (builtin_secret_rules() if rules is None else rules)]
    return spark.createDataFrame(rows, "rule_id string, provider string, severity string")


def rule_stats(rows: DataFrame, dimensions: tuple[str, ...] = ("provider", "severity")) -> DataFrame:
    """dimension (total and those given), value, rules (different ones), n rows, of a catalog or of findings; one pass with grouping sets."""
    sets = [[F.col(d)] for d in dimensions] + [[]]
    said = F.lit("total")
    for d in dimensions:
        said = F.when(F.grouping(d) == 0, d).otherwise(said)
    value = F.coalesce(*dimensions, F.lit(""))
    out = rows.select("rule_id", *dimensions).groupingSets(sets, *dimensions).agg(said.alias("dimension"), F.count_distinct("rule_id").alias("rules"), F.count("*").alias("n"))
    return out.select("dimension", value.alias("value"), "rules", "n")


# --- tokens of high entropy ---

#: Token patterns and thresholds.
TOKEN, BASE64, HEX = r"[A-Za-z0-9+/=_-]{20,}", r"[A-Za-z0-9+/=_-]{40,}", r"[a-f0-9]{32,}"
BASE64_ENTROPY, HEX_ENTROPY = 5.0, 3.8


def _tokens(rows: DataFrame, pattern: str, min_length: int, least: float, text: str) -> DataFrame:
    """Filtered before they become rows, so that a token's entropy is computed once."""
    found = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: (F.octet_length(t) >= min_length) & ~is_placeholder(t))
    scored = F.transform(found, lambda t: F.struct(t.alias("token"), entropy(t).alias("entropy")))
    return rows.withColumn("scored", F.explode(F.filter(scored, lambda x: x["entropy"] >= least))).select(*rows.columns, "scored.*")


def high_entropy_tokens(rows: DataFrame, min_length: int = 20, least: float = 4.5, text: str = "content") -> DataFrame:
    return _tokens(rows, TOKEN, min_length, least, text)


def high_entropy_base64(rows: DataFrame, min_length: int = 40, text: str = "content") -> DataFrame:
    return _tokens(rows, BASE64, min_length, BASE64_ENTROPY, text)


def high_entropy_hex(rows: DataFrame, min_length: int = 32, text: str = "content") -> DataFrame:
    return _tokens(rows, HEX, min_length, HEX_ENTROPY, text).filter(~is_repetitive(F.col("token")))


# --- rotation ---

#: How to rotate secrets: provider key, name, documentation, revocation page, severity, steps; `*` is anything else.
ROTATION = (
    ("aws", "AWS", "https://docs.aws.amazon.com/IAM/latest/UserGuide/id_credentials_access-keys.html", "https://console.aws.amazon.com/iam/", "critical",
     ("Access AWS Console IAM", "Navigate to 'Users' or 'Access keys'", "Find the compromised key", "Click 'Delete' to revoke immediately", "Create a new access key", "Update your applications with the new key")),
    ("github", "GitHub", "https://docs.github.com/en/authentication/keeping-your-account-and-data-secure/reviewing-your-security-log", "https://github.com/settings/tokens", "critical",
     ("Access GitHub Settings", "Go to 'Developer settings' > 'Personal access tokens'", "Find the compromised token", "Click 'Delete'", "Generate a new token with the same scopes")),
    ("stripe", "Stripe", "https://stripe.com/docs/keys", "https://dashboard.stripe.com/apikeys", "critical",
     ("Access Stripe Dashboard", "Go to 'Developers' > 'API keys'", "Click 'Roll key' to revoke and create new", "Update your code with the new key")),
    ("slack", "Slack", "https://api.slack.com/authentication/token-types", "https://api.slack.com/apps", "critical",
     ("Access api.slack.com/apps", "Select your app", "Go to 'OAuth & Permissions'", "Revoke the compromised token", "Reinstall the app to generate new token")),
    ("openai", "OpenAI", "https://platform.openai.com/account/api-keys", "https://platform.openai.com/account/api-keys", "critical",
     ("Access platform.openai.com/account/api-keys", "Find the compromised key", "Click on the key and then 'Revoke key'", "Create a new API key", "Update your application")),
    ("gcp", "Google Cloud", "https://cloud.google.com/iam/docs/creating-managing-service-account-keys", "https://console.cloud.google.com/iam-admin/serviceaccounts", "critical",
     ("Access GCP Console", "Go to 'IAM & Admin' > 'Service Accounts'", "Select the service account", "Delete the compromised key", "Create a new key")),
    ("gitlab", "GitLab", "https://docs.gitlab.com/ee/user/profile/personal_access_tokens.html", "https://gitlab.com/-/profile/personal_access_tokens", "critical",
     ("Access GitLab User Settings", "Go to 'Access Tokens'", "Revoke the compromised token", "Create a new token")),
    ("vercel", "Vercel", "https://vercel.com/account/tokens", "https://vercel.com/account/tokens", "critical",
     ("Access vercel.com/account/tokens", "Find the compromised token", "Click 'Delete'", "Create a new token")),
    ("azure", "Azure", "https://docs.microsoft.com/en-us/azure/active-directory/develop/howto-create-service-principal-portal", "https://portal.azure.com", "critical",
     ("Access Azure Portal", "Go to 'Azure Active Directory'", "'App registrations' > Your app", "'Certificates & secrets'", "Delete the compromised secret", "Add a new secret")),
    ("datadog", "Datadog", "https://docs.datadoghq.com/account_management/api-app-keys/", "https://app.datadoghq.com/organization-settings/api-keys", "critical",
     ("Access Datadog Organization Settings", "Go to 'API Keys'", "Revoke the compromised key", "Generate a new key")),
    ("*", "Generic", "https://docs.github.com/en/code-security/secret-scanning/about-secret-scanning", None, "high",
     ("Identify the service related to the secret", "Access the service's console/administration", "Revoke the compromised token/key", "Generate a new token/key", "Update all applications")),
)
ROTATION_ALIASES = {"google": "gcp"}
#: Providers that rotation is said to support.
SUPPORTED_PROVIDERS = (
    "aws", "github", "gitlab", "stripe", "slack", "openai", "gcp", "google", "vercel", "npm", "docker", "azure", "datadog", "generic", "anthropic", "huggingface", "twilio", "sendgrid",
    "telegram", "discord", "shopify", "firebase", "mongodb", "postgres", "mysql", "redis", "jwt", "crypto",
)


def rotation_frame(spark: SparkSession) -> DataFrame:
    rows = [(k, name, doc, revoke, severity, [f"{i}. {s}" for i, s in enumerate(steps, 1)]) for k, name, doc, revoke, severity, steps in ROTATION]
    return spark.createDataFrame(rows, "rotation_key string, rotation_provider string, documentation_url string, revoke_url string, rotation_severity string, rotation_steps array<string>")


def with_rotation(findings: DataFrame) -> DataFrame:
    """Findings with how to rotate their secret; providers without an entry of their own get the generic one."""
    known = [k for k, *_ in ROTATION if k != "*"]
    low = F.lower("provider")
    key = F.when(low == "google", "gcp").when(low.isin(known), low).otherwise("*")
    return findings.withColumn("rotation_key", key).join(F.broadcast(rotation_frame(findings.sparkSession)), "rotation_key").drop("rotation_key")


def rotation_report(findings: DataFrame) -> DataFrame:
    """with_rotation plus `report`, a readable text of `name: value` lines and the steps; lines without a value are left out."""
    rows = with_rotation(findings)
    place = F.concat_ws(":", "file_path", F.col("line_number").cast("string"))
    named = (("ROTATION", F.concat_ws(" ", "rotation_provider", "rule_id")), ("Found in", place), ("Secret", F.col("masked_text")), ("Provider", F.col("provider")), ("Severity", F.col("severity")), ("What it is", F.col("message")))
    after = (("More about it", F.col("documentation_url")), ("Revoke it at", F.col("revoke_url")), ("Instead of it", F.col("suggestion")))
    said = lambda pairs: [F.concat(F.lit(f"{name}: "), value) for name, value in pairs]
    return rows.withColumn("report", F.concat_ws("\n", *said(named), F.lit("Steps"), F.transform("rotation_steps", lambda x: F.concat(F.lit("  "), x)), *said(after)))
