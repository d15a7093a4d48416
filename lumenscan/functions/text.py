"""Scalar functions on text as Column expressions: lines, trimming, placeholders, masking, entropy, confidence, severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What upper-cased text holds if it is a placeholder, in secrets and in infrastructure files.
SECRET_PLACEHOLDERS = ("EXAMPLE", "TEST", "DUMMY", "FAKE", "PLACEHOLDER", "SAMPLE", "XXXXXX", "000000", "111111", "YOUR_KEY_HERE", "REPLACE_ME", "INSERT_KEY", "API_KEY_HERE", "127.0.0.1")
IAC_PLACEHOLDERS = ("EXAMPLE", "TEST", "DUMMY", "FAKE", "PLACEHOLDER", "SAMPLE", "XXXXXX", "000000", "111111", "YOUR_VALUE_HERE", "REPLACE_ME", "INSERT_VALUE")
#: A match of one of these is safe.
GLOBAL_ALLOWLIST = (
    r"^example\z", r"^test\z", r"^dummy\z", r"^fake\z", r"^placeholder\z", r"^your_\w+_here\z", r"^insert_\w+_here\z", r"^\*+\z", r"^x+\z", r"^X+\z", r"^0+\z", r"^[aA]+\z",
    r"example\.com", r"test\.com", r"localhost", r"127\.0\.0\.1",
)


def lines(text: Column) -> Column:
    """Lines of a text: broken at \\n, one \\r before it belongs to the break, no empty line behind the last break, none in empty text."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when((text == "") | text.isNull(), F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n", -1))


#: All characters of white space (those of `\s` under `(?U)`).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(w.replace(".", r"\.") for w in words))


def is_placeholder(text: Column, words: tuple[str, ...] = SECRET_PLACEHOLDERS) -> Column:
    return holds_any(F.upper(text), words)


def is_allowlisted(text: Column) -> Column:
    return text.rlike("(?U)" + "|".join(GLOBAL_ALLOWLIST))


def distinct_chars(text: Column) -> Column:
    return F.size(F.array_distinct(F.split(text, "")))


def is_repetitive(text: Column) -> Column:
    """Fewer different characters than a fifth of the bytes; never under 4 bytes."""
    return (F.octet_length(text) >= 4) & (distinct_chars(text) / F.octet_length(text) < 0.2)


def masked(secret: Column) -> Column:
    """First and last characters around `****`; how many is decided by the length in bytes."""
    size = F.octet_length(secret)
    return (
        F.when(size <= 8, F.concat(F.left(secret, F.lit(2)), F.lit("****")))
        .when(size <= 12, F.concat(F.left(secret, F.lit(2)), F.lit("****"), F.right(secret, F.lit(2))))
        .otherwise(F.concat(F.left(secret, F.lit(4)), F.lit("****"), F.right(secret, F.lit(4))))
    )


def entropy(text: Column) -> Column:
    """Shannon entropy in bits, counts of characters over the length in bytes."""
    size = F.octet_length(text).cast("double")
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*+"), F.lit(0))  # a run a character, once they are sorted

    def term(run: Column) -> Column:
        p = F.length(run) / size
        return -p * F.log2(p)

    total = F.aggregate(runs, F.lit(0.0), lambda s, run: s + term(run))
    return F.when(size > 0, total + F.lit(0.0)).otherwise(0.0)


def confidence(matched: Column, rule_entropy: Column) -> Column:
    length = F.least(F.octet_length(matched) / 40.0, F.lit(0.1))
    factor = F.when(rule_entropy.isNotNull(), F.least(rule_entropy / 10.0, F.lit(0.05))).otherwise(0.0)
    return F.least(F.lit(0.85) + length + factor, F.lit(0.99))


def _first(cases: dict[str, tuple[str, ...]], text: Column, default: str) -> Column:
    out = None
    for value, words in cases.items():
        out = (F if out is None else out).when(text.isin(*words), value)
    return out.otherwise(default)


def rule_severity(severity: Column) -> Column:
    """Severity of a rule bundle's rule; none counts as MAJOR."""
    cases = {"critical": ("BLOCKER", "CRITICAL"), "high": ("MAJOR",), "medium": ("MINOR",), "info": ("INFO",)}
    return _first(cases, F.upper(F.coalesce(severity, F.lit("MAJOR"))), "medium")


def known_severity(severity: Column, default: str) -> Column:
    """critical, high, medium or low; anything else is the default (`high` for secrets, `medium` for infrastructure)."""
    return _first({s: (s,) for s in ("critical", "high", "medium", "low")}, F.lower(severity), default)


def minimum_severity(value: Column) -> Column:
    cases = {"critical": ("critical", "blocker"), "high": ("high", "major"), "medium": ("medium", "minor"), "low": ("low",)}
    return _first(cases, F.lower(F.coalesce(value, F.lit("info"))), "info")


def severity_rank(severity: Column) -> Column:
    out = F.when(severity == "critical", 5)
    for name, rank in (("high", 4), ("medium", 3), ("low", 2), ("info", 1)):
        out = out.when(severity == name, rank)
    return out.otherwise(0)


SEVERITY_RANKS = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}


def issue_category(category: Column) -> Column:
    return F.when(category.isin("Vulnerability", "SecurityHotspot"), "security").when(category == "Bug", "bug_risk").otherwise("maintainability")


def parsed_minimum(value: str | None) -> str:
    low = (value or "info").lower()
    return {"blocker": "critical", "major": "high", "minor": "medium"}.get(low, low if low in SEVERITY_RANKS else "info")
