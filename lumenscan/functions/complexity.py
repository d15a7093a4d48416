"""Cyclomatic and cognitive complexity and nesting depth of functions, as Column expressions on their texts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenscan.functions.text import lines, trimmed

#: Decision, loop, switch and catch keywords and Boolean operators of languages.
KEYWORDS: dict[str, tuple[tuple[str, ...], ...]] = {
    "dotnet": (("if", "else if", "elif"), ("for", "foreach", "while", "do"), ("case", "default"), ("catch", "when"), ("&&", "||", "?", "??")),
    "typescript": (("if", "else if"), ("for", "while", "do"), ("case", "default"), ("catch",), ("&&", "||", "?", "??", "?.")),
    "python": (("if", "elif"), ("for", "while"), (), ("except", "finally"), ("and", "or")),
    "go": (("if", "else if"), ("for",), ("case", "default"), (), ("&&", "||")),
    "rust": (("if", "else if"), ("for", "while", "loop"), ("match",), (), ("&&", "||", "?")),
    "php": (("if", "elseif"), ("for", "foreach", "while", "do"), ("case", "default"), ("catch",), ("&&", "||", "?", "??")),
    "ruby": (("if", "elsif", "unless"), ("for", "while", "until"), ("when",), ("rescue",), ("&&", "||")),
}
KEYWORDS["java"] = KEYWORDS["typescript"]
OTHERS = (("if", "else"), ("for", "while"), ("case",), ("catch",), ("&&", "||"))
#: Languages whose switch cases count, and those whose nesting never closes.
CASE_LANGUAGES = frozenset(("dotnet", "java", "typescript", "php", "go"))
UNCLOSED = frozenset(("python", "ruby"))
#: Strings, with runs that never give back what they took, so that long ones need no deep recursion.
STRING = r'"(?:[^"\\]++|\\[^\n])*+"|\'(?:[^\'\\]++|\\[^\n])*+\'|`(?:[^`\\]++|\\[^\n])*+`'
#: `//` comments go only on the last line: elsewhere no pattern reaches across a line break.
COMMENT = r"//[^\n]*\z|/\*[\s\S]*?\*/|#[^\n]*"


def stripped_lines(text: Column) -> Column:
    """The lines of a text without comments, its strings empty."""
    return lines(F.regexp_replace(F.regexp_replace(text, STRING, '""'), COMMENT, ""))


def occurrences(text: Column, part: str) -> Column:
    """How often the part stands in the text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def _total(parts: list[Column]) -> Column:
    return sum(parts, F.lit(0))


def _words(low: Column, keywords: list[str]) -> Column:
    """How often the keywords stand in a lower-cased line with no letter next to them; one inside another counts for both."""
    return _total([F.size(F.regexp_extract_all(low, F.lit(rf"(?<![A-Za-z]){re.escape(k)}(?![A-Za-z])"), F.lit(0))) for k in keywords])


def _ahead(all_lines: Column, at: Column, opens: Callable[[Column], Column], counts: Callable[[Column], Column]) -> Column:
    """How many lines count, from the first that opens on, until its braces close."""
    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("over"), F.lit(0).alias("depth"), F.lit(0).alias("n"))

    def step(s: Column, line: Column) -> Column:
        inside = s["inside"] | opens(line)
        depth = s["depth"] + occurrences(line, "{") - occurrences(line, "}")
        now = F.struct(F.lit(True).alias("inside"), ((depth <= 0) & F.contains(line, F.lit("}"))).alias("over"), depth.alias("depth"), (s["n"] + counts(line).cast("int")).alias("n"))
        return F.when(s["over"] | ~inside, s).otherwise(now)

    return F.aggregate(F.slice(all_lines, at + 1, F.size(all_lines)), start, step, lambda s: s["n"])


def match_arms(all_lines: Column, at: Column) -> Column:
    return _ahead(all_lines, at, lambda x: F.contains(x, F.lit("match ")), lambda x: F.contains(x, F.lit("=>")) & ~F.startswith(trimmed(x), F.lit("//")))


def switch_cases(all_lines: Column, at: Column) -> Column:
    low = F.lower
    return _ahead(all_lines, at, lambda x: F.contains(low(x), F.lit("switch")) | F.contains(low(x), F.lit("select ")), lambda x: F.startswith(trimmed(low(x)), F.lit("case")) | F.contains(low(x), F.lit("case ")))


def _by_language(language: Column, of: Callable[[str | None], Column]) -> Column:
    """The expression of each language that has keywords of its own, else that of the others."""
    out = of(None)
    for name in KEYWORDS:
        out = F.when(language == name, of(name)).otherwise(out)
    return out


def cyclomatic(all_lines: Column, language: Column) -> Column:
    """all_lines: a column, not an expression, as are all that are gone through more than once. No keyword and no operator holds a line break
    or stands beside a letter across one, so they are counted in all lines at once."""
    text = F.array_join(all_lines, "\n")
    low = F.lower(text)

    def of(name: str | None) -> Column:
        *words, operators = KEYWORDS.get(name, OTHERS)
        words = [w for group in words for w in group]
        found = _words(low, [w for w in words if w != "match"]) + _total([occurrences(text, op) for op in operators])
        if "match" in words:
            arms = F.transform(all_lines, lambda x, i: F.when(F.contains(F.lower(x), F.lit("match")), match_arms(all_lines, i)).otherwise(0))
            found = found + F.aggregate(arms, F.lit(0), lambda s, n: s + n)
        return F.lit(1) + found

    return _by_language(language, of)


def cognitive(all_lines: Column, language: Column) -> Column:
    """struct<total, deepest>: complexity and deepest nesting. What a line is told by several times is found once: first its text without
    white space around, then that in lower case and whether it closes more than it opens, then the rest."""

    def of(name: str | None) -> Column:
        decisions, loops, switches, _, operators = KEYWORDS.get(name, OTHERS)
        heads = "|".join(map(re.escape, (*decisions, *loops, *switches)))

        def shown(text: Column) -> Column:
            ends = F.lit(False) if name in UNCLOSED else occurrences(text, "}") > occurrences(text, "{")
            return F.struct(text.alias("text"), F.lower(text).alias("low"), ends.alias("ends"))

        def line(x: Column, i: Column) -> Column:
            head = ~x["ends"] & x["low"].rlike(rf"\A(?:{heads})|(?:{heads}) ")
            inside = (switch_cases(all_lines, i) if name in CASE_LANGUAGES else F.lit(0)) + (F.greatest(match_arms(all_lines, i) - 1, F.lit(0)) if name == "rust" else F.lit(0))
            return F.struct(x["text"].alias("text"), x["ends"].alias("ends"), F.when(head, inside).alias("inside"))

        def step(s: Column, x: Column) -> Column:
            head = x["inside"].isNotNull()
            depth = s["depth"] + F.when(head, 1).when(x["ends"] & (s["depth"] > 0), -1).otherwise(0)
            total = s["total"] + F.when(head, F.greatest(s["depth"], F.lit(1)) + x["inside"]).otherwise(0) + F.when(depth == 0, x["operators"]).otherwise(0)
            return F.struct(total.alias("total"), F.greatest(s["deepest"], depth).alias("deepest"), depth.alias("depth"))

        counted = lambda x: F.struct(x["inside"].alias("inside"), x["ends"].alias("ends"), _total([occurrences(x["text"], op) for op in operators]).alias("operators"))
        every = F.transform(F.transform(F.transform(F.transform(all_lines, trimmed), shown), line), counted)
        zero = F.struct(*[F.lit(0).alias(n) for n in ("total", "deepest", "depth")])
        return F.aggregate(every, zero, step, lambda s: F.struct(s["total"].alias("total"), s["deepest"].alias("deepest")))

    return _by_language(language, of)
