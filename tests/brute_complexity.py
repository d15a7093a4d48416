"""Complexity of one text, line by line, to hold the Column expressions against."""

from __future__ import annotations

import re
from functools import lru_cache

from lumenscan.functions import complexity as C
from lumenscan.functions.spans import split_lines

STRING = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|`(?:[^`\\]|\\.)*`')
#: `//` comments go only on the last line: elsewhere no pattern reaches across a line break.
COMMENT = re.compile(r"//.*\Z|/\*[\s\S]*?\*/|#[^\n]*")


def without_strings_and_comments(text: str) -> str:
    return COMMENT.sub("", STRING.sub('""', text))


@lru_cache(maxsize=64)
def _word(keyword: str) -> re.Pattern:
    return re.compile(rf"(?<![A-Za-z]){re.escape(keyword)}(?![A-Za-z])")


def _ahead(lines: list[str], at: int, opens, counts) -> int:
    """How many lines count, from the first that opens on, until its braces close."""
    n, depth, inside = 0, 0, False
    for line in lines[at:]:
        inside = inside or opens(line)
        if inside:
            depth += line.count("{") - line.count("}")
            n += counts(line)
            if depth <= 0 and "}" in line:
                break
    return n


def match_arms(lines: list[str], at: int, language: str) -> int:
    if language != "rust":
        return 0
    return _ahead(lines, at, lambda x: "match " in x, lambda x: "=>" in x and not x.strip().startswith("//"))


def switch_cases(lines: list[str], at: int, language: str) -> int:
    if language not in C.CASE_LANGUAGES:
        return 0
    return _ahead(lines, at, lambda x: "switch" in x.lower() or "select " in x.lower(), lambda x: x.lower().strip().startswith("case") or "case " in x.lower())


def cyclomatic(lines: list[str], language: str) -> int:
    *words, operators = C.KEYWORDS.get(language, C.OTHERS)
    n = 1
    for i, line in enumerate(lines):
        low, text = line.lower(), line.strip()
        for w in (w for group in words for w in group):
            if w == "match":
                n += match_arms(lines, i, language) if w in low else 0
            else:
                n += len(_word(w).findall(low))
        n += sum(text.count(op) for op in operators)
    return n


def cognitive(lines: list[str], language: str) -> tuple[int, int]:
    """Complexity and deepest nesting."""
    decisions, loops, switches, _, operators = C.KEYWORDS.get(language, C.OTHERS)
    heads = (*decisions, *loops, *switches)
    total = deepest = depth = 0
    for i, line in enumerate(lines):
        low, text = line.lower().strip(), line.strip()
        ends = language not in C.UNCLOSED and text.count("}") > text.count("{")
        if not ends and any(low.startswith(h) or f"{h} " in low for h in heads):
            total += max(depth, 1) + switch_cases(lines, i, language) + max(match_arms(lines, i, language) - 1, 0)
            depth += 1
            deepest = max(deepest, depth)
        if ends and depth:
            depth -= 1
        if not depth:
            total += sum(text.count(op) for op in operators)
    return total, deepest


def complexity(text: str, language: str) -> tuple[int, int, int]:
    """Cyclomatic, cognitive, deepest nesting."""
    lines = split_lines(without_strings_and_comments(text))
    return (cyclomatic(lines, language), *cognitive(lines, language))
