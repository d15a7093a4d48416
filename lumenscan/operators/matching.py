"""Matching lines against many patterns whose compiled forms live in the plan.

A pattern that is a column is compiled anew whenever its value changes, that is for nearly every pair of a line and a rule. Here rules are
joined by a number, and the number is looked up in a tree of literal patterns, each compiled once a task. The tree stands in a lambda,
which is evaluated node by node, so its size never bears on the size of generated code.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def tested(number: Column, text: Column, patterns: list[str]) -> Column:
    """Whether the text matches the pattern of that number, found by halves."""

    def among(first: int, last: int, n: Column) -> Column:
        if last - first <= 1:
            return text.rlike(patterns[first]) if first < last else F.lit(False)
        middle = (first + last) // 2
        return F.when(n < middle, among(first, middle, n)).otherwise(among(middle, last, n))

    return F.exists(F.array(number), lambda n: among(0, len(patterns), n))


def longest_keyword(keywords: Iterable[str]) -> str:
    """A pattern whose group 1 is, at every place where a keyword begins, the longest one that does: a tree of their characters. It
    consumes nothing, so keywords inside and across others are found too."""
    tree: dict = {}
    for k in keywords:
        node = tree
        for c in k:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        own = [re.sub(r"([^\w\s])", r"\\\1", c) + pattern(child) for c, child in sorted(node.items()) if c]
        if not own:
            return ""
        either = own[0] if len(own) == 1 else f"(?:{'|'.join(own)})"
        return f"(?:{either})?" if "" in node else either

    return f"(?=({pattern(tree)}))"
