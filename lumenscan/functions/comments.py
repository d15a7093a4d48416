"""Inline comments of a line of code."""

from __future__ import annotations

import re

#: Quoted stretches (with escapes, perhaps open to the end), single slashes, anything that opens neither a quote nor a comment.
_CODE = re.compile(r""""(?:\\.|[^"\\])*(?:"|\\?\Z)|'(?:\\.|[^'\\])*(?:'|\\?\Z)|`(?:\\.|[^`\\])*(?:`|\\?\Z)|/(?!/)|[^"'`/#]+""", re.S)


def without_inline_comment(line: str) -> str:
    """The line up to the first `//` or `#` outside quotes."""
    at = 0
    while (m := _CODE.match(line, at)) and m.end() > at:
        at = m.end()
    return line[:at]
