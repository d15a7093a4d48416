"""Operators and operands of a function's text."""

from __future__ import annotations

import re
from functools import lru_cache

#: `//` comments go only on the last line: elsewhere no pattern reaches across a line break.
COMMENT = re.compile(r"//.*\Z|/\*[\s\S]*?\*/|#[^\n]*")
#: Operator symbols in the order they are tried (`=` before `==`, so `==` counts as two).
COMMON = "+ - * / % = == != < > <= >= && || ! & | ^ ~ << >> ++ -- += -= *= /= %= &= |= ^= <<= >>= => -> :: . , ; : ? ?? ?. ?:".split()
SYMBOLS = {
    "rust": "+ - * / % = == != < > <= >= && || ! & | ^ ~ << >> ++ -- += -= *= /= %= &= |= ^= <<= >>= => -> :: . , ; : ? .. ..= |>".split(),
    "go": "+ - * / % = == != < > <= >= && || ! & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= <- := . , ; :".split(),
}
#: Words that are operators, and type words and constants that count as operators too.
OPERATOR_WORDS = {
    "rust": "fn let mut const static pub mod use crate self super impl trait type struct enum match if else for while loop break continue return async await move ref as in where unsafe extern dyn box",
    "python": "def class lambda if elif else for while break continue return yield import from as with try except finally raise assert pass del global nonlocal async await and or not in is",
    "typescript": "function var let const class interface type enum if else for while do switch case default break continue return throw try catch finally new delete typeof instanceof in async await import export from as extends implements public private protected static abstract final readonly",
    "dotnet": "class interface struct enum record delegate if else for foreach while do switch case default break continue return throw try catch finally new typeof sizeof nameof is as async await using lock fixed unsafe checked unchecked public private protected internal static readonly const sealed abstract virtual override new extern volatile",
    "go": "func var const type struct interface map chan if else for range switch case default break continue return goto fallthrough defer go select package import",
}
OTHER_OPERATOR_WORDS = "function class if else for while switch case default break continue return try catch finally throw new"
TYPE_WORDS = {
    "rust": "i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 bool char str String Vec Option Result Box Rc Arc Cell RefCell Some None Ok Err true false",
    "python": "int float bool str list dict set tuple None True False",
    "typescript": "number string boolean void null undefined any never object symbol bigint true false int long short byte float double char",
    "dotnet": "int long short byte float double decimal bool char string object void null true false var dynamic nint nuint",
    "go": "int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 float32 float64 complex64 complex128 bool string rune byte uintptr true false nil any error",
}
OTHER_TYPE_WORDS = "int float bool string true false null"
OPERATOR_WORDS["java"], TYPE_WORDS["java"] = OPERATOR_WORDS["typescript"], TYPE_WORDS["typescript"]


@lru_cache(maxsize=16)
def _lexer(language: str) -> tuple[re.Pattern, frozenset]:
    words = OPERATOR_WORDS.get(language, OTHER_OPERATOR_WORDS).split()
    types = TYPE_WORDS.get(language, OTHER_TYPE_WORDS).split()
    symbols = "|".join(map(re.escape, SYMBOLS.get(language, COMMON)))
    text = r"""(?P<quote>["'`])(?:\\[\s\S]|(?!(?P=quote))[^\\])*(?:(?P=quote)|\\?\Z)"""
    return re.compile(rf"(?P<operator>(?:{'|'.join(words)})(?!\w)|{symbols})|(?P<word>[^\W\d]\w*)|(?P<number>[0-9][0-9.xXeE+\-bo_]*)|(?P<text>{text})"), frozenset(words + types)


def counts(text: str, language: str) -> tuple[int, int, int, int]:
    """Operators, operands, different operators, different operands."""
    lexer, reserved = _lexer(language)
    text, at = COMMENT.sub("", text), 0
    operators, operands = [], []
    while at < len(text):
        m = lexer.match(text, at)
        if not m:
            at += 1
            continue
        if m["number"]:
            # `_` is dropped from a number, and as many characters as are left are passed: what follows is read again
            number = m["number"].replace("_", "")
            operands.append(number)
            at += len(number)
            continue
        (operators if m["operator"] or m["word"] in reserved else operands).append(m[0])
        at = m.end()
    return len(operators), len(operands), len(set(operators)), len(set(operands))
