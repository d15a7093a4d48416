"""Function spans of source text, by language: header patterns, an end rule and a parameter rule for each."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass


@dataclass
class Span:
    name: str
    start: int
    end: int
    body: str
    parameters: list[str]


def split_lines(text: str) -> list[str]:
    """Lines as the Column function `lines` breaks them."""
    parts = re.sub(r"\r?\n\Z", "", text)
    return re.split(r"\r?\n", parts) if text else []


# --- where a function ends: number of lines up to its last one ---


def brace_end(lines: list[str], at: int) -> int:
    depth = 0
    for i in range(at, len(lines)):
        for brace in re.findall(r"[{}]", lines[i]):
            depth += 1 if brace == "{" else -1
            if depth == 0 and brace == "}" and _opened(lines, at, i):
                return i + 1
    return len(lines)


def _opened(lines: list[str], first: int, last: int) -> bool:
    return any("{" in lines[k] for k in range(first, last + 1))


def _rust_braces(line: str) -> list[str]:
    """Braces of a line outside strings, characters and comments; what is open at its end does not go on."""
    found, quote, comment, before = [], "", False, " "
    for c in line:
        if comment:
            comment = not (before == "*" and c == "/")
        elif c in "\"'" and before != "\\" and quote in ("", c):
            quote = "" if quote else c
        elif not quote and before == "/" and c == "/":
            break
        elif not quote and before == "/" and c == "*":
            comment = True
        elif not quote and c in "{}":
            found.append(c)
        before = c
    return found


def rust_end(lines: list[str], at: int) -> int:
    if lines[at].strip().endswith(";") and _in_trait(lines, at):
        return at + 1
    depth, opened = 0, False
    for i in range(at, len(lines)):
        for brace in _rust_braces(lines[i]):
            depth += 1 if brace == "{" else -1
            opened = opened or brace == "{"
            if opened and depth == 0 and brace == "}":
                return i + 1
    return len(lines)


def _in_trait(lines: list[str], at: int) -> bool:
    above = next((x for x in (lines[k].strip() for k in range(at - 1, -1, -1)) if x and not x.startswith("//")), "")
    return "trait " in above


def indent(line: str) -> int:
    return len(line.encode()) - len(line.lstrip().encode())


def python_end(lines: list[str], at: int) -> int:
    end, base = at + 1, indent(lines[at])
    for i in range(at + 1, len(lines)):
        if not lines[i].strip():
            continue
        if indent(lines[i]) <= base and (re.match(r"\s*class\s+\w", lines[i]) or PYTHON.search(lines[i]) or not lines[i].strip().startswith(("#", "@", "pass"))):
            break
        end = i + 1
    return end


def ruby_end(lines: list[str], at: int) -> int:
    """The line `end` itself stays outside."""
    base = indent(lines[at])
    for i in range(at + 1, len(lines)):
        text = lines[i].strip()
        if text and indent(lines[i]) <= base and text.startswith(("def ", "class ", "module ", "end")):
            return i
    return len(lines)


def arrow_end(lines: list[str], at: int) -> int:
    """An arrow function ends with its braces, or without any with the next line that ends in `;`."""
    if "{" in lines[at][lines[at].find("=>") :]:
        return brace_end(lines, at)
    return next((i + 1 for i in range(at, len(lines)) if lines[i].rstrip().endswith(";")), min(at + 1, len(lines)))


# --- parameters ---


def split_top(text: str, openers: str = "<([{", closers: str = ">)]}") -> list[str]:
    """Parts between commas outside brackets, trimmed, without empty ones."""
    parts, depth, part = [], 0, ""
    for c in text:
        depth += (c in openers) - (c in closers)
        if c == "," and depth == 0:
            parts.append(part)
            part = ""
        else:
            part += c
    return [p.strip() for p in [*parts, part] if p.strip()]


def _named(parts: list[str], name: Callable[[str], str | None]) -> list[str]:
    return [n for n in map(name, parts) if n]


def _before(text: str, *marks: str) -> str:
    for mark in marks:
        text = text.split(mark)[0].strip()
    return text


def _without(text: str, *heads: str) -> str:
    for head in heads:
        while text.startswith(head):
            text = text[len(head) :]
        text = text.strip()
    return text


def python_parameters(text: str) -> list[str]:
    return _named([p.strip() for p in text.split(",")], lambda p: None if p.startswith(("*", "/")) else _before(p, ":", "="))


def javascript_parameters(text: str) -> list[str]:
    return _named([p.strip() for p in text.split(",")], lambda p: _without(_before(p, ":", "="), "..."))


def typescript_parameters(text: str) -> list[str]:
    return _named(split_top(text), lambda p: None if p.startswith("*") else _without(_before(p, ":", "="), "...", "private ", "public ", "protected ", "readonly "))


def rust_parameters(text: str) -> list[str]:
    def name(p: str) -> str | None:
        if p in ("self", "&self", "&mut self", "mut self"):
            return None
        while p.startswith("mut "):
            p = p[4:].strip()
        p = _without(_before(p, ":"), "&", "mut ")
        return None if p == "_" else p

    return _named(split_top(text), name)


#: Words that are types in Go, as is any capitalized one.
GO_TYPES = frozenset("string int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 float32 float64 bool rune byte complex64 complex128 error any".split())


def go_parameters(text: str) -> list[str]:
    """Names before a type, those that share one included."""
    found: list[str] = []
    waiting: list[str] = []
    for words in (g.split() for g in text.split(",") if g.strip()):
        names = [w for w in (words[:-1] or words) if w not in GO_TYPES and not w[0].isupper()]
        if len(words) > 1:
            found, waiting = [*found, *waiting, *names], []
        else:
            waiting += names
    return found + waiting


def java_parameters(text: str) -> list[str]:
    def name(p: str) -> str | None:
        last = p.split()[-1].rstrip(",")
        return None if "<" in last or ">" in last else last

    return _named(split_top(text, "<([", ">)]"), name)


def csharp_parameters(text: str) -> list[str]:
    def name(p: str) -> str | None:
        words = p.split()
        last = words[-1].rstrip(",").rstrip("=").strip()
        if len(words) > 1 and words[0] in ("this", "out", "ref", "in", "params"):
            return last
        last = last.rstrip("?")
        return None if "<" in last or ">" in last else last

    return _named(split_top(text), name)


def cpp_parameters(text: str) -> list[str]:
    def name(p: str) -> str | None:
        words = p.split("=")[0].split()
        last = words[-1].strip("&").strip("*").strip() if words else ""
        return None if last == "const" else last

    return [] if text.strip() == "void" else _named(split_top(text), name)


def php_parameters(text: str) -> list[str]:
    def name(p: str) -> str | None:
        return next((n for n in (w.lstrip("$").split("=")[0].strip() for w in p.split() if w.startswith("$")) if n), None)

    return _named(split_top(text, "([{", ")]}"), name)


def kotlin_parameters(text: str) -> list[str]:
    return _named(split_top(text, "([{<", ")]}>"), lambda p: p.removeprefix("vararg ").split(":")[0].strip())


def ruby_parameters(text: str) -> list[str]:
    def name(p: str) -> str:
        if p.startswith("**"):
            return _before(p[2:].strip(), ":")
        if p.startswith("*"):
            return _before(p[1:].strip(), "=")
        if p.startswith("&"):
            return p[1:].strip()
        return _before(p, ":" if ":" in p and "::" not in p else "=")

    return _named(split_top(text, "([{", ")]}"), name)


# --- headers. The patterns ---

PYTHON = re.compile(r"^\s*(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)")
RUST = re.compile(r"(?:pub\s+)?(?:async\s+)?(?:const\s+)?fn\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)")
GO_METHOD = re.compile(r"func\s+\((\w+)\s+(?:\*?)(\w+)\)\s+(\w+)\s*\(([^)]*)\)")
GO_FUNCTION = re.compile(r"func\s+(?:\(([^)]+)\)\s+)?(\w+)\s*\(([^)]*)\)")
TS_FUNCTION = re.compile(r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*<[^>]*>?\s*\(([^)]*)\)")
TS_ARROW = re.compile(r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::\s*[^=]+)?\s*=\s*(?:async\s*)?\(([^)]*)\)\s*(?::\s*[^=]+)?\s*=>")
TS_METHOD = re.compile(r"(?:public|private|protected|readonly|static|async)\s+(\w+)\s*\(([^)]*)\)(?:\s*:\s*[^{]+)?\s*\{")
JS_FUNCTION = re.compile(r"(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)")
JS_ARROW = re.compile(r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>")
JS_METHOD = re.compile(r"^\s*(?:async\s+)?(\w+)\s*\(([^)]*)\)\s*\{")
JAVA_CLASS = re.compile(r"(?:public|private|protected)?\s*class\s+(\w+)")
JAVA_CONSTRUCTOR = re.compile(r"(?:public|private|protected)\s+(\w+)\s*\(([^)]*)\)\s*\{")
JAVA_METHOD = re.compile(r"(?:public|private|protected|static|final|synchronized|abstract|native|\s)+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w,\s]+)?\s*\{")
CSHARP_CLASS = re.compile(r"(?:public|private|internal|abstract|sealed|\s)*class\s+(\w+)")
CSHARP_METHOD = re.compile(r"(?:public|private|protected|internal|static|virtual|override|sealed|async|abstract|new|\s)+(\w+(?:<[^>]+>)?)\s+(\w+)\s*\(([^)]*)\)")
CSHARP_CONSTRUCTOR = re.compile(r"(?:public|private|protected|internal|static)\s+(\w+)\s*\(([^)]*)\)")
CPP_NAME = re.compile(r"((?:~?[A-Za-z_]\w*)(?:::(?:~?[A-Za-z_]\w*))*)\s*\(")
PHP = re.compile(r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*(?:async\s+)?function\s+(\w+)\s*\(([^)]*)")
KOTLIN = re.compile(r"^\s*(?:(?:public|private|protected|internal|open|abstract|final|override|suspend|inline|crossinline|noinline)\s+)*fun\s+(?:(?:<[^>]+>\s+)?(?:[\w\s<>,?.()]+\.)?)?(\w+)\s*\(([^)]*)\)")
RUBY = re.compile(r"^\s*def\s+(?:self\.)?(\w+[?!]?)(?:\s*\(([^)]*)\)|\s+|\Z)")
#: Words that open a block and are no function.
JS_CONTROL = frozenset("if while for switch catch".split())
JAVA_CONTROL = JS_CONTROL | frozenset("class interface enum try".split())
CSHARP_CONTROL = JAVA_CONTROL | frozenset("foreach struct record using lock".split())
CPP_CONTROL = JS_CONTROL | frozenset("return sizeof delete".split())
CPP_NO_FUNCTION = ("if ", "for ", "while ", "switch ", "catch ", "class ", "struct ", "enum ", "namespace ", "typedef ", "using ")

#: name, parameter text, end; None if the line heads no function
Header = tuple[str, list[str], int] | None


def _simple(pattern: re.Pattern, parameters: Callable, end: Callable) -> Callable[[list[str], int], Header]:
    def at(lines: list[str], i: int) -> Header:
        m = pattern.search(lines[i])
        return (m[1], parameters(m[2] or ""), end(lines, i)) if m else None

    return at


def _go(lines: list[str], i: int) -> Header:
    m = GO_METHOD.search(lines[i])
    if m:
        return f"{m[2]}.{m[3]}", go_parameters(m[4]), brace_end(lines, i)
    m = GO_FUNCTION.search(lines[i])
    return (m[2], go_parameters(m[3]), brace_end(lines, i)) if m else None


def _script(function: re.Pattern, arrow: re.Pattern, method: re.Pattern, parameters: Callable) -> Callable[[list[str], int], Header]:
    """JavaScript and TypeScript: a function, an arrow function, or a method whose name is no control word."""

    def at(lines: list[str], i: int) -> Header:
        for pattern, end in ((function, brace_end), (arrow, arrow_end)):
            m = pattern.search(lines[i])
            if m:
                return m[1], parameters(m[2]), end(lines, i)
        text = lines[i].strip()
        if text.startswith(("//", "*", "/*")) or re.match(r"(?:if|while|for|switch|catch)[ (]", text):
            return None
        m = method.search(lines[i])
        return (m[1], parameters(m[2]), brace_end(lines, i)) if m and m[1] not in JS_CONTROL else None

    return at


def _java(owner: str | None) -> Callable[[list[str], int], Header]:
    def at(lines: list[str], i: int) -> Header:
        m = JAVA_CONSTRUCTOR.search(lines[i])
        if not (m and m[1] == owner):
            m = JAVA_METHOD.search(lines[i])
            if not m or m[1] in JAVA_CONTROL or m[1] == owner:
                return None
        return m[1], java_parameters(m[2]), brace_end(lines, i)

    return at


def _csharp(owner: str | None) -> Callable[[list[str], int], Header]:
    def at(lines: list[str], i: int) -> Header:
        has_body = any("{" in x for x in lines[i : i + 2])
        m = CSHARP_METHOD.search(lines[i])
        if m and has_body and m[2] not in CSHARP_CONTROL and m[2] != owner:
            return m[2], csharp_parameters(m[3]), brace_end(lines, i)
        m = CSHARP_CONSTRUCTOR.search(lines[i])
        return (m[1], csharp_parameters(m[2]), brace_end(lines, i)) if m and has_body and m[1] == owner else None

    return at


def _cpp_signature(lines: list[str], at: int) -> str | None:
    """The lines up to the opening brace, joined; None if a declaration ends first."""
    for i in range(at, len(lines)):
        text = lines[i].strip()
        if not text or text.startswith(("//", "#")):
            if i == at:
                return None
            continue
        if "{" in text:
            return " ".join(x.strip() for x in lines[at : i + 1])
        if ";" in text:
            return None
        if text.endswith(")") and i + 1 < len(lines) and lines[i + 1].strip().startswith("{"):
            return " ".join(x.strip() for x in lines[at : i + 2])
    return None


def _cpp(lines: list[str], i: int) -> Header:
    signature = _cpp_signature(lines, i)
    if not signature or "=" in signature or signature.strip().startswith(CPP_NO_FUNCTION):
        return None
    m = CPP_NAME.search(signature)
    if not m or m[1] in CPP_CONTROL:
        return None
    inside = signature[signature.find("(") + 1 : max(signature.rfind(")"), signature.find("(") + 1)]
    return m[1], cpp_parameters(inside), brace_end(lines, i)


def _owner(pattern: re.Pattern, lines: list[str]) -> str | None:
    return next((m[1] for m in map(pattern.search, lines) if m), None)


_SLASH = ("//", "/*")
_JAVASCRIPT = _script(JS_FUNCTION, JS_ARROW, JS_METHOD, javascript_parameters)
_TYPESCRIPT = _script(TS_FUNCTION, TS_ARROW, TS_METHOD, typescript_parameters)
#: language -> (header finder for a file's lines, beginnings of lines that head nothing)
PARSERS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "python": (lambda _: _simple(PYTHON, python_parameters, python_end), ()),
    "rust": (lambda _: _simple(RUST, rust_parameters, rust_end), _SLASH),
    "go": (lambda _: _go, ("//",)),
    "typescript": (lambda _: _TYPESCRIPT, ()),
    "javascript": (lambda _: _JAVASCRIPT, ()),
    "java": (lambda lines: _java(_owner(JAVA_CLASS, lines)), (*_SLASH, "*")),
    "dotnet": (lambda lines: _csharp(_owner(CSHARP_CLASS, lines)), (*_SLASH, "*")),
    "cpp": (lambda _: _cpp, ()),
    "php": (lambda _: _simple(PHP, php_parameters, brace_end), ()),
    "kotlin": (lambda _: _simple(KOTLIN, kotlin_parameters, brace_end), ()),
    "ruby": (lambda _: _simple(RUBY, ruby_parameters, ruby_end), ()),
}


def spans(text: str, language: str) -> list[Span]:
    """Functions in order; one inside another belongs to it. Unknown languages read as TypeScript; TypeScript without any finding as
    JavaScript."""
    parser, skipped = PARSERS.get(language, PARSERS["typescript"])
    lines = split_lines(text)
    head = parser(lines)
    found, i = [], 0
    while i < len(lines):
        header = None if skipped and lines[i].strip().startswith(skipped) else head(lines, i)
        if header is None:
            i += 1
            continue
        name, parameters, end = header
        first = i
        while language == "python" and first > 0 and re.match(r"\s*@[\w.]+", lines[first - 1]):
            first -= 1
        found.append(Span(name, first + 1, end, "\n".join(lines[first:end]), parameters))
        i = max(end, i + 1)
    if not found and (language == "typescript" or language not in PARSERS):
        return spans(text, "javascript")
    return found


def in_range(found: list[Span], first: int, last: int) -> list[Span]:
    return [s for s in found if s.start >= first and s.end <= last]
