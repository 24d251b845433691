"""Tokens of the configuration language."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .syntax import Problem

# The reserved words.
STATEMENTS = frozenset(
    "after aggregate anonymize exclude_data faker full get ignore_relation ignore_table import preserve relation set var".split()
)
KEYWORDS = STATEMENTS | frozenset("asc bool by desc exclude false float int limit match null order root root_only string true when where".split())

_TOKEN = re.compile(
    r'''(?P<skip>\s+|//[^\n]*)
    |(?P<multi>"""(?:(?!""")[\s\S])*""")
    |(?P<string>"(?:\\[\s\S]|[^"\\])*")
    |(?P<float>[0-9]+\.[0-9]+)
    |(?P<int>[0-9]+)
    |(?P<regex>/[^\s/]+/)
    |(?P<tick>`[^`]+`)
    |(?P<name>[^\W\d]\w*)
    |(?P<op>\.\.\.|->|==|!=|<=|>=|&&|\|\||[-{}()\[\],.:=<>+*/%!$\#;])''',
    re.X,
)


@dataclass(frozen=True)
class Token:
    kind: str  # string, multi, float, int, regex, name, word (reserved), op, end
    text: str
    start: int
    end: int


def lex(source: str, problems: list[Problem], start: int = 0, inner: bool = False) -> list[Token]:
    """Tokens from start on. inner: within an interpolation, up to the brace that closes it.

    There, no word is reserved but true, false and null, and a slash always divides. Elsewhere
    a slash divides after a value, and else may begin a regular expression.
    """
    out: list[Token] = []
    at, depth = start, 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:
            what = "unterminated string" if source[at] == '"' else f"unexpected character {source[at]!r}"
            problems.append(Problem(what, at))
            if inner:
                break
            at = len(source) if source[at] == '"' else at + 1
            continue
        kind, text, end = m.lastgroup, m[0], m.end()
        if kind == "skip":
            at = end
            continue
        if kind == "regex":
            last = out[-1] if out else None
            value = last is not None and (last.kind in ("int", "float", "string") or last.text in (")", "]") or (last.kind in ("name", "word") and len(out) > 1 and out[-2].text == "$"))
            if inner or value:
                kind, text, end = "op", "/", at + 1
        if kind == "tick":
            kind, text = "name", text[1:-1]
        elif kind == "name" and (text in ("true", "false", "null") if inner else text in KEYWORDS):
            kind = "word"
        elif kind == "int" and int(text) >= 1 << 63:
            problems.append(Problem(f"integer {text} is beyond 64 bits", at))
            text = "0"
        out.append(Token(kind, text, at, end))
        at = end
        if inner and kind == "op":
            depth += (text == "{") - (text == "}")
            if depth < 0:
                break
    out.append(Token("end", "", at, at))
    return out
