"""Splits query text into tokens; comments and white space go."""

from __future__ import annotations

import re
from dataclasses import dataclass


class QueryError(ValueError):
    """A query that can't be parsed or analysed."""


@dataclass(frozen=True)
class Token:
    kind: str  # num, str, name, quoted, op, end
    text: str
    pos: int
    glued: bool  # no white space before it


_PATTERN = re.compile(
    r"""(?P<space>(?:\s+|--[^\n]*(?:\n|\Z)|/\*.*?\*/)+)
      |(?P<num>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
      |(?P<str>'(?:[^']|'')*')
      |(?P<quoted>"(?:[^"]|"")*")
      |(?P<name>[^\W\d]\w*)
      |(?P<op><>|<=|>=|!=|!<|!>|==|\|\||[-+*/%&|^~=<>(),.\[\]{}:@$;])""",
    re.X | re.S,
)


def tokenize(text: str) -> list[Token]:
    out, at, glued = [], 0, False
    while at < len(text):
        m = _PATTERN.match(text, at)
        if not m:
            what = "unclosed string" if text[at] in "'\"" else f"unexpected character {text[at]!r}"
            raise QueryError(f"{what} at position {at} of query: {text[at : at + 40]!r}")
        at = m.end()
        kind = m.lastgroup
        if kind == "space":
            glued = False
            continue
        s = m[0]
        if kind == "str":
            s = s[1:-1].replace("''", "'")
        elif kind == "quoted":
            s = s[1:-1].replace('""', '"')
        out.append(Token(kind, s, m.start(), glued))
        glued = True
    out.append(Token("end", "", at, False))
    return out
