"""Tokens of a source text, with lines and matching brackets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*)|(?P<block>/\*)|(?P<text>b?r(?P<hash>\#*)".*?"(?P=hash)|b?"(?:\\.|[^"\\])*"|b?'(?:\\[^\n]{1,10}?|[^'\\\n])')|(?P<life>'[A-Za-z_]\w*)"""
    r"""|(?P<name>(?:r\#)?[A-Za-z_]\w*)|(?P<number>\d[\w]*(?:\.\d[\w]*)?)|(?P<mark>::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\.\.=|\.\.|[^\s\w])""",
    re.S,
)
_PAIRS = {"(": ")", "[": "]", "{": "}"}
KEYWORDS = frozenset("as break const continue crate else enum extern fn for if impl in let loop match mod move mut pub ref return static struct super trait type unsafe use where while".split())


class SyntaxProblem(ValueError):
    """A text that cannot be read as source."""


@dataclass
class Source:
    """A token list: kinds, strings, lines, offsets, and for each bracket the place of its partner."""

    kind: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    line: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    mate: dict[int, int] = field(default_factory=dict)

    def written(self, a: int, b: int) -> str:
        """The tokens from a up to b, a space between two."""
        return " ".join(self.text[a:b])

    def names(self, a: int, b: int) -> list[str]:
        """The sorted distinct identifiers from a up to b."""
        return sorted({t for t, k in zip(self.text[a:b], self.kind[a:b]) if k == "name"})

    def parts(self, a: int, b: int, by: str = ",") -> list[tuple[int, int]]:
        """The stretches between separators at the top level, angle brackets counted as brackets."""
        out, begin, i, angles = [], a, a, 0
        while i < b:
            t = self.text[i]
            if t in _PAIRS:
                i = self.mate[i]
            elif t == "<":
                angles += 1
            elif t == ">" and angles:
                angles -= 1
            elif t == by and not angles:
                out.append((begin, i))
                begin = i + 1
            i += 1
        return [p for p in [*out, (begin, b)] if p[0] < p[1]]


def lex(text: str) -> Source:
    """Tokens without comments; SyntaxProblem for what has no reading or brackets that do not match."""
    s, at, line, open_ = Source(), 0, 1, []
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise SyntaxProblem(f"line {line}: unreadable text")
        kind, piece, end = m.lastgroup, m.group(), m.end()
        if kind == "hash":
            kind = "text"
        if kind == "block":
            depth, end = 1, at + 2
            for c in re.finditer(r"/\*|\*/", text[end:]):
                depth += 1 if c.group() == "/*" else -1
                if not depth:
                    end += c.end()
                    break
            else:
                raise SyntaxProblem(f"line {line}: open comment")
            piece = text[at:end]
        elif kind != "space":
            i = len(s.text)
            if kind == "mark" and piece in _PAIRS:
                open_.append(i)
            elif kind == "mark" and piece in ")]}":
                if not open_ or _PAIRS[s.text[open_[-1]]] != piece:
                    raise SyntaxProblem(f"line {line}: unmatched {piece}")
                j = open_.pop()
                s.mate[j], s.mate[i] = i, j
            elif piece == '"':
                raise SyntaxProblem(f"line {line}: open string")
            s.kind.append(kind)
            s.text.append(piece)
            s.line.append(line)
            s.at.append(at)
        line += piece.count("\n")
        at = end
    if open_:
        raise SyntaxProblem(f"line {s.line[open_[-1]]}: unmatched {s.text[open_[-1]]}")
    return s
