"""Chunking by a walk over lines in Python: the brute force that expressions are held against."""

from __future__ import annotations

import re
from collections.abc import Iterator

from lodestone.constants import CLASS_TAGS, MERGE_BELOW, SPLIT_ABOVE

_HEADING = re.compile("(#{1,4}) ")
_FINDING = re.compile(r"\[?[A-Z]{2,5}-(?=[A-Z0-9-]*[0-9])[A-Z0-9-]++(?![^\W_])")
_DASH = " — "


def _size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def _lines(text: str) -> list[str]:
    parts = re.split("\r?\n", text)
    return parts[:-1] if parts[-1] == "" else parts


def pieces(text: str, limit: int = SPLIT_ABOVE) -> list[str]:
    """A text in pieces of at most so many bytes, cut at line ends."""
    if _size(text) <= limit:
        return [text]
    out, now, held = [], [], 0
    for line in _lines(text):
        n = _size(line) + 1
        if now and held + n > limit:
            out.append("".join(now))
            now, held = [], 0
        now.append(line + "\n")
        held += n
    if "".join(now).strip():
        out.append("".join(now))
    return out


class _Path:
    """The headings in force, from the root down."""

    def __init__(self) -> None:
        self.stack: list[str] = []

    def enter(self, line: str) -> str:
        mark = _HEADING.match(line)
        depth = len(mark.group(1)) if mark else 1
        self.stack = (self.stack + [""] * depth)[: depth - 1] + [line.lstrip("#").strip()]
        return _DASH.join(h for h in self.stack if h)


def sections(text: str) -> Iterator[tuple[str | None, str]]:
    """(heading path, text) from one boundary line to the next."""
    path, title, held = _Path(), None, []
    for line in _lines(text):
        if _HEADING.match(line) or _FINDING.match(line):
            if held:
                yield title, "".join(held)
                held = []
            title = path.enter(line)
        held.append(line + "\n")
    if "".join(held).strip():
        yield title, "".join(held)


def merged(parts: Iterator[tuple[str | None, str]]) -> Iterator[tuple[str | None, str]]:
    """Sections joined until what is gathered has enough bytes; the name deepens but is not replaced."""
    title, text = None, None
    for name, more in parts:
        if text is not None and _size(text.strip()) < MERGE_BELOW:
            text += more
            if title is None or (name is not None and len(name) > len(title) and name.startswith(title)):
                title = name
            continue
        if text is not None:
            yield title, text
        title, text = name, more
    if text is not None:
        yield title, text


def chunks(source_title: str, inherited: list[str], text: str) -> list[tuple[str, str, list[str]]]:
    """(title, text, tags) of each chunk of one source."""
    if not text.strip():
        return []
    out = []
    for path, body in merged(sections(text)):
        if path is not None and path not in body:
            body = f"{path}\n\n{body}"
        named = source_title if path is None or not path.strip() or path == source_title else source_title + _DASH + path
        for piece in pieces(body):
            low = piece.lower()
            out.append((named, piece, sorted({*inherited, *(t for t in CLASS_TAGS if t in low)})))
    return out
