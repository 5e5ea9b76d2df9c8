"""Recorded hashes in a manifest's text, replaced without touching anything else."""

from __future__ import annotations

import os
import re
import tempfile


def with_hashes(text: str, new: dict[str, tuple[str, str]]) -> str:
    """The manifest with each named source's sha256 and retrieved date replaced; comments and order stay."""
    out, current = [], None
    pending: list[int] = []
    for line in text.split("\n"):
        head = re.match(r"\s*\[\[source\]\]", line)
        if head:
            current, pending = None, []
        m = re.match(r'(\s*)(id|sha256|retrieved)(\s*=\s*)"([^"]*)"(.*)$', line)
        if m and m[2] == "id":
            current = m[4]
            for i in pending:
                out[i] = _replaced(out[i], new.get(current))
        elif m:
            if current is None:
                pending.append(len(out))
            else:
                line = _replaced(line, new.get(current))
        out.append(line)
    return "\n".join(out)


def _replaced(line: str, values: tuple[str, str] | None) -> str:
    if values is None:
        return line
    return re.sub(r'(\s*(sha256|retrieved)\s*=\s*)"[^"]*"', lambda m: f'{m[1]}"{values[0] if m[2] == "sha256" else values[1]}"', line, count=1)


def write_atomically(path: str, text: str) -> None:
    """Write beside the file and move into place."""
    handle, tried = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(tried, path)
