"""Append-only records of runs, as JSON files that are replaced whole."""

from __future__ import annotations

import json
import os
import tempfile


class Refused(ValueError):
    """A record that must not be written."""


def _replace(path: str, rows: list) -> None:
    handle, tried = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".tmp")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(rows, f, indent=2, ensure_ascii=False)
        f.write("\n")
    os.replace(tried, path)


def read(path: str, missing_ok: bool = False) -> list:
    """The recorded runs; a missing or blank file is none only if that is allowed."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except FileNotFoundError:
        if missing_ok:
            return []
        raise
    if missing_ok and not text.strip():
        return []
    rows = json.loads(text)
    if not isinstance(rows, list):
        raise Refused(f"{path} does not hold a list")
    return rows


def append(path: str, row: dict) -> None:
    """Add a run to a history that exists; the file is written beside and moved into place."""
    _replace(path, [*read(path), row])


def append_holdout(path: str, row: dict, force: bool = False) -> None:
    """Add a holdout run: only one that scored something, and a second one only by force."""
    if not row.get("scored"):
        raise Refused("nothing was scored, so nothing is recorded")
    rows = read(path, missing_ok=True)
    if any(r.get("scored") for r in rows) and not force:
        raise Refused("the holdout was scored before")
    _replace(path, [*rows, row])
