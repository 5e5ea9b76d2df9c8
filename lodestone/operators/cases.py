"""Cases on disk: the clean tree, one tree a mutant with its label, and those that were rejected."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterable

MARKER = ".lodestone-cases"
ORIGINAL, CASES, REJECTED, LABEL = "original", "cases", "rejected", "label.json"


class NotOurs(ValueError):
    """A folder with something in it that this tool did not make."""


def prepare(folder: str) -> None:
    """Clear the cases of an earlier run; a folder that is not empty and has no marker is left alone."""
    if os.path.isdir(folder) and os.listdir(folder) and not os.path.exists(os.path.join(folder, MARKER)):
        raise NotOurs(f"{folder} is not empty and was not made by this tool")
    for part in (ORIGINAL, CASES, REJECTED):
        shutil.rmtree(os.path.join(folder, part), ignore_errors=True)
    os.makedirs(folder, exist_ok=True)
    open(os.path.join(folder, MARKER), "w").close()


def copy_tree(source: str, target: str) -> None:
    """A tree without build output and dot entries, as the analysis sees it."""
    if not os.path.isdir(source):
        raise FileNotFoundError(f"{source} is not a folder")
    shutil.copytree(source, target, ignore=lambda _, names: [n for n in names if n == "target" or n.startswith(".")], dirs_exist_ok=True)


def materialize(root: str, mutants: Iterable, folder: str) -> list[str]:
    """Write the clean tree and a tree a mutant (file, text and the label's columns); the cases' names in order.

    Mutants are handled one by one, so an iterator over a large set will do.
    """
    prepare(folder)
    copy_tree(root, os.path.join(folder, ORIGINAL))
    names = []
    for m in mutants:
        row = m.asDict() if hasattr(m, "asDict") else dict(m)
        name = f"{row['operator']}-{row['id']}"
        tree = os.path.join(folder, CASES, name)
        path = os.path.normpath(os.path.join(tree, row["file"]))
        if not path.startswith(os.path.normpath(tree) + os.sep) or not os.path.exists(os.path.join(root, row["file"])):
            raise ValueError(f"a rewrite lies outside the tree: {row['file']}")
        copy_tree(root, tree)
        with open(path, "w", encoding="utf-8") as f:
            f.write(row["text"])
        with open(os.path.join(tree, LABEL), "w", encoding="utf-8") as f:
            json.dump({k: row[k] for k in ("id", "class", "severity", "file", "line", "handler", "operator") if k in row}, f, indent=2, ensure_ascii=False)
        names.append(name)
    return names


def reject(folder: str, name: str, reason: str) -> dict:
    """Move a case to the rejected ones."""
    target = os.path.join(folder, REJECTED, name)
    shutil.rmtree(target, ignore_errors=True)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    os.rename(os.path.join(folder, CASES, name), target)
    return {"name": name, "reason": reason}
