"""Labelled defects: one rewrite of a source text for each site that an operator fits.

An operator is a function from a file's tokens and its sites to edits (offset
ranges with replacements), so formatting outside the edit is untouched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.constants import AUTHORITY_WORDS, GENERIC_SUFFIXES
from lodestone.functions.text import stable_id
from lodestone.lang.ir import Program
from lodestone.lang.lexer import Source, SyntaxProblem, lex
from lodestone.lang.parser import _constraints, _fields, _inside, _items, _wrapper, parse
from lodestone.session import ship

# Operator, class, severity.
OPERATORS = {
    "signer_to_account_info": ("missing-signer", "critical"),
    "account_to_unchecked": ("missing-owner-check", "high"),
    "strip_has_one": ("missing-authority-binding", "high"),
    "strip_constraint": ("removed-guard", "high"),
    "strip_seeds_bump": ("pda-validation-gap", "high"),
    "checked_to_bare": ("unchecked-arithmetic", "medium"),
}
CHECKED = {"checked_add": "+", "checked_sub": "-", "checked_mul": "*", "checked_div": "/"}
_UNWRAPS = ("unwrap", "expect", "ok_or", "ok_or_else", "unwrap_or")
_NOTE = "/// CHECK: deliberately unchecked\n"

Edit = tuple[int, int, str]


def _is_authority(name: str) -> bool:
    parts = [p for p in name.lower().split("_") if p]
    says = lambda p: any(w in p for w in AUTHORITY_WORDS)
    return bool(parts) and (says(parts[-1]) or (len(parts) > 1 and parts[-1] in GENERIC_SUFFIXES and says(parts[-2])))


def _structs(s: Source, a: int, b: int) -> Iterator[tuple[str, tuple[int, int]]]:
    for item, at, _ in _items(s, a, b):
        if s.text[at] == "mod" and item.body:
            yield from _structs(s, *item.body)
        elif s.text[at] == "struct" and item.body:
            yield s.text[at + 1], item.body


def _end(s: Source, i: int) -> int:
    return s.at[i] + len(s.text[i])


def _line_begin(text: str, at: int) -> int:
    return text.rfind("\n", 0, at) + 1


def _noted(text: str, at: int) -> Edit:
    """A note on the line above, as deep as the declaration."""
    begin = _line_begin(text, at)
    indent = re.match(r"[ \t]*", text[begin:]).group()
    return begin, begin, indent + _NOTE


def _retyped(s: Source, text: str, name: int, ty: tuple[int, int], new: str, keep: bool) -> list[Edit]:
    """The wrapper's name replaced; its type argument dropped unless kept."""
    head = ty[0]
    while head + 2 < ty[1] and s.text[head + 1] == "::":
        head += 2
    edits = [_noted(text, s.at[name]), (s.at[head], _end(s, head), new)]
    if not keep and head + 1 < ty[1] and s.text[head + 1] == "<":
        args = s.parts(head + 2, ty[1] - 1)
        lives = [a for a in args if s.kind[a[0]] == "life"]
        inner = ", ".join(s.text[a[0]] for a in lives)
        edits[1] = (s.at[head], _end(s, ty[1] - 1), f"{new}<{inner}>" if inner else new)
    return edits


def _redundant(item: str, constraints: list[dict]) -> bool:
    """Whether a binding says what the account's seeds say already."""
    flat = re.sub(r"\s+", "", item)
    one = re.fullmatch(r"has_one=([^@]*?),?(@.*)?", flat)
    same = re.fullmatch(r"constraint=[^.=]*\.(\w+)==(\w+)\.key\(\),?(@.*)?", flat)
    target = one.group(1) if one else same.group(2) if same and same.group(1) == same.group(2) else ""
    return bool(target) and any(c["kind"] == "Seeds" and f"{target}.key()" in re.sub(r"\s+", "", c["payload"] or "") for c in constraints)


def _cut(s: Source, text: str, part: tuple[int, int]) -> Edit:
    """An item of an attribute with the comma behind it, and its line if nothing else is on it."""
    a, b = s.at[part[0]], _end(s, part[1] - 1)
    if part[1] < len(s.text) and s.text[part[1]] == ",":
        b = _end(s, part[1])
    else:  # the last item takes the comma before it
        if s.text[part[0] - 1] == ",":
            a = s.at[part[0] - 1]
    begin = _line_begin(text, a)
    stop = text.find("\n", b)
    if not text[begin:a].strip() and stop >= 0 and not text[b:stop].strip():
        return begin, stop + 1, ""
    while b < len(text) and text[b] == " ":
        b += 1
    return a, b, ""


def _declared(s: Source, text: str, sites: dict[tuple[str, str], str]) -> Iterator[tuple[str, str, str, list[Edit]]]:
    """(operator, handler, site, edits) for declarations that are in the sites (struct, declaration) -> handler."""
    for struct, body in _structs(s, 0, len(s.text)):
        for item, n, ty in _fields(s, body):
            name = s.text[n]
            handler = sites.get((struct, name))
            if handler is None:
                continue
            wrapper, _, boxed, optional = _wrapper(s, *ty)
            has = _constraints(s, item)
            kinds = {c["kind"] for c in has}
            bare = not boxed and not optional
            if wrapper == "Signer" and bare and _is_authority(name) and not kinds & {"Address", "Owner", "SignerAttr"}:
                yield "signer_to_account_info", handler, name, _retyped(s, text, n, ty, "AccountInfo", True)
            attr = next((a for a in item.attrs if s.text[a[0]] == "account" and a[0] + 1 < a[1]), None)
            written = text[s.at[attr[0]] : _end(s, attr[1])] if attr else ""
            if wrapper == "Account" and bare and not kinds & {"Init", "InitIfNeeded", "Close", "HasOne"} and f"{name}." not in written:
                yield "account_to_unchecked", handler, name, _retyped(s, text, n, ty, "UncheckedAccount", False)
            if attr is None:
                continue
            parts = [(s.text[a], (a, b)) for a, b in s.parts(*_inside(s, attr))]
            for op, key in (("strip_has_one", "has_one"), ("strip_constraint", "constraint")):
                for k, p in parts:
                    if k == key and not _redundant(text[s.at[p[0]] : _end(s, p[1] - 1)], has):
                        yield op, handler, f"{name}@{s.at[p[0]]}", [_cut(s, text, p)]
            derived = [p for k, p in parts if k in ("seeds", "bump")]
            if derived:
                yield "strip_seeds_bump", handler, f"{name}@{s.at[derived[0][0]]}", [_cut(s, text, p) for p in derived]


def _computed(s: Source, text: str, handlers: set[str]) -> Iterator[tuple[str, str, str, list[Edit]]]:
    """Checked calls of the handlers' bodies as bare operators."""

    def bodies(a: int, b: int, inside: bool):
        for item, at, _ in _items(s, a, b):
            if s.text[at] == "mod" and item.body:
                yield from bodies(*item.body, item.attr(s, "program") is not None)
            elif inside and s.text[at] == "fn" and item.body and s.text[at + 1] in handlers:
                yield s.text[at + 1], item.body

    for handler, (a, b) in bodies(0, len(s.text), False):
        seen: dict[int, int] = {}
        for i in range(a, b):
            if s.text[i] not in CHECKED or s.text[i - 1] != "." or s.text[i + 1] != "(":
                continue
            close = s.mate[i + 1]
            if close == i + 2:
                continue
            end, used = close + 1, False
            if s.text[end] == "." and s.text[end + 1] in _UNWRAPS and s.text[end + 2] == "(":
                end, used = s.mate[end + 2] + 1, True
            if s.text[end] == "?":
                end, used = end + 1, True
            begin = i - 1
            while begin > a:
                t = s.text[begin - 1]
                if t in (")", "]"):
                    begin = s.mate[begin - 1]
                elif s.kind[begin - 1] in ("name", "number") and t not in ("return", "let", "mut", "in", "if", "else", "match") or t == ".":
                    begin -= 1
                else:
                    break
                if s.kind[begin] in ("name", "number") and s.text[begin - 1] != ".":
                    break
            if not used or begin == i - 1 or s.line[begin] != s.line[end - 1]:
                continue
            nth = seen.get(s.line[i], 0)
            seen[s.line[i]] = nth + 1
            new = f"{text[s.at[begin] : s.at[i - 1]]} {CHECKED[s.text[i]]} {text[_end(s, i + 1) : s.at[close]].strip()}"
            yield "checked_to_bare", handler, f"{s.line[i]}#{nth}", [(s.at[begin], _end(s, end - 1), new)]


def edited(text: str, edits: list[Edit]) -> str:
    """The text with its edits; deletions that overlap (two items may claim one comma) are one."""
    apart: list[Edit] = []
    for a, b, new in sorted(edits):
        if apart and a < apart[-1][1] and not new and not apart[-1][2]:
            apart[-1] = (apart[-1][0], max(b, apart[-1][1]), "")
        else:
            apart.append((a, b, new))
    edits = apart
    for a, b, new in sorted(edits, reverse=True):
        text = text[:a] + new + text[b:]
    return text


def mutate_file(text: str, sites: dict[tuple[str, str], str], handlers: set[str]) -> list[tuple[str, str, str, int, str]]:
    """(operator, handler, site, first changed line, new text) for each defect; all still parse."""
    try:
        s = lex(text)
    except SyntaxProblem:
        return []
    out = []
    for op, handler, site, edits in [*_declared(s, text, sites), *_computed(s, text, handlers)]:
        after = edited(text, edits)
        try:
            parse(after)
        except SyntaxProblem:
            continue
        first = next((i for i, (x, y) in enumerate(zip(text.split("\n"), after.split("\n")), 1) if x != y), None)
        if after != text and first:
            out.append((op, handler, site, first, after))
    return out


def mutants(p: Program, files: DataFrame) -> DataFrame:
    """(program, id, class, severity, file, line, handler, operator, text): one row a defect.

    A declaration belongs to the first handler, by (file, place), that takes its
    struct. The gate is that the mutant still parses; there is no compiler here.
    """
    ship(files.sparkSession)
    first = p.handlers.groupBy("program", F.col("context_ty").alias("struct")).agg(F.min(F.struct("file", "pos", "name")).alias("h"))
    declared = p.decls.select("program", "struct", "file", "name").join(first, ["program", "struct"]).groupBy("program", F.col("file").alias("path")).agg(F.collect_list(F.struct("struct", "name", F.col("h.name").alias("handler"))).alias("sites"))
    own = p.handlers.groupBy("program", F.col("file").alias("path")).agg(F.collect_set("name").alias("handlers"))
    whole = files.join(declared, ["program", "path"], "left").join(own, ["program", "path"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                sites = {(x["struct"], x["name"]): x["handler"] for x in json.loads(r.sites)}
                for op, handler, site, line, text in mutate_file(r.text, sites, set(json.loads(r.handlers))):
                    rows.append((r.program, r.path, op, handler, site, line, text, *OPERATORS[op]))
            yield pd.DataFrame(rows, columns=["program", "file", "operator", "handler", "site", "line", "text", "class", "severity"])

    packed = whole.select("program", "path", "text", F.coalesce(F.to_json("sites"), F.lit("[]")).alias("sites"), F.coalesce(F.to_json("handlers"), F.lit("[]")).alias("handlers"))
    made = packed.mapInPandas(run, "program string, file string, operator string, handler string, site string, line int, text string, class string, severity string")
    return made.select("program", stable_id(F.col("operator"), F.col("file"), F.col("handler"), F.col("line").cast("string"), F.col("site")).alias("id"), "class", "severity", "file", "line", "handler", "operator", "text")
