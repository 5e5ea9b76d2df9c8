"""Whether the names of a program still mean something: the gate that mutants pass before they are scored.

There is no compiler here. What one would refuse in a mutant of a program that it
accepts is a name that no longer resolves: an account that a handler or a
constraint speaks of and the struct does not declare, a field that the account's
type does not have (an unchecked account has those of any account only), a bump
that is no longer derived, a ``has_one`` without the field or the account.

One scan of a file's tokens lists what is referred to, by scopes: a handler's
context argument and its accounts, names bound to them by ``let`` until their
block ends or another ``let`` takes the name, and the expressions of an accounts
struct, whose instruction arguments are known. Declarations and fields are the
program's own relations, and resolving is a join with them. Types from elsewhere
may have any field. Only what a mutant's clean program does not have too counts
against it, so what is not understood costs no mutant.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.lang.ir import Program, program
from lodestone.lang.lexer import Source, SyntaxProblem, lex
from lodestone.lang.parser import _fields, _inside, _items, _type
from lodestone.session import ship, stored

# What every account has, and methods that need an account's data to be of a type.
ANY_FIELDS = ("key", "is_signer", "is_writable", "lamports", "data", "owner", "executable", "rent_epoch")
TYPED_METHODS = ("reload", "set_inner", "into_inner", "exit", "load", "load_mut", "load_init")
_BARE = ("UncheckedAccount", "AccountInfo", "Signer", "SystemAccount", "Program")
_REFERENCE = "program string, file string, scope string, struct string, kind string, account string, member string, called boolean"


def _member(s: Source, i: int, end: int) -> tuple[str | None, bool]:
    """The name after a dot at a token, and whether it is called."""
    if i + 1 < end and s.text[i] == "." and s.kind[i + 1] == "name":
        k = i + 2
        if k + 1 < end and s.text[k] == "::":  # a turbofish
            while k < end and s.text[k] != "(":
                k += 1
        return s.text[i + 1], k < end and s.text[k] == "("
    return None, False


def _body(s: Source, a: int, b: int, context: str) -> Iterator[tuple[str, str, str | None, bool]]:
    """(kind, account, member, called) of a handler's body."""
    scopes: list[dict[str, str | None]] = [{}]
    bound: dict[int, tuple[str, str | None]] = {}  # where a let ends: the name and what it stands for; "" is all accounts

    def known(name: str) -> str | None:
        return next((x[name] for x in reversed(scopes) if name in x), None)

    i = a
    while i < b:
        t = s.text[i]
        if t == "{":
            scopes.append({})
        elif t == "}":
            scopes.pop()
        elif t == "let":
            k = i + 1 + (s.text[i + 1] == "mut")
            if s.kind[k] == "name" and s.text[k + 1] in ("=", ":"):
                eq = k + 1
                while eq < b and s.text[eq] not in ("=", ";"):
                    eq = s.mate[eq] + 1 if s.text[eq] in "([{" else eq + 1
                end = eq
                while end < b and s.text[end] != ";":
                    end = s.mate[end] + 1 if s.text[end] in "([{" else end + 1
                path = [x for x in s.text[eq + 1 : end] if x not in ("&", "mut")]
                if path[:3] == [context, ".", "accounts"] and len(path) in (3, 5):
                    bound[end] = s.text[k], path[4] if len(path) == 5 else ""
                elif len(path) == 3 and path[1] == "." and known(path[0]) == "":
                    bound[end] = s.text[k], path[2]
                else:
                    bound[end] = s.text[k], None
        elif s.kind[i] == "name" and (i == a or s.text[i - 1] not in (".", "::")):
            if t == context and s.text[i + 1 : i + 3] == [".", "bumps"]:
                name, called = _member(s, i + 3, b)
                if name and not called:
                    yield "bump", name, None, False
            else:
                at = i + 3 if t == context and s.text[i + 1 : i + 3] == [".", "accounts"] else i + 1 if known(t) == "" else None
                if at is not None:
                    name, called = _member(s, at, b)
                    if name and not called:
                        yield ("account", name, *_member(s, at + 2, b))
                elif known(t):
                    member, called = _member(s, i + 1, b)
                    if member:
                        yield "account", known(t), member, called
        if i in bound:
            name, path = bound.pop(i)
            scopes[-1][name] = path
        i += 1


def _expressions(s: Source, body: tuple[int, int], arguments: set[str]) -> Iterator[tuple[str, str, str, str | None, bool]]:
    """(kind, declaration, account, member, called) of an accounts struct's constraints."""
    for item, n, _ in _fields(s, body):
        for attr in item.attrs:
            if s.text[attr[0]] != "account" or attr[0] + 1 >= attr[1]:
                continue
            for p, q in s.parts(*_inside(s, attr)):
                eq = next((i for i in range(p, q) if s.text[i] == "="), None)
                if eq is None:
                    continue
                if s.text[p] == "has_one" and s.kind[eq + 1] == "name":
                    yield "has_one", s.text[n], s.text[eq + 1], None, False
                    continue
                stop = next((i for i in range(eq, q) if s.text[i] == "@"), q)
                for i in range(eq + 1, stop):
                    name = s.text[i]
                    if s.kind[i] != "name" or name in arguments or not (name[0].islower() or name[0] == "_") or s.text[i - 1] in (".", "::") or name in ("self", "crate", "super"):
                        continue
                    alone = i == eq + 1 and i + 1 == stop and s.text[p] in ("payer", "close")
                    member, called = _member(s, i + 1, stop)
                    if member or alone:
                        yield "account", s.text[n], name, member, called


def references(text: str) -> list[tuple[str, str, str, str, str | None, bool]]:
    """(scope, struct, kind, account, member, called) of a file; none of one that cannot be read."""
    out: list = []
    try:
        s = lex(text)
    except SyntaxProblem:
        return out

    def walk(a: int, b: int) -> None:
        for item, at, _ in _items(s, a, b):
            word = s.text[at]
            if word == "mod" and item.body:
                walk(*item.body)
            elif word == "fn" and item.body:
                k = at + 2
                while s.text[k] != "(":
                    k += 1
                args = s.parts(k + 1, s.mate[k])
                colon = next((i for i in range(*args[0]) if s.text[i] == ":"), None) if args else None
                if colon is not None:
                    name, inner = _type(s, colon + 1, args[0][1])
                    if name == "Context" and inner:
                        struct = _type(s, *inner[-1])[0]
                        out.append((s.text[at + 1], struct, "context", "", None, False))
                        out.extend((s.text[at + 1], struct, *r) for r in _body(s, *item.body, s.text[colon - 1]))
            elif word == "struct" and item.body:
                derive = item.attr(s, "derive")
                if derive and "Accounts" in s.names(*_inside(s, derive)):
                    given = item.attr(s, "instruction")
                    arguments = {s.text[i - 1] for i in range(*_inside(s, given)) if s.text[i] == ":"} if given else set()
                    for kind, decl, account, member, called in _expressions(s, item.body, arguments):
                        out.append((f"{s.text[at + 1]}.{decl}", s.text[at + 1], kind, account, member, called))

    try:
        walk(0, len(s.text))
    except (IndexError, KeyError):
        return []
    return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = {(p, f, *r) for p, f, text in zip(b["program"], b["path"], b["text"]) for r in references(text or "")}
        yield pd.DataFrame(sorted(rows, key=str), columns=[c.split()[0] for c in _REFERENCE.split(", ")])


def unresolved(p: Program, files: DataFrame) -> DataFrame:
    """(program, scope, reason): every reference that does not resolve, once."""
    ship(files.sparkSession)
    said = stored(files.select("program", "path", "text").mapInPandas(_scan, _REFERENCE), "references")
    structs = p.structs.select("program", F.col("name").alias("struct")).distinct()
    decls = p.decls.select("program", "struct", F.col("name").alias("account"), "wrapper", "state_ty", "has_seeds", "has_bump")
    states = p.states.select("program", F.col("name").alias("state_ty")).distinct().withColumn("own_type", F.lit(True))
    fields = p.fields.select("program", F.col("state").alias("state_ty"), F.col("field").alias("member")).distinct().withColumn("has_field", F.lit(True))
    quoted = lambda c: F.concat(F.lit("`"), F.col(c), F.lit("`"))
    reason = lambda df, *parts: df.select("program", "scope", F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("reason"))

    out = reason(said.where("kind = 'context'").join(structs, ["program", "struct"], "left_anti"), "no accounts struct ", quoted("struct"))
    inside = said.join(structs, ["program", "struct"], "left_semi")
    spoken = inside.where("kind in ('account', 'bump')")
    out = out.unionByName(reason(spoken.join(decls, ["program", "struct", "account"], "left_anti"), quoted("struct"), " has no account ", quoted("account")))
    typed = spoken.join(decls, ["program", "struct", "account"]).join(states, ["program", "state_ty"], "left").join(fields, ["program", "state_ty", "member"], "left")
    of_type = typed.where("kind = 'account' and member is not null and not called and own_type and has_field is null")
    out = out.unionByName(reason(of_type, quoted("state_ty"), " has no field ", quoted("member")))
    bare = typed.where(F.col("wrapper").isin(*_BARE) & (F.col("kind") == "account") & F.col("member").isNotNull())
    out = out.unionByName(reason(bare.where(F.when(F.col("called"), F.col("member").isin(*TYPED_METHODS)).otherwise(~F.col("member").isin(*ANY_FIELDS))), quoted("wrapper"), " ", quoted("account"), " has no ", quoted("member")))
    out = out.unionByName(reason(typed.where("kind = 'bump' and not has_bump and not has_seeds"), "no bump is derived for ", quoted("account")))
    # has_one: the declaration is the scope's last part, the account is the field's name and another declaration's
    one = inside.where("kind = 'has_one'").withColumn("target", F.col("account")).withColumn("account", F.substring_index("scope", ".", -1))
    out = out.unionByName(reason(one.join(decls.select("program", "struct", F.col("account").alias("target")), ["program", "struct", "target"], "left_anti"), quoted("struct"), " has no account ", quoted("target")))
    held = one.withColumn("member", F.col("target")).join(decls, ["program", "struct", "account"]).join(states, ["program", "state_ty"], "left").join(fields, ["program", "state_ty", "member"], "left")
    out = out.unionByName(reason(held.where("own_type and has_field is null"), quoted("state_ty"), " has no field ", quoted("target")))
    out = out.unionByName(reason(held.where(F.col("wrapper").isin(*_BARE)), quoted("wrapper"), " ", quoted("account"), " has no ", quoted("target")))
    return out.distinct()


def variants(files: DataFrame, made: DataFrame) -> DataFrame:
    """The files (program, path, text) of each mutant's whole program, its case's name as the program."""
    case = F.concat("program", F.lit("/"), F.concat_ws("-", "operator", "id"))
    changed = files.join(made.select("program", case.alias("case"), F.col("file").alias("changed"), F.col("text").alias("new")), "program")
    return changed.select(F.col("case").alias("program"), "path", F.when(F.col("path") == F.col("changed"), F.col("new")).otherwise(F.col("text")).alias("text"))


def gate(files: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): mutants that still resolve, and the others with ``reason``, the first by name of what does not."""
    case = F.concat("program", F.lit("/"), F.concat_ws("-", "operator", "id"))
    named = made.withColumn("case", case)
    every = files.unionByName(variants(files, made))
    found = stored(unresolved(program(every), every), "unresolved")
    clean = found.select(F.col("program").alias("own"), "scope", "reason")
    new = found.withColumnRenamed("program", "case").join(named.select("case", F.col("program").alias("own")), "case").join(clean, ["own", "scope", "reason"], "left_anti")
    why = stored(new.groupBy("case").agg(F.min(F.concat("scope", F.lit(": "), "reason")).alias("reason")), "rejected")
    return named.join(why, "case", "left_anti").drop("case"), named.join(why, "case").drop("case")
