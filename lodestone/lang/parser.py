"""Source text to rows: handlers with what their bodies do, accounts structs, state structs.

The parser reads the part of the language that the detectors need, from tokens
rather than a full syntax tree; what it does not know it passes over.
"""

from __future__ import annotations

from lodestone.lang.lexer import KEYWORDS, Source, SyntaxProblem, lex

# Calls that move value.
VALUE_SINKS = ("transfer", "transfer_checked", "burn", "mint_to")
CHECKS = {"require": "Require", "require_eq": "RequireEq", "require_neq": "RequireEq", "require_gt": "RequireEq", "require_gte": "RequireEq", "require_keys_eq": "RequireKeysEq", "require_keys_neq": "RequireKeysEq"}
CONSTRAINTS = {"mut": "Mut", "init": "Init", "init_if_needed": "InitIfNeeded", "signer": "SignerAttr", "close": "Close", "seeds": "Seeds", "bump": "Bump", "has_one": "HasOne", "owner": "Owner", "address": "Address"}
PLAIN_WRAPPERS = ("Signer", "UncheckedAccount", "AccountInfo", "SystemAccount")
TYPED_WRAPPERS = ("Account", "InterfaceAccount", "Program", "Sysvar")
_ARITHMETIC = {"+", "-", "*", "/", "+=", "-=", "*=", "/="}


class _Item:
    """Attributes, visibility and place of an item that begins at a token."""

    def __init__(self, s: Source, at: int, end: int):
        self.begin, self.attrs, i = at, [], at
        while i < end and s.text[i] == "#":
            k = i + 1 + (s.text[i + 1] == "!")
            self.attrs.append((k + 1, s.mate[k], s.line[i], s.line[s.mate[k]]))
            i = s.mate[k] + 1
        self.head = i
        self.public = i < end and s.text[i] == "pub"
        if self.public:
            i += 1
            if i < end and s.text[i] == "(":
                self.public = False
                i = s.mate[i] + 1
        while i < end and s.text[i] in ("const", "async", "unsafe", "extern"):
            i += 1
        self.at = i

    def attr(self, s: Source, name: str) -> tuple | None:
        return next((a for a in self.attrs if s.text[a[0]] == name and (a[0] + 1 == a[1] or s.text[a[0] + 1] == "(")), None)


def _inside(s: Source, attr: tuple) -> tuple[int, int]:
    """The tokens in an attribute's parentheses."""
    return (attr[0] + 2, attr[1] - 1) if attr[0] + 1 < attr[1] else (attr[1], attr[1])


def _items(s: Source, a: int, b: int):
    """The items of a stretch, each with the place of its body, if any."""
    i = a
    while i < b:
        item = _Item(s, i, b)
        j = item.at
        if j >= b:
            return
        stop = j
        while stop < b and s.text[stop] not in (";", "{"):
            stop = s.mate[stop] + 1 if s.text[stop] in "([" else stop + 1
        if stop < b and s.text[stop] == "{":
            item.body = (stop + 1, s.mate[stop])
            stop = s.mate[stop]
        else:
            item.body = None
        yield item, j, stop
        i = stop + 1


def _type(s: Source, a: int, b: int) -> tuple[str, list[tuple[int, int]]]:
    """The last name of a type's path, and its arguments."""
    while a < b and (s.text[a] in ("&", "mut", "dyn") or s.kind[a] == "life"):
        a += 1
    name, i = "", a
    while i < b and (s.kind[i] == "name" or s.text[i] == "::"):
        name = s.text[i] if s.kind[i] == "name" else name
        i += 1
    if i < b and s.text[i] == "<":
        end = b - 1
        while end > i and s.text[end] != ">":
            end -= 1
        return name, [p for p in s.parts(i + 1, end) if s.kind[p[0]] != "life"]
    return name, []


def _wrapper(s: Source, a: int, b: int) -> tuple[str, str | None, bool, bool]:
    """(wrapper, inner type, boxed, optional) of a declared account."""
    name, args = _type(s, a, b)
    if name in ("Box", "Option"):
        inner = _wrapper(s, *args[0]) if args else ("Other", name, False, False)
        return (inner[0], inner[1], True, inner[3]) if name == "Box" else (inner[0], inner[1], inner[2], True)
    if name in PLAIN_WRAPPERS:
        return name, None, False, False
    if name in TYPED_WRAPPERS:
        return name, _type(s, *args[-1])[0] if args else "", False, False
    return "Other", name, False, False


def _constraints(s: Source, item: _Item) -> list[dict]:
    out = []
    for attr in item.attrs:
        if s.text[attr[0]] != "account" or attr[0] + 1 >= attr[1] or s.text[attr[0] + 1] != "(":
            continue
        for a, b in s.parts(*_inside(s, attr)):
            eq = next((i for i in range(a, b) if s.text[i] == "="), None)
            key = s.text[a] if (eq if eq is not None else b) == a + 1 else ""
            value = s.written(eq + 1, b) if eq is not None else None
            kind = CONSTRAINTS.get(key, "Raw")
            if kind == "HasOne":
                value = (value or "").split("@")[0].strip()
            elif kind == "Raw":
                value = f"{key} = {value}" if value else key
            elif kind in ("Mut", "Init", "InitIfNeeded", "SignerAttr"):
                value = None
            out.append({"kind": kind, "payload": value})
    return out


def _fields(s: Source, body: tuple[int, int]):
    """The named fields of a struct: (item, place of the name, type stretch)."""
    for a, b in s.parts(*body):
        item = _Item(s, a, b)
        if item.at + 2 < b + 0 and s.kind[item.at] == "name" and s.text[item.at + 1] == ":":
            yield item, item.at, (item.at + 2, b)


class _Body:
    """What a handler's body does, in one pass over its tokens."""

    def __init__(self, s: Source, a: int, b: int):
        self.s, self.a, self.b = s, a, b
        self.arith, self.calls, self.checks, self.writes = [], [], [], []
        self.alias: dict[str, str] = {}
        self.taint: dict[str, set[str]] = {}
        self.sinks: set[str] = set()
        self.skip: list[tuple[int, int]] = []
        self._walk()

    def _chain_begin(self, end: int) -> int:
        """The first token of the postfix chain that ends before ``end``."""
        s, i = self.s, end - 1
        while i >= self.a:
            t = s.text[i]
            if t in (")", "]"):
                i = s.mate[i] - 1
                if i >= self.a and (s.kind[i] == "name" and s.text[i] not in KEYWORDS or s.text[i] in (">", "?")):
                    continue
                return i + 1
            if t == "?":
                i -= 1
                continue
            if s.kind[i] in ("name", "number", "text"):
                if s.text[i] in KEYWORDS:
                    return i + 1
                if i - 1 >= self.a and s.text[i - 1] in (".", "::"):
                    i -= 2
                    continue
                return i
            return i + 1
        return self.a

    def _root(self, a: int, b: int) -> str | None:
        """The account that a pure chain of fields and calls comes from."""
        s, names, i = self.s, [], a
        while i < b:
            if s.kind[i] != "name":
                return None
            name, i = s.text[i], i + 1
            while i + 1 < b and s.text[i] == "::" and s.kind[i + 1] == "name":
                name, i = s.text[i + 1], i + 2
            called = i < b and s.text[i] == "("
            if called:
                if not names:
                    return None
                i = s.mate[i] + 1
            else:
                names.append(name)
            if i < b and s.text[i] != ".":
                return None
            i += 1
        if names[:2] == ["ctx", "accounts"] and len(names) > 2:
            return names[2]
        return self.alias.get(names[0]) if names else None

    def _tainted(self, a: int, b: int) -> set[str]:
        """The accounts that the expressions of a stretch come from."""
        s, out, i = self.s, set(), a
        while i < b:
            if s.kind[i] != "name" or s.text[i] in KEYWORDS or i > a and s.text[i - 1] in (".", "::"):
                i += 1
                continue
            end = i + 1
            while end < b and (s.text[end] in (".", "::", "?") or s.kind[end] in ("name", "number") and s.text[end - 1] in (".", "::") or s.text[end] == "(" and s.kind[end - 1] == "name"):
                end = s.mate[end] + 1 if s.text[end] == "(" else end + 1
            stop = end
            while stop > i and s.text[stop - 1] == "?":
                stop -= 1
            root = None
            for cut in range(stop, i, -1):
                if cut == stop or s.text[cut] in (".", "?"):
                    root = self._root(i, cut)
                    if root:
                        break
            if root:
                out.add(root)
            elif i + 1 >= b or s.text[i + 1] != ":" or s.text[i + 1] == "::":
                out |= self.taint.get(s.text[i], set())
            i += 1
        return out

    def _lamports(self, a: int, b: int) -> bool:
        text = "".join(self.s.text[a:b])
        return "lamports" in text and "borrow_mut" in text

    def _statement_begin(self, i: int) -> int:
        """The first token of the expression that is assigned to before token i."""
        begin = self._chain_begin(i)
        while begin > self.a and self.s.text[begin - 1] in ("*", "&"):
            begin -= 1
        return begin

    def _end_of(self, i: int) -> int:
        """The end of the expression that begins at i: a semicolon, comma or closing bracket."""
        s = self.s
        while i < self.b and s.text[i] not in (";", ","):
            if s.text[i] in ("(", "[", "{"):
                i = s.mate[i] + 1
            elif s.text[i] in (")", "]", "}"):
                return i
            else:
                i += 1
        return i

    def _walk(self) -> None:
        s, i = self.s, self.a
        while i < self.b:
            t, prev = s.text[i], s.text[i - 1] if i > self.a else ";"
            after = s.text[i + 1] if i + 1 < self.b else ""
            if s.kind[i] == "name" and after == "!" and i + 2 < self.b and s.text[i + 2] in ("(", "[", "{"):
                if t in CHECKS:
                    inner = (i + 3, s.mate[i + 2])
                    self.checks.append({"kind": CHECKS[t], "idents": s.names(*inner), "text": s.written(*inner), "line": s.line[i]})
                i = s.mate[i + 2] + 1
                continue
            if t == "#" and after == "[":
                i = s.mate[i + 1] + 1
                continue
            if t == "let":
                self._let(i)
            elif t == "if" and after != "let":
                self._if(i)
            elif s.kind[i] == "name" and t not in KEYWORDS and after == "(":
                self._call(i, prev)
            elif s.kind[i] == "name" and prev == "." and after == "::" and i + 2 < self.b and s.text[i + 2] == "<":
                self._call(i, prev)
            elif t in _ARITHMETIC and self._binary(i):
                self._arith(i, t)
            elif t == "=" and prev not in (";", "{", "}"):
                self._assign(i)
            i += 1

    def _binary(self, i: int) -> bool:
        s, p = self.s, i - 1
        if p < self.a:
            return False
        if s.kind[p] == "name":
            return s.text[p] not in KEYWORDS
        return s.kind[p] in ("number", "text") or s.text[p] in (")", "]", "?")

    def _let(self, i: int) -> None:
        s, k = self.s, i + 1
        if k < self.b and s.text[k] == "mut":
            k += 1
        eq, end = k, self._end_of(k)
        while eq < end and s.text[eq] != "=":
            eq = s.mate[eq] + 1 if s.text[eq] in ("(", "[", "{") else eq + 1
        if s.kind[k] != "name" or eq >= end or s.text[k + 1] not in (":", "="):
            return
        a = eq + 1
        if s.text[a] == "&":
            b = a + 1 + (s.text[a + 1] == "mut")
            root = self._root(b, end)
            if root:
                self.alias[s.text[k]] = root
        self.taint[s.text[k]] = self._tainted(a, end)

    def _if(self, i: int) -> None:
        s, k = self.s, i + 1
        while k < self.b and s.text[k] != "{":
            k = s.mate[k] + 1 if s.text[k] in ("(", "[") else k + 1
        if k >= self.b:
            return
        branch = "".join(s.text[k : s.mate[k] + 1])
        if any(x in branch for x in ("returnErr", "returnerr!", "Err(", "panic!", "unreachable!")):
            self.checks.append({"kind": "ManualIf", "idents": s.names(i + 1, k), "text": s.written(i + 1, k), "line": s.line[i]})

    def _call(self, i: int, prev: str) -> None:
        s = self.s
        k = i + 1
        while k < self.b and s.text[k] != "(":
            k += 1
        if k >= self.b:
            return
        args = (k + 1, s.mate[k])
        name, method = s.text[i], prev == "."
        begin = self._chain_begin(i + 1)
        if not method:
            name = "".join(s.text[begin : i + 1])
        cpi = not method and (name.endswith(("invoke", "invoke_signed")) or "CpiContext" in name or "CpiContext" in s.text[args[0] : args[1]])
        self.calls.append({"name": name, "line": s.line[begin], "is_cpi": cpi})
        if method and name.startswith(("checked_", "saturating_", "wrapping_")):
            self.arith.append({"op": name, "line": s.line[begin], "checked": True})
        if name.rpartition("::")[2] in VALUE_SINKS:
            self.sinks |= self._tainted(begin if method else args[0], args[1])

    def _arith(self, i: int, op: str) -> None:
        s, begin = self.s, self._statement_begin(i) if len(op) == 2 else self._chain_begin(i)
        self.arith.append({"op": op, "line": s.line[begin], "checked": False})
        if len(op) == 2:
            self._written(begin, i)

    def _assign(self, i: int) -> None:
        begin = self._statement_begin(i)
        before = self.s.text[begin - 1] if begin > self.a else ";"
        if before in (";", "{", "}", "=>", ")"):
            self._written(begin, i)

    def _written(self, begin: int, i: int) -> None:
        if self._lamports(begin, i):
            self.sinks |= self._tainted(begin, i) | self._tainted(i + 1, self._end_of(i + 1))
        root = self._root(begin, i)
        if root:
            self.writes.append({"account": root, "line": self.s.line[begin]})


def _handler(s: Source, item: _Item, at: int) -> dict | None:
    """A public function whose first argument is a context, as a row."""
    if not item.public or s.text[at] != "fn" or item.body is None:
        return None
    k = at + 2
    while s.text[k] != "(":
        k += 1
    args = s.parts(k + 1, s.mate[k])
    typed = [(a, next((i for i in range(a, b) if s.text[i] == ":"), None), b) for a, b in args]
    if not typed or typed[0][1] is None:
        return None
    name, inner = _type(s, typed[0][1] + 1, typed[0][2])
    if name != "Context" or not inner:
        return None
    body = _Body(s, *item.body)
    checks = [{"kind": "AccessControl", "idents": s.names(*_inside(s, a)), "text": s.written(*_inside(s, a)), "line": a[2]} for a in item.attrs if s.text[a[0]] == "access_control"]
    return {
        "name": s.text[at + 1], "line": s.line[item.begin], "end_line": s.line[item.body[1]], "context_ty": _type(s, *inner[-1])[0],
        "args": [{"name": s.text[c - 1], "ty": s.written(c + 1, b)} for a, c, b in typed[1:] if c is not None],
        "arith": body.arith, "calls": body.calls, "checks": checks + body.checks, "writes": body.writes, "sinks": sorted(body.sinks),
    }


def _module(s: Source, a: int, b: int, handlers: bool, out: list[tuple[str, dict]]) -> None:
    for item, at, _ in _items(s, a, b):
        word = s.text[at]
        if word == "mod" and item.body:
            _module(s, *item.body, item.attr(s, "program") is not None, out)
        elif word == "fn" and handlers:
            row = _handler(s, item, at)
            if row:
                out.append(("handler", row))
        elif word == "struct" and item.body:
            place = {"name": s.text[at + 1], "line": s.line[item.begin], "end_line": s.line[item.body[1]]}
            derive = item.attr(s, "derive")
            if derive and "Accounts" in s.names(*_inside(s, derive)):
                decls = []
                for f, n, ty in _fields(s, item.body):
                    wrapper, inner, boxed, optional = _wrapper(s, *ty)
                    own = next((x for x in f.attrs if s.text[x[0]] == "account"), None)
                    decls.append({"name": s.text[n], "wrapper": wrapper, "inner_ty": inner, "boxed": boxed, "optional": optional, "line": s.line[n], "attr_line": own[2] if own else 0, "attr_end_line": own[3] if own else 0, "constraints": _constraints(s, f)})
                out.append(("accounts", place | {"decls": decls}))
            elif item.attr(s, "account"):
                out.append(("state", place | {"fields": [{"name": s.text[n], "ty": "".join(s.text[t[0] : t[1]])} for _, n, t in _fields(s, item.body)]}))


def parse(text: str) -> list[tuple[str, dict]]:
    """The rows of one file, as (kind, row); SyntaxProblem where it cannot be read."""
    s = lex(text)
    out: list[tuple[str, dict]] = []
    try:
        _module(s, 0, len(s.text), False, out)
    except (IndexError, KeyError) as e:
        raise SyntaxProblem(f"unexpected end of an item ({e})") from e
    return out
