"""Text expressions: lines, boundaries, tags, tokens and safe paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.constants import AUTHORITY_WORDS, CLASS_TAGS, GENERIC_SUFFIXES, QUERY_SYNTAX, SPLIT_ABOVE

_SPACE = r"(?U)\s+"


def trim(x: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def compact(x: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(x, _SPACE, "")


def lines(x: Column) -> Column:
    """The lines of a text; no empty last one where the text ends with a line feed."""
    parts = F.split(x, "\r?\n")
    return F.when(F.endswith(x, F.lit("\n")) | (F.length(x) == 0), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_count(x: Column) -> Column:
    """How many lines a text has, without making them."""
    feeds = F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    return feeds + F.when((F.length(x) > 0) & ~F.endswith(x, F.lit("\n")), 1).otherwise(0)


def line_slice(x: Column, first: int | Column, last: int | Column) -> Column:
    """Lines first to last, counted from 1; empty where there are none."""
    a, b = (F.lit(v) if isinstance(v, int) else v for v in (first, last))
    return F.when((a >= 1) & (b >= a), F.array_join(F.slice(lines(x), a, b - a + 1), "\n")).otherwise("")


def is_heading(line: Column) -> Column:
    return F.rlike(line, F.lit("^#{1,4} "))


def is_finding_id(line: Column) -> Column:
    """Two to five capitals, a dash, and a run of capitals, digits and dashes with a digit, not followed by a letter or digit."""
    return F.rlike(line, F.lit(r"^\[?[A-Z]{2,5}-(?=[A-Z0-9-]*[0-9])[A-Z0-9-]++(?![\p{L}\p{N}])"))


def decode_entities(x: Column) -> Column:
    """Pilcrows out, then entities, the ampersand last so that nothing is decoded twice."""
    for a, b in (("¶", ""), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def tidy_blank_lines(x: Column) -> Column:
    """Each line without trailing white space, and at most one empty line in a row."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)[\s&&[^\n]]+(?=\n|\z)", ""), r"\n{3,}", "\n\n")


def split_oversized(x: Column, limit: int = SPLIT_ABOVE) -> Column:
    """Pieces of at most so many bytes, cut at line ends; a longer line stays whole and a blank tail goes."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(s: Column, line: Column) -> Column:
        full = (s["now"] != "") & (F.octet_length(s["now"]) + F.octet_length(line) + 1 > limit)
        return F.struct(F.when(full, F.array_append(s["done"], s["now"])).otherwise(s["done"]).alias("done"), F.when(full, F.concat(line, F.lit("\n"))).otherwise(F.concat(s["now"], line, F.lit("\n"))).alias("now"))

    pieces = F.aggregate(lines(x), start, add, lambda s: F.when(F.rlike(s["now"], F.lit(r"(?U)\S")), F.array_append(s["done"], s["now"])).otherwise(s["done"]))
    return F.when(F.octet_length(x) <= limit, F.array(x)).otherwise(pieces)


def class_tags(text: Column, inherited: Column) -> Column:
    """A source's tags and those that the text names, sorted and distinct."""
    low = F.lower(text)
    found = F.filter(F.array(*[F.lit(t) for t in CLASS_TAGS]), lambda t: F.contains(low, t))
    return F.array_sort(F.array_union(inherited, found))


def tokens(x: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(q: Column) -> Column:
    """A query's terms: syntax characters become spaces, and each term is a phrase of tokens."""
    plain = F.translate(q, QUERY_SYNTAX, " " * len(QUERY_SYNTAX))
    return F.filter(F.transform(F.split(plain, r"(?U)\s+"), tokens), lambda p: F.size(p) > 0)


def strip_fences(x: Column) -> Column:
    """Without the lines that open or close a code fence."""
    return F.array_join(F.filter(lines(x), lambda l: ~F.rlike(l, F.lit("(?U)^\\s*```"))), "\n")


def is_unsafe_path(path: Column) -> Column:
    """Absolute, or with a step to the parent."""
    return F.rlike(path, F.lit(r"^/|(^|/)\.\.(/|$)"))


def is_included(path: Column, includes: Column) -> Column:
    """Whether a path below an archive's top folder begins with one of the prefixes; no prefixes include all."""
    below = F.regexp_replace(path, "^[^/]*/", "")
    return (F.size(includes) == 0) | F.exists(includes, lambda p: F.startswith(below, F.regexp_replace(p, "^/+", "")))


def is_authority(name: Column) -> Column:
    """Whether an account's name says that it is privileged, by its last part that means something."""
    parts = F.filter(F.split(F.lower(name), "_"), lambda p: p != "")
    says = lambda part: F.coalesce(F.rlike(part, F.lit("|".join(AUTHORITY_WORDS))), F.lit(False))
    last, before = F.get(parts, F.size(parts) - 1), F.get(parts, F.size(parts) - 2)
    return says(last) | (F.coalesce(last.isin(*GENERIC_SUFFIXES), F.lit(False)) & (F.size(parts) >= 2) & says(before))


def mentions(text: Column, needle: str, bounded: bool = False) -> Column:
    """Whether a text has a string that does not begin (and end, if bounded) inside an identifier."""
    from re import escape

    return F.rlike(text, F.lit(r"(?<![A-Za-z0-9_])" + escape(needle) + (r"(?![A-Za-z0-9_])" if bounded else "")))


def stable_id(*parts: Column) -> Column:
    """Sixteen hex digits that are equal just for equal parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 16)


def relative_uri(path: Column, base: str) -> Column:
    """A path below the base, with forward slashes; others only get the slashes."""
    p, b = F.replace(path, F.lit("\\"), F.lit("/")), base.replace("\\", "/").rstrip("/")
    return F.when(F.startswith(p, F.lit(b + "/")), F.substring(p, len(b) + 2, 1_000_000)).otherwise(p)
