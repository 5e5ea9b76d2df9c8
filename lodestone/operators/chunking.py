"""Heading-aware chunks of normalised pages, by expressions alone.

A source is cut where it lies, without a shuffle: its lines are an array, the
boundary lines (headings and finding ids) are found by place, a fold over them
keeps the headings in force, sections are slices between them, and a second fold
gathers small sections. Folds run over boundaries and sections, never over lines,
so that no text is copied once a line.

Cases: a null, empty or blank text has no chunks; a text without boundaries is one
section without a name; a blank tail goes; null titles are empty and null tags none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.constants import MERGE_BELOW
from lodestone.functions.text import class_tags, is_finding_id, is_heading, lines, split_oversized, trim

_DASH = " — "


def bound(value: Column, f) -> Column:
    """f of a value that is made once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def boundaries(ls: Column) -> Column:
    """The boundary lines of an array of lines: place, depth and words; a finding id is as deep as a top heading."""
    depth = lambda line: F.when(is_heading(line), F.length(F.regexp_extract(line, "^(#{1,4}) ", 1))).when(is_finding_id(line), 1).otherwise(0)
    marked = F.filter(F.transform(ls, lambda line, i: F.struct(i.alias("at"), depth(line).alias("depth"), line.alias("line"))), lambda m: m["depth"] > 0)
    return F.transform(marked, lambda m: F.struct(m["at"].alias("at"), m["depth"].alias("depth"), trim(F.regexp_replace(m["line"], "^#+", "")).alias("head")))


def paths(marks: Column) -> Column:
    """For each boundary the headings in force from the root down, as one name."""
    empty = F.array().cast("array<string>")

    def enter(s: Column, m: Column) -> Column:
        above = F.slice(F.concat(s["stack"], F.array_repeat(F.lit(""), m["depth"])), F.lit(1), m["depth"] - 1)
        return bound(F.concat(above, F.array(m["head"])), lambda stack: F.struct(stack.alias("stack"), F.array_append(s["out"], F.array_join(F.filter(stack, lambda x: x != ""), _DASH)).alias("out")))

    return F.aggregate(marks, F.struct(empty.alias("stack"), empty.alias("out")), enter, lambda s: s["out"])


def sections(ls: Column, marks: Column, names: Column) -> Column:
    """(name, text) from one boundary to the next; lines before the first one have no name."""
    lead = F.coalesce(F.get(marks, F.lit(0))["at"], F.lit(1)) > 0
    none = F.array().cast("array<int>")
    begins = F.concat(F.when(lead, F.array(F.lit(0))).otherwise(none), F.transform(marks, lambda m: m["at"]))
    named = F.concat(F.when(lead, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")), names)

    def cut(begin: Column, named: Column) -> Column:
        end = lambda i: F.coalesce(F.get(begin, i + 1), F.size(ls))
        text = lambda a, i: F.concat(F.array_join(F.slice(ls, a + 1, end(i) - a), "\n"), F.lit("\n"))
        return F.transform(begin, lambda a, i: F.struct(F.get(named, i).alias("name"), text(a, i).alias("text")))

    kept = lambda all_: F.filter(all_, lambda s, i: (i + 1 < F.size(all_)) | F.rlike(s["text"], F.lit(r"(?U)\S")))
    return bound(bound(named, lambda n: bound(begins, lambda b: cut(b, n))), kept)


def gathered(parts: Column) -> Column:
    """Sections joined until what is gathered has enough bytes; the name deepens but is not replaced."""
    kind = "array<struct<name:string,text:string>>"
    begin = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("text"))
    state = lambda done, name, text: F.struct(done.alias("done"), name.alias("name"), text.alias("text"))
    close = lambda s: F.when(s["text"].isNull(), s["done"]).otherwise(F.array_append(s["done"], F.struct(s["name"].alias("name"), s["text"].alias("text"))))

    def add(s: Column, p: Column) -> Column:
        small = F.coalesce(F.octet_length(trim(s["text"])) < MERGE_BELOW, F.lit(False))
        deeper = s["name"].isNull() | F.coalesce((F.length(p["name"]) > F.length(s["name"])) & F.startswith(p["name"], s["name"]), F.lit(False))
        return F.when(small, state(s["done"], F.when(deeper, p["name"]).otherwise(s["name"]), F.concat(s["text"], p["text"]))).otherwise(state(close(s), p["name"], p["text"]))

    return F.aggregate(parts, begin, add, close)


def pieces_of(chunk: Column, title: Column) -> Column:
    """(title, text) of a gathered chunk's pieces: led by its name unless it says it, cut where it is too large."""
    name, text = chunk["name"], chunk["text"]
    led = F.when(name.isNotNull() & ~F.contains(text, name), F.concat(name, F.lit("\n\n"), text)).otherwise(text)
    plain = name.isNull() | (trim(name) == "") | (name == title)
    named = F.when(plain, title).otherwise(F.concat(title, F.lit(_DASH), name))
    return F.transform(split_oversized(led), lambda x: F.struct(named.alias("title"), x.alias("text")))


def chunk_sources(sources: DataFrame) -> DataFrame:
    """Chunks of rows (source_id, url, title, text, class_tags)."""
    rows = sources.select(F.col("source_id").cast("string").alias("source_id"), "url", F.coalesce("title", F.lit("")).alias("title"), "text", F.coalesce("class_tags", F.array().cast("array<string>")).alias("tags"))
    rows = rows.where(F.rlike("text", F.lit(r"(?U)\S")))
    chunks = bound(lines(F.col("text")), lambda ls: bound(boundaries(ls), lambda marks: gathered(sections(ls, marks, paths(marks)))))
    every = F.flatten(F.transform(chunks, lambda c: pieces_of(c, F.col("title"))))
    out = rows.select("source_id", "url", "tags", F.posexplode(every).alias("chunk_ix", "c"))
    return out.select(
        F.concat("source_id", F.lit("#"), F.col("chunk_ix").cast("string")).alias("doc_id"), "source_id", "chunk_ix", F.col("url").alias("source_url"),
        "c.title", "c.text", class_tags(F.col("c.text"), F.col("tags")).alias("class_tags"),
    )
