"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Four ratios of a text (symbols to characters, exclamation marks to words,
repeated lines to lines, repeated words to words) are compared with cutoffs that
get stricter from level to level. A document's reject level is the first level
at which one of its ratios reaches its cutoff. For each stratum (the language)
the labelled good documents are the holdout: going from the loosest level to the
strictest, a level is passed while the exact binomial (Clopper-Pearson) bound on
its rate of false rejection is within ``limit``. The levels of a stratum are
tested in this fixed order up to the first failure, so they need no correction
among themselves; the error ``delta`` is divided by the number of strata. A
stratum with too few labels to prove anything has no cutoffs and rejects none.

The cutoffs come from all labelled documents. Features are computed once and
checkpointed, as narrow rows.

Cases: a null text has no words (and so fails the base rule); a null language is
a stratum of its own; a document labelled twice counts as good if one label says
so; rows with equal doc_id, repeated ones too, are judged each by its own text,
and a ratio just at a cutoff reaches it; a text's words, their hashes and the
hashes of its windows are held together, some 100 bytes a word, so a very long
text takes memory in proportion; an empty table gives no rows, and empty labels
no cutoffs; columns beyond doc_id, text and lang are ignored by ``judge`` and
kept by ``keep``, whatever their names.

A stratum needs ``least_labels`` good documents, all below every cutoff, before
anything can be proven of it: 99 alone, 144 among four strata.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import stored

#: The separators of words: space, and tab to carriage return.
SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Cutoffs per mille for each level, loosest first.
CUTOFFS = {
    "symbols": (400, 300, 200, 150, 100, 70, 50, 30),
    "exclaims": (1800, 1500, 1200, 900, 600, 400, 200, 100),
    "dup_lines": (950, 900, 800, 700, 600, 500, 450, 400),
    "repeats": (290, 280, 260, 240, 220, 200, 180, 150),
}
LEVELS = 8
#: Strata up to this number are broadcast, at some 50 bytes each.
MOST_BROADCAST = 100_000
LIMIT = 0.03
DELTA = 0.05


def _bind(value: Column, body) -> Column:
    """body(value), with value computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(x: Column, chars: str) -> Column:
    for c in chars:
        x = F.replace(x, F.lit(c), F.lit(""))
    return x


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SEPARATORS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[ \t-\r]+")).otherwise(F.array().cast("array<string>"))


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in windows that occur twice or more in the row."""

    def covered(hashes: Column) -> Column:
        found = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            m = F.size(s)
            same = F.filter(
                F.transform(s, lambda x, k: F.when(((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < m - 1) & (F.get(s, k + 1)["h"] == x["h"])), x["i"])),
                lambda p: p.isNotNull(),
            )
            return _bind(F.array_sort(same), lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda total, x: total + x))

        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _bind(found, twice)).otherwise(F.lit(0).cast("long"))

    # words are hashed once, and a window is the hash of its words' hashes
    hashed = lambda h: F.transform(F.sequence(F.lit(1), n.cast("int") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
    windows = _bind(F.transform(words, lambda w: F.xxhash64(w)), hashed)
    return F.when(n > WINDOW, _bind(windows, covered)).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame, carry: tuple[Column, ...] = ()) -> DataFrame:
    """One row a document: the base columns, the stratum and the reject level, and what is to be carried along."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), text.alias("text"), *carry)
    carried = [F.col(c) for c in d.columns[3:]]
    d = d.withColumn("words", _words(F.col("text")))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SEPARATORS))) > 0)
    d = d.select(
        "doc_id",
        "stratum",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(_without(F.col("text"), "!"))).cast("long").alias("n_exclaims"),
        _bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        _repeat_words(F.col("words"), F.col("n_words")).alias("n_repeat_words"),
        *carried,
    )
    per_mille = {
        "symbols": (F.col("n_symbols"), F.col("word_chars")),
        "exclaims": (F.col("n_exclaims"), F.col("n_words")),
        "dup_lines": (F.col("lines.dup"), F.col("lines.n")),
        "repeats": (F.col("n_repeat_words"), F.col("n_words")),
    }
    first = F.least(*[F.coalesce(*[F.when((whole > 0) & (1000 * part >= c * whole), F.lit(i + 1)) for i, c in enumerate(CUTOFFS[k])], F.lit(LEVELS + 1)) for k, (part, whole) in per_mille.items()])
    return d.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words", first.cast("long").alias("reject_level"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"), *carried,
    )


def log_binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """ln P(X <= k) for X binomial(n, p), summed in logarithms so that nothing underflows."""
    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(term, s["sum"])
        return F.struct(term.alias("term"), (top + F.log(F.exp(term - top) + F.exp(s["sum"] - top))).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, step, lambda s: s["sum"])


def least_labels(strata: int, limit: float = LIMIT, delta: float = DELTA) -> int:
    """The fewest good documents with which a stratum can get a cutoff: none rejected has to be unlikely enough."""
    return math.ceil(math.log(delta / strata) / math.log1p(-limit))


def cutoffs(judged: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """A row a stratum: the strictest level that the holdout allows (0: none)."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = judged.where(~F.col("base_failed")).join(good, "doc_id").groupBy("stratum", "reject_level").agg(F.count(F.lit(1)).alias("c"))
    by = held.groupBy("stratum").agg(F.sum("c").alias("n"), *[F.sum(F.when(F.col("reject_level") <= j, F.col("c")).otherwise(0)).alias(f"k{j}") for j in range(1, LEVELS + 1)])
    strata = by.select(F.count(F.lit(1)).alias("strata"))
    tested = by.crossJoin(F.broadcast(strata))  # one row
    level = F.lit(0)
    passed = F.lit(True)
    for j in range(1, LEVELS + 1):
        passed = passed & (log_binomial_cdf(F.col("n"), F.col(f"k{j}"), limit) <= F.log(F.lit(delta) / F.col("strata")))
        level = level + F.when(passed, 1).otherwise(0)
    return tested.select("stratum", level.cast("long").alias("level"))


def _verdict(judged: DataFrame, labels: DataFrame, limit: float, delta: float) -> DataFrame:
    """The rows with a column ``kept``; the levels are broadcast only while they are few."""
    levels = stored(cutoffs(judged, labels, limit, delta), "levels")
    if levels.count() <= MOST_BROADCAST:
        levels = F.broadcast(levels)
    return judged.join(levels, "stratum", "left").withColumn("kept", ~F.col("base_failed") & (F.col("reject_level") > F.coalesce("level", F.lit(0))))


def judge(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """One row a document: base columns, base_failed and the verdict ``kept``."""
    judged = _verdict(stored(features(docs), "quality"), labels, limit, delta)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "reject_level")


def keep(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Rows are written once with their features, so that texts are neither
    measured twice nor shuffled.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return _verdict(stored(features(docs, (row,)), "quality"), labels, limit, delta).where("kept").select("row.*")
