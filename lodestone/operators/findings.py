"""Findings: merging of tracks, collapsing by subject, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.score import noisy_or, rank_score, severity_order

#: severity by its order, for folds over numbers
_BY_ORDER = ("info", "low", "medium", "high", "critical")


def handler_union(a: Column, b: Column) -> Column:
    """The sorted distinct handlers of two lists."""
    return F.array_sort(F.array_union(a, b))


def collapse_by_subject(findings: DataFrame) -> DataFrame:
    """One finding for each (subject, class, file): that of the least (line, handler), with the others' handlers.

    Findings without a subject pass through. Handlers are gathered as a set, so
    a group's size in memory is that of its distinct handlers.
    """
    alone = findings.where(F.col("subject").isNull())
    rest = [c for c in findings.columns if c not in ("subject", "class", "file")]
    first = F.struct("line", "handler", "seq")
    groups = findings.where(F.col("subject").isNotNull()).groupBy("subject", "class", "file").agg(
        F.min_by(F.struct(*rest), first).alias("s"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("handler")).alias("sorted")
    )
    # the survivor's own handler counts among the others if a second row has it; it is taken out in any case
    absorbed = F.when(F.col("n") > 1, F.array_remove(handler_union(F.coalesce("s.absorbed_handlers", F.array().cast("array<string>")), F.col("sorted")), F.col("s.handler"))).otherwise(F.col("s.absorbed_handlers"))
    told = F.concat(F.col("s.evidence"), F.lit("\n\nThe same defect is reachable from "), F.size(absorbed).cast("string"), F.lit(" other handler(s): "), F.array_join(absorbed, ", "), F.lit("."))
    columns = {c: F.col(f"s.{c}") for c in rest} | {"absorbed_handlers": absorbed, "evidence": F.when(F.col("n") > 1, told).otherwise(F.col("s.evidence"))}
    kept = groups.select(*[(columns[c] if c in columns else F.col(c)).alias(c) for c in findings.columns])
    return alone.unionByName(kept)


def merge_scores(findings: DataFrame) -> DataFrame:
    """Merged (handler, class) rows: track, severity and confidence, in one map-side-combined aggregation.

    Equal tracks keep their stronger row; a static and the first model finding
    combine by noisy-or; later model findings can only raise what is there. Which
    of the model's findings came first is found by an aggregation of its own, so
    that no group is sorted in one task.
    """
    static, llm = F.col("track") == "static", F.col("track") == "llm"
    row = F.struct(F.col("confidence").alias("c"), severity_order(F.col("severity")).alias("s"))
    score = F.struct(rank_score(F.col("severity"), F.col("confidence")), F.lit(0))
    firsts = findings.where(llm).groupBy("handler", "class").agg(F.min("seq").alias("first_seq"))
    g = findings.join(firsts, ["handler", "class"], "left").groupBy("handler", "class").agg(
        F.max_by(row, F.when(static, score)).alias("best_static"), F.max_by(row, F.when(llm, score)).alias("best_llm"), F.min_by(row, F.when(llm, F.col("seq"))).alias("first_llm"),
        F.max(F.when(llm & (F.col("seq") > F.col("first_seq")), F.col("confidence"))).alias("later_llm"), F.max(F.when(llm, severity_order(F.col("severity")))).alias("top_severity"), F.count(F.lit(1)).alias("n"),
    )
    both = F.col("best_static").isNotNull() & F.col("first_llm").isNotNull()
    confidence = F.when(both, F.greatest(noisy_or(F.col("best_static.c"), F.col("first_llm.c")), F.col("later_llm"))).otherwise(F.coalesce("best_static.c", "best_llm.c"))
    severity = F.when(both, F.greatest("best_static.s", "top_severity")).otherwise(F.coalesce("best_static.s", "best_llm.s"))
    return g.select(
        "handler", "class", F.when(both, "corroborated").when(F.col("best_static").isNotNull(), "static").otherwise("llm").alias("track"),
        F.get(F.array(*[F.lit(s) for s in _BY_ORDER]), severity).alias("severity"), confidence.alias("confidence"), "n",
    )


def ranked(findings: DataFrame, tail: tuple[str, ...] = ()) -> DataFrame:
    """Findings in order: score, severity, handler, class, and then what tells rows apart."""
    order = [F.desc("rank_score"), F.desc("severity_order"), F.asc("handler"), F.asc("class"), *[F.asc_nulls_first(c) for c in tail]]
    scored = findings.withColumn("rank_score", rank_score(F.col("severity"), F.col("confidence"))).withColumn("severity_order", severity_order(F.col("severity")))
    return scored.orderBy(*order)


def first_wins(rows: DataFrame, key: str, order: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(kept, diagnostics): of rows with one key the first in order; the others are reported as ambiguous."""
    least = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("first"))
    marked = rows.join(least, key)
    kept = marked.where(F.struct(*order) == F.col("first")).drop("first").dropDuplicates([key])
    lost = marked.where(F.struct(*order) != F.col("first")).select(F.lit("ambiguity").alias("kind"), F.col(key).alias("name"), *order)
    return kept, lost


def resolve_citations(findings: DataFrame, offers: DataFrame) -> DataFrame:
    """Findings with the offered documents that they cite, by id, address or title; those that cite none are dropped.

    ``findings`` has ``seq`` and ``cited`` (names in order); ``offers`` has ``seq``,
    ``offer`` (its place), doc_id, source_url and title. Each name stands for the
    first offer that bears it; a document cited twice counts once. The three ways
    to cite are three equal joins, not one join by alternatives.
    """
    names = findings.select("seq", F.posexplode("cited").alias("place", "name"))
    ways = None
    for c in ("doc_id", "source_url", "title"):
        way = offers.select("seq", F.col(c).cast("string").alias("name"), "offer", F.struct(F.col("doc_id"), F.col("source_url"), F.col("title")).alias("document"))
        ways = way if ways is None else ways.unionByName(way)
    best = names.join(ways, ["seq", "name"]).groupBy("seq", "place").agg(F.min(F.struct("offer", "document")).alias("hit"))
    once = best.groupBy("seq", "hit.document").agg(F.min("place").alias("place"))
    cited = once.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("place", "document"))).alias("c"))
    return findings.join(cited.select("seq", F.transform("c", lambda x: x["document"]).alias("citations")), "seq")
