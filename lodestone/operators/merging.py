"""Merging of the tracks' findings with evidence, citations and handlers, as a fold that can be split.

By the definition findings of one handler and class are folded in order of track
and ``seq``. Of two of one track the heavier stays, at equal weight the one whose
evidence is not the greater, and the other's evidence follows its own; findings
of two tracks corroborate each other, and each one's evidence follows in order.

So of a track's rows the one that stays is a least element, each row's evidence
stands before or after what was there by whether the row was the least so far,
and the rest are sums. "Least so far" is a running minimum: rows are dealt by
ranges of (handler, class, track, seq), a minimum runs within each part, and the
parts' minima run over the parts; no task sees a group whole before its evidence,
which is the result, is put together from ordered segments.

One thing does not split: where weights are equal the evidence gathered so far is
compared, not that of the row that stays. It differs only where the one evidence
begins with the other one and goes on with a line feed or a lesser character.
Groups with such rows, with two rows of one track and ``seq``, or with findings
that were merged before go through the fold itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.score import noisy_or, severity_order, track_order
from lodestone.operators.findings import _BY_ORDER, handler_union
from lodestone.session import stored

#: Between the pieces of merged evidence.
SEPARATOR = "\n\n---\n\n"
_TRACKS = ("static", "llm", "corroborated")
COLUMNS = ("id", "class", "severity", "confidence", "track", "file", "line", "handler", "evidence", "citations", "subject", "absorbed_handlers")


def _weight(severity: Column, confidence: Column) -> Column:
    return F.get(F.array(F.lit(0.1), F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(1.0)), severity) * confidence


def fold(findings: DataFrame) -> DataFrame:
    """The same by the definition: a fold over a group's rows in order of track and seq, held together in one row.

    For a program's own few findings, and for the groups that ``merge`` leaves to it.
    """
    row = F.struct(
        track_order(F.col("track")).alias("track"), "seq", severity_order(F.col("severity")).alias("severity"), F.col("confidence").cast("double").alias("confidence"), "file", "line", "evidence", "subject",
        F.coalesce("citations", F.array().cast(findings.schema["citations"].dataType)).alias("citations"), F.coalesce("absorbed_handlers", F.array().cast("array<string>")).alias("absorbed_handlers"), "id",
    )
    weigh = lambda f: _weight(f["severity"], f["confidence"])
    joined = lambda a, b: F.concat(a["evidence"], F.lit(SEPARATOR), b["evidence"])
    names = ("track", "seq", "severity", "confidence", "file", "line", "evidence", "subject", "citations", "absorbed_handlers", "id")

    def built(**c: Column) -> Column:
        return F.struct(*[c[n].alias(n) for n in names])

    def stronger(a: Column, b: Column) -> Column:
        union = handler_union(a["absorbed_handlers"], b["absorbed_handlers"])
        return built(**{n: a[n] for n in names} | {"evidence": joined(a, b), "absorbed_handlers": union, "id": F.lit("")})

    def step(a: Column, f: Column) -> Column:
        wins = (weigh(f) > weigh(a)) | ((weigh(f) == weigh(a)) & (f["evidence"] <= a["evidence"]))
        same = F.when(wins, stronger(f, a)).otherwise(stronger(a, f))
        confidence = F.when((a["track"] == 2) | (f["track"] == 2), F.greatest(a["confidence"], f["confidence"])).otherwise(noisy_or(a["confidence"], f["confidence"]))
        other = built(
            track=F.lit(2), seq=a["seq"], severity=F.greatest(a["severity"], f["severity"]), confidence=confidence, file=a["file"], line=a["line"], evidence=joined(a, f), subject=F.coalesce(a["subject"], f["subject"]),
            citations=F.concat(a["citations"], f["citations"]), absorbed_handlers=handler_union(a["absorbed_handlers"], f["absorbed_handlers"]), id=F.lit(""),
        )
        return F.when(a["track"] == f["track"], same).otherwise(other)

    rows = findings.groupBy("handler", "class").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    folded = rows.select("handler", "class", F.reduce(F.slice("rows", 2, F.size("rows")), F.get("rows", F.lit(0)), step).alias("m"))
    return folded.select(
        "m.id", "class", F.get(F.array(*[F.lit(s) for s in _BY_ORDER]), F.col("m.severity")).alias("severity"), "m.confidence", F.get(F.array(F.lit("static"), F.lit("llm"), F.lit("corroborated")), F.col("m.track")).alias("track"),
        "m.file", "m.line", "handler", "m.evidence", "m.citations", "m.subject", "m.absorbed_handlers",
    )


def _same(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> Column:
    """Equal keys, nulls being equal."""
    return [a[k].eqNullSafe(b[k]) for k in keys]


def unsplittable(rows: DataFrame) -> DataFrame:
    """The (handler, class) that the fold itself must take."""
    group = ("handler", "class", "t")
    again = rows.groupBy(*group, "seq").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("handler", "class")
    before = rows.where("t = 2 or t is null").select("handler", "class")
    # each begin of an evidence that a line feed or a lesser character follows
    parts = F.split("evidence", "(?=[\\x00-\\x0a])")
    begins = rows.where(F.rlike("evidence", F.lit("(?s).[\\x00-\\x0a]"))).withColumn("p", parts)
    begins = begins.select(*group, "weight", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.array_join(F.slice("p", 1, k), ""))).alias("evidence"))
    whole = rows.select(*group, "weight", "evidence")
    begun = begins.join(whole, [*_same(begins, whole, group), begins["weight"] == whole["weight"], begins["evidence"] == whole["evidence"]], "left_semi").select("handler", "class")
    return again.unionByName(before).unionByName(begun).distinct()


def merge(findings: DataFrame) -> DataFrame:
    """Merged findings: one for each handler and class, of any number of rows."""
    none = F.array().cast("array<string>")
    prepared = findings.select(
        "handler", "class", track_order(F.col("track")).alias("t"), F.col("seq").cast("long").alias("seq"), severity_order(F.col("severity")).alias("s"), F.col("confidence").cast("double").alias("c"),
        "file", "line", F.coalesce("evidence", F.lit("")).alias("evidence"), "subject", F.coalesce("citations", F.array().cast(findings.schema["citations"].dataType)).alias("citations"), F.coalesce("absorbed_handlers", none).alias("absorbed"), "id",
    ).withColumn("weight", _weight(F.col("s"), F.col("c")))
    placed = stored(prepared.repartitionByRange("handler", "class", "t", "seq").withColumn("part", F.spark_partition_id()), "merge-rows")
    whole = stored(unsplittable(placed), "merge-whole")
    kept = placed.join(whole, _same(placed, whole, ("handler", "class")), "left_anti")
    split = _pieced(_by_track(kept))
    left = findings.join(whole, _same(findings, whole, ("handler", "class")), "left_semi")
    return split.unionByName(fold(left.withColumn("evidence", F.coalesce("evidence", F.lit("")))))


def _by_track(rows: DataFrame) -> DataFrame:
    """A row for each handler, class and track: the finding that stays, and what is needed of the others."""
    group = ("handler", "class", "t")
    place = F.struct((-F.col("weight")).alias("w"), F.col("evidence").alias("e"), (-F.col("seq")).alias("q"))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*group, "part").agg(F.min(place).alias("least"))
    parts = parts.withColumn("before", F.min("least").over(ahead(Window.partitionBy(*group).orderBy("part")))).drop("least")
    within = rows.withColumn("place", place).withColumn("within", F.min("place").over(ahead(Window.partitionBy(*group, "part").orderBy("seq"))))
    marked = within.join(parts, [*_same(within, parts, group), within["part"] == parts["part"]]).select(*[within[c] for c in within.columns], F.least(within["within"], parts["before"]).alias("so_far"))
    won = F.col("so_far").isNull() | (F.col("place") <= F.col("so_far"))
    first = F.col("so_far").isNull()
    stays = F.struct("s", "c", "file", "line", "subject", "citations", "absorbed", "id")
    return marked.groupBy(*group).agg(
        F.min_by(stays, "place").alias("top"), F.count(F.lit(1)).alias("n"), F.max("s").alias("most"), F.max(F.when(first, F.col("c"))).alias("first_c"), F.max(F.when(~first, F.col("c"))).alias("later_c"),
        F.min_by("subject", F.when(F.col("subject").isNotNull(), F.col("seq"))).alias("named"), F.array_sort(F.collect_list(F.struct("seq", won.alias("won"), "evidence"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.size("citations") > 0, F.struct("seq", "citations")))).alias("cites"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("absorbed")))).alias("all_absorbed"),
    )


def _pieced(tracks: DataFrame) -> DataFrame:
    """Both tracks of a handler and class put together."""
    every = F.struct(*[F.col(c) for c in tracks.columns if c not in ("handler", "class")])
    both = tracks.groupBy("handler", "class").agg(F.first(F.when(F.col("t") == 0, every), ignorenulls=True).alias("static"), F.first(F.when(F.col("t") == 1, every), ignorenulls=True).alias("llm"))
    both = both.select("handler", "class", F.coalesce("static", "llm").alias("own"), F.when(F.col("static").isNotNull(), F.col("llm")).alias("more"))
    own, more, crossed = F.col("own"), F.col("more"), F.col("more").isNotNull()
    said = lambda pieces: F.transform(pieces, lambda p: p["evidence"])
    folded = F.concat(F.reverse(said(F.filter(own["pieces"], lambda p: p["won"]))), said(F.filter(own["pieces"], lambda p: ~p["won"])))
    evidence = F.array_join(F.when(crossed, F.concat(folded, said(more["pieces"]))).otherwise(folded), SEPARATOR)
    confidence = F.when(crossed, F.greatest(noisy_or(own["top"]["c"], more["first_c"]), more["later_c"])).otherwise(own["top"]["c"])
    severity = F.when(crossed, F.greatest(own["top"]["s"], more["most"])).otherwise(own["top"]["s"])
    alone = (own["n"] == 1) & ~crossed
    citations = F.when(crossed, F.concat(own["top"]["citations"], F.flatten(F.transform(more["cites"], lambda x: x["citations"])))).otherwise(own["top"]["citations"])
    absorbed = F.when(alone, own["top"]["absorbed"]).when(crossed, handler_union(own["all_absorbed"], more["all_absorbed"])).otherwise(own["all_absorbed"])
    return both.select(
        F.when(alone, own["top"]["id"]).otherwise("").alias("id"), "class", F.get(F.array(*[F.lit(s) for s in _BY_ORDER]), severity).alias("severity"), confidence.alias("confidence"),
        F.when(crossed, F.lit("corroborated")).otherwise(F.get(F.array(*map(F.lit, _TRACKS)), own["t"])).alias("track"), own["top"]["file"].alias("file"), own["top"]["line"].alias("line"), "handler",
        evidence.alias("evidence"), citations.alias("citations"), F.when(crossed, F.coalesce(own["top"]["subject"], more["named"])).otherwise(own["top"]["subject"]).alias("subject"), absorbed.alias("absorbed_handlers"),
    )
