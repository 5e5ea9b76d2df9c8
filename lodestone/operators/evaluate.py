"""Differential evaluation: what a mutant introduces, recall and precision by class and view, noise, holdout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.constants import TRACKS, VIEW_TRACKS
from lodestone.functions.score import track_order


def views(spark) -> DataFrame:
    """(view, track): which tracks count towards which view."""
    return spark.createDataFrame([(v, t) for v, tracks in VIEW_TRACKS.items() for t in tracks], "view string, track string")


def diff(baseline: DataFrame, mutant: DataFrame, key: tuple[str, ...] = ("track", "handler", "class")) -> DataFrame:
    """The mutant's findings with ``introduced``: whether the baseline lacks their key. Bags stay bags."""
    known = baseline.select(*key).distinct().withColumn("known", F.lit(True))
    return mutant.join(known, list(key), "left").withColumn("introduced", F.col("known").isNull()).drop("known")


def detected(differences: DataFrame, labels: DataFrame, by: str = "case") -> DataFrame:
    """A row a case: whether an introduced finding matches its label, and on which tracks, in track order.

    ``by`` names the column that says which findings are a case's; where several
    cases share a run, it is the run's, and the findings stay one row each.
    """
    where = list(dict.fromkeys((by, "handler", "class")))
    found = differences.where("introduced").groupBy(*where).agg(F.collect_set(track_order(F.col("track"))).alias("on"))
    each = labels.select(*dict.fromkeys(("case", *where))).join(found, where).groupBy("case").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("on")))).alias("on"))
    tracks = each.select("case", F.transform("on", lambda i: F.get(F.array(*[F.lit(t) for t in TRACKS]), i)).alias("detecting_tracks"))
    out = labels.join(tracks, "case", "left")
    return out.withColumn("detecting_tracks", F.coalesce("detecting_tracks", F.array().cast("array<string>"))).withColumn("detected", F.size("detecting_tracks") > 0)


def cases_per_operator(labels: DataFrame) -> DataFrame:
    """How many cases each defect operator made."""
    return labels.groupBy("operator").agg(F.count(F.lit(1)).alias("cases"))


def coverage(units: DataFrame, key: str, examined: Column) -> DataFrame:
    """How many units there are by ``key``, and how many of them were examined."""
    return units.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(examined).alias("examined"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where there is nothing to count."""
    return F.try_divide(part.cast("double"), whole)


def _wrong(differences: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    """(class, track, n): introduced findings that differ from a case's label in class and handler, over all cases.

    Findings and labels are counted by what they are, and of all that belong to a
    case those of its class and those of its handler are taken off, and put back
    where they are both: joins on equal keys, so no findings meet cases in pairs.
    """
    both = differences.where("introduced and handler is not null and class is not null").groupBy(by, "track", "handler", "class").agg(F.count(F.lit(1)).alias("n"))
    label = labels.where("handler is not null and class is not null").groupBy(by, "handler", "class").agg(F.count(F.lit(1)).alias("m"))
    out = label.join(both.groupBy(by, "track").agg(F.sum("n").alias("n_all")), by)
    for name, also in (("n_class", ("class",)), ("n_handler", ("handler",)), ("n_both", ("handler", "class"))):
        out = out.join(both.groupBy(by, "track", *also).agg(F.sum("n").alias(name)), [by, "track", *also], "left").fillna(0, [name])
    n = F.col("m") * (F.col("n_all") - F.col("n_class") - F.col("n_handler") + F.col("n_both"))
    return out.groupBy("class", "track").agg(F.sum(n).alias("n")).where("n > 0")


def summarize(differences: DataFrame, labels: DataFrame, by: str = "case") -> DataFrame:
    """Recall and precision of each class in each view; precision is null where nothing was reported. ``by`` as for ``detected``."""
    spark = labels.sparkSession
    of = F.broadcast(views(spark))  # fixed, seven rows
    cases = detected(differences, labels, by)
    total = labels.groupBy("class").agg(F.count(F.lit(1)).alias("total_cases"))
    hits = cases.select("case", "class", F.explode("detecting_tracks").alias("track")).join(of, "track").groupBy("class", "view").agg(F.countDistinct("case").alias("tp"))
    wrong = _wrong(differences, labels, by).join(of, "track").groupBy("class", "view").agg(F.sum("n").alias("fp"))
    frame = total.crossJoin(F.broadcast(views(spark).select("view").distinct()))  # three views
    out = frame.join(hits, ["class", "view"], "left").join(wrong, ["class", "view"], "left").fillna(0, ["tp", "fp"])
    return out.select("class", "view", F.col("tp").alias("true_positives"), "total_cases", F.col("fp").alias("false_positives"), ratio(F.col("tp"), F.col("total_cases")).alias("recall"), ratio(F.col("tp"), F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"))


def noise_floor(differences: DataFrame, loc: int) -> DataFrame:
    """Distinct (handler, class) of findings that the clean program has too, by view, and per thousand lines."""
    spark = differences.sparkSession
    kept = differences.where("not introduced").select("track", "handler", "class").distinct().join(F.broadcast(views(spark)), "track")
    n = kept.groupBy("view").agg(F.countDistinct("handler", "class").alias("findings"))
    every = views(spark).select("view").distinct().join(n, "view", "left").fillna(0, ["findings"])
    return every.select("view", "findings", F.lit(loc).cast("long").alias("loc"), (F.lit(0.0) if loc == 0 else F.col("findings") * 1000.0 / loc).alias("per_kloc"))


def holdout(targets: DataFrame, findings: DataFrame) -> DataFrame:
    """Outcome of each target (case, handler, class, available): direct, absorbed, missed or unavailable.

    A finding reports a handler directly or as one that it absorbed; direct wins,
    and an absorbed one names the least handler that reports it.
    """
    direct = findings.select("class", F.col("handler").alias("h"), F.lit(0).alias("way"), F.col("handler").alias("on"))
    taken = findings.select("class", F.explode("absorbed_handlers").alias("h"), F.lit(1).alias("way"), F.col("handler").alias("on"))
    reports = direct.unionByName(taken).groupBy("class", "h").agg(F.min(F.struct("way", "on")).alias("best"))
    j = targets.join(reports.withColumnRenamed("h", "handler"), ["class", "handler"], "left")
    outcome = F.when(~F.col("available"), "unavailable").when(F.col("best.way") == 0, "direct").when(F.col("best.way") == 1, "absorbed").otherwise("missed")
    out = j.withColumn("outcome", outcome)
    return out.select("case", "class", "handler", "outcome", F.when(F.col("outcome") == "absorbed", F.col("best.on")).alias("reported_on"))


def is_hit(outcome: Column) -> Column:
    """Whether a target was reported, by itself or absorbed."""
    return outcome.isin("direct", "absorbed")


def was_scored(outcome: Column) -> Column:
    """Whether a target's program could be analyzed at all."""
    return outcome != "unavailable"


def summarize_holdout(outcomes: DataFrame, by_class: bool = False) -> DataFrame:
    """Counts and recall of scored targets; recall is null where none was scored."""
    is_ = lambda *o: F.count_if(F.col("outcome").isin(*o))
    g = outcomes.groupBy("class") if by_class else outcomes.groupBy()
    out = g.agg(F.count(F.lit(1)).alias("targets"), is_("direct", "absorbed", "missed").alias("scored"), is_("direct").alias("direct"), is_("absorbed").alias("absorbed"))
    return out.withColumn("recall", ratio(F.col("direct") + F.col("absorbed"), F.nullif(F.col("scored"), F.lit(0))))


def overlay(clean: DataFrame, rewritten: DataFrame) -> DataFrame:
    """A case's files: the clean ones with the rewritten ones over them; a rewrite of no file is an error."""
    stray = rewritten.join(clean, "path", "left_anti")
    if not stray.isEmpty():
        raise ValueError(f"a rewrite lies outside the tree: {stray.first()['path']}")
    new = rewritten.select("path", F.col("text").alias("new"))
    return clean.join(new, "path", "full").select("path", F.coalesce("new", "text").alias("text"))


def rendered(x: Column, digits: int = 3) -> Column:
    """A number with fixed digits, and a dash for a null."""
    return F.when(x.isNull(), "-").otherwise(F.format_string(f"%.{digits}f", x))
