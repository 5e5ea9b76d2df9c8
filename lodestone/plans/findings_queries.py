"""Findings and evaluation over projections of events and labels.

An event is a finding: its handler is 'h' and the user, its class the event's
type, its track the parity of its id. Events of even days are the baseline run,
those of odd days the mutant's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.lang.detectors import union_all
from lodestone.lang.ir import matched
from lodestone.operators.holdout import unreachable
from lodestone.functions import score as S
from lodestone.operators import evaluate as E
from lodestone.operators import findings as O
from lodestone.operators import merging
from lodestone.plans.registry import query
from lodestone.session import table

_SEVERITY = {"click": "low", "view": "info", "purchase": "critical", "signup": "high"}


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    severity = F.lit("medium")
    for k, v in _SEVERITY.items():
        severity = F.when(F.col("event_type") == k, v).otherwise(severity)
    none = F.array().cast("array<string>")
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("handler"), F.col("event_type").alias("class"), severity.alias("severity"),
        ((F.col("event_id") % 90 + 10) / 100.0).cast("double").alias("confidence"), F.when(F.col("event_id") % 2 == 0, "static").otherwise("llm").alias("track"), F.col("event_id").alias("line"), F.lit("f").alias("file"),
        F.when(F.col("event_id") % 5 != 0, F.concat("event_type", F.lit("."), (F.col("user_id") % 7).cast("string"))).alias("subject"), F.lit("e").alias("evidence"), none.alias("absorbed_handlers"), (F.dayofmonth("ts") % 2).alias("run"),
    )


_F = f"""f AS (SELECT event_id AS seq, 'h' || user_id AS handler, event_type AS class, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _SEVERITY.items())} ELSE 'medium' END AS severity,
((event_id % 90 + 10) / 100.0)::DOUBLE AS confidence, CASE WHEN event_id % 2 = 0 THEN 'static' ELSE 'llm' END AS track, event_id AS line,
CASE WHEN event_id % 5 <> 0 THEN event_type || '.' || (user_id % 7) END AS subject, day(ts) % 2 AS run FROM events)"""
_WEIGHT = "CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.25 ELSE 0.1 END"
_SORD = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query(f"WITH {_F} SELECT seq, handler, class, round({_WEIGHT} * confidence, 9)::DOUBLE AS rank_score FROM f ORDER BY {_WEIGHT} * confidence DESC, {_SORD} DESC, handler, class, subject NULLS FIRST, seq LIMIT 100")
def rank_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = O.ranked(findings(spark, sf_dir), ("subject", "seq")).limit(100)  # the report's top
    return top.select("seq", "handler", "class", F.round("rank_score", 9).alias("rank_score"))


@query(f"""WITH {_F}, g AS (SELECT *, row_number() OVER (PARTITION BY subject, class ORDER BY line, handler) AS r FROM f WHERE subject IS NOT NULL),
h AS (SELECT subject, class, count(*) AS n, list_sort(list(DISTINCT handler)) AS hs FROM g GROUP BY ALL)
SELECT seq, handler, g.class, subject, CASE WHEN n > 1 THEN array_to_string(list_filter(hs, lambda x: x <> handler), ',') ELSE '' END AS absorbed,
CASE WHEN n > 1 THEN 'e' || chr(10) || chr(10) || 'The same defect is reachable from ' || len(list_filter(hs, lambda x: x <> handler)) || ' other handler(s): ' || array_to_string(list_filter(hs, lambda x: x <> handler), ', ') || '.' ELSE 'e' END AS evidence
FROM g JOIN h USING (subject, class) WHERE r = 1 UNION ALL SELECT seq, handler, class, NULL, '', 'e' FROM f WHERE subject IS NULL""")
def collapse_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = O.collapse_by_subject(findings(spark, sf_dir))
    return c.select("seq", "handler", "class", "subject", F.array_join("absorbed_handlers", ",").alias("absorbed"), "evidence")


@query(f"""WITH {_F}, x AS (SELECT *, row_number() OVER (PARTITION BY handler, class, track ORDER BY seq) AS k FROM f),
m AS (SELECT handler, class, any_value(severity) AS severity, max(confidence) FILTER (WHERE track = 'static') AS s, max(confidence) FILTER (WHERE track = 'llm') AS l,
max(confidence) FILTER (WHERE track = 'llm' AND k = 1) AS l1, max(confidence) FILTER (WHERE track = 'llm' AND k > 1) AS later, count(*) AS n FROM x GROUP BY handler, class)
SELECT handler, class, severity, CASE WHEN s IS NULL THEN 'llm' WHEN l IS NULL THEN 'static' ELSE 'corroborated' END AS track,
round(CASE WHEN s IS NULL THEN l WHEN l IS NULL THEN s ELSE greatest(least(1 - (1 - s) * (1 - l1), 0.98), coalesce(later, 0)) END, 9) AS confidence, n FROM m""")
def merge_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.merge_scores(findings(spark, sf_dir)).select("handler", "class", "severity", "track", F.round("confidence", 9).alias("confidence"), "n")


_SAID = "'said ' || event_id % 7 || CASE WHEN event_id % 11 = 0 THEN chr(10) || 'more' ELSE '' END"
_STRONGER = "(f.weight > m.weight OR (f.weight = m.weight AND f.evidence <= m.evidence))"
_UNION = "list_sort(list_distinct(list_concat(m.absorbed, f.absorbed)))"
_SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


def _kept(column: str) -> str:
    """A column of the fold where two of one track meet: the stronger one's."""
    return f"CASE WHEN m.track = f.track AND {_STRONGER} THEN f.{column} ELSE m.{column} END"


@query(f"""WITH RECURSIVE {_F}, b AS (SELECT *, {_SORD} AS sev, {_WEIGHT}::DOUBLE * ((seq % 5 + 1) / 10.0)::DOUBLE AS weight, ((seq % 5 + 1) / 10.0)::DOUBLE AS conf, {_SAID.replace('event_id', 'seq')} AS evidence,
CASE WHEN track = 'llm' THEN ['c' || seq % 3] ELSE []::VARCHAR[] END AS citations, CASE WHEN seq % 4 = 0 THEN ['q' || seq % 5] ELSE []::VARCHAR[] END AS absorbed, row_number() OVER (PARTITION BY handler, class ORDER BY track <> 'static', seq) AS k FROM f),
fo AS (SELECT handler, class, k, track, sev, weight, conf, line, evidence, subject, citations, absorbed FROM b WHERE k = 1 UNION ALL
SELECT f.handler, f.class, f.k, CASE WHEN m.track = f.track THEN m.track ELSE 'corroborated' END,
CASE WHEN m.track = f.track THEN {_kept('sev')} ELSE greatest(m.sev, f.sev) END, {_kept('weight')},
CASE WHEN m.track = f.track THEN {_kept('conf')} WHEN m.track = 'corroborated' THEN greatest(m.conf, f.conf) ELSE least(1 - (1 - m.conf) * (1 - f.conf), 0.98) END, {_kept('line')},
CASE WHEN m.track = f.track AND {_STRONGER} THEN f.evidence || {_SEP} || m.evidence ELSE m.evidence || {_SEP} || f.evidence END,
CASE WHEN m.track = f.track THEN {_kept('subject')} ELSE coalesce(m.subject, f.subject) END, CASE WHEN m.track = f.track THEN {_kept('citations')} ELSE list_concat(m.citations, f.citations) END, {_UNION}
FROM fo m JOIN b f ON f.handler = m.handler AND f.class = m.class AND f.k = m.k + 1)
SELECT handler, class, track, ['info', 'low', 'medium', 'high', 'critical'][sev + 1] AS severity, round(conf, 9) AS confidence, line, md5(evidence) AS evidence_md5, subject, array_to_string(citations, ',') AS citations, array_to_string(absorbed, ',') AS absorbed
FROM fo SEMI JOIN (SELECT handler, class, max(k) AS k FROM b GROUP BY ALL) USING (handler, class, k)""")
def merge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole merged findings, with evidence in order, citations and handlers."""
    i, empty = F.col("seq"), F.array().cast("array<string>")
    said = F.concat(F.lit("said "), (i % 7).cast("string"), F.when(i % 11 == 0, "\nmore").otherwise(""))
    f = findings(spark, sf_dir).withColumns({
        "confidence": ((i % 5 + 1) / 10.0).cast("double"), "evidence": said, "id": i.cast("string"),
        "citations": F.when(F.col("track") == "llm", F.array(F.concat(F.lit("c"), (i % 3).cast("string")))).otherwise(empty), "absorbed_handlers": F.when(i % 4 == 0, F.array(F.concat(F.lit("q"), (i % 5).cast("string")))).otherwise(empty),
    })
    m = merging.merge(f)
    return m.select("handler", "class", "track", "severity", F.round("confidence", 9).alias("confidence"), "line", F.md5(F.col("evidence").cast("binary")).alias("evidence_md5"), "subject", F.array_join("citations", ",").alias("citations"), F.array_join("absorbed_handlers", ",").alias("absorbed"))


@query("SELECT event_id, round(least(1 - (1 - a) * (1 - b), 0.98), 9)::DOUBLE AS confidence FROM (SELECT event_id, (event_id % 100 / 100.0)::DOUBLE AS a, (event_id % 97 / 100.0)::DOUBLE AS b FROM events)")
def noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(S.noisy_or((i % 100 / 100.0).cast("double"), (i % 97 / 100.0).cast("double")), 9).alias("confidence"))


_D = f"""{_F}, d AS (SELECT f.*, NOT EXISTS (SELECT 1 FROM f b WHERE b.run = 0 AND b.seq % 3 = 0 AND b.track = f.track AND b.handler = f.handler AND b.class = f.class) AS introduced FROM f WHERE run = 1)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    return E.diff(f.where("run = 0 and seq % 3 = 0"), f.where("run = 1"))


@query(f"WITH {_D} SELECT seq, track, handler, class FROM d WHERE introduced")
def diff_introduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).where("introduced").select("seq", "track", "handler", "class")


@query(f"WITH {_D} SELECT seq, track, handler, class FROM d WHERE NOT introduced")
def diff_persistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).where("not introduced").select("seq", "track", "handler", "class")


#: A case for each labelled document: it expects a finding of its class on its handler.
_LABELS = "lb AS (SELECT DISTINCT doc_id AS c, 'h' || (doc_id % 150) AS handler, ['click', 'view', 'purchase', 'signup', 'logout'][doc_id % 5 + 1] AS class FROM labels)"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("click", "view", "purchase", "signup", "logout")])
    rows = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return rows.select(F.col("doc_id").alias("case"), F.concat(F.lit("h"), (F.col("doc_id") % 150).cast("string")).alias("handler"), F.get(names, (F.col("doc_id") % 5).cast("int")).alias("class"))


#: Findings of a case: those of the events whose user has the case's number, modulo 150.
_CASES = "dc AS (SELECT c, d.* FROM d JOIN (SELECT DISTINCT doc_id AS c FROM labels) ON d.seq % 400 = c % 400)"


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Differences and labels, each with the number of the run ``k`` that cases share."""
    return _diff(spark, sf_dir).withColumn("k", F.col("seq") % 400), _labels(spark, sf_dir).withColumn("k", F.col("case") % 400)


_ORDER = "CASE track WHEN 'static' THEN 0 WHEN 'llm' THEN 1 ELSE 2 END"


@query(f"""WITH {_D}, {_LABELS}, {_CASES}, t AS (SELECT DISTINCT lb.c, track FROM lb JOIN dc ON dc.c = lb.c AND dc.handler = lb.handler AND dc.class = lb.class AND introduced)
SELECT lb.c AS "case", count(track) > 0 AS detected, coalesce(string_agg(track, ',' ORDER BY {_ORDER}), '') AS tracks FROM lb LEFT JOIN t USING (c) GROUP BY lb.c""")
def diff_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.detected(*_runs(spark, sf_dir), by="k").select("case", "detected", F.array_join("detecting_tracks", ",").alias("tracks"))


_V = "v(view, track) AS (VALUES ('static', 'static'), ('static', 'corroborated'), ('llm', 'llm'), ('llm', 'corroborated'), ('merged', 'static'), ('merged', 'llm'), ('merged', 'corroborated'))"
_SUMMARY = f"""{_D}, {_LABELS}, {_CASES}, {_V}, tot AS (SELECT class, count(*) AS total_cases FROM lb GROUP BY class),
tp AS (SELECT lb.class, v.view, count(DISTINCT lb.c) AS n FROM lb JOIN dc ON dc.c = lb.c AND dc.handler = lb.handler AND dc.class = lb.class AND introduced JOIN v USING (track) GROUP BY ALL),
fp AS (SELECT lb.class, v.view, count(*) AS n FROM lb JOIN dc ON dc.c = lb.c AND dc.handler <> lb.handler AND dc.class <> lb.class AND introduced JOIN v USING (track) GROUP BY ALL),
su AS (SELECT class, view, coalesce(tp.n, 0) AS true_positives, total_cases, coalesce(fp.n, 0) AS false_positives FROM tot CROSS JOIN (SELECT DISTINCT view FROM v) LEFT JOIN tp USING (class, view) LEFT JOIN fp USING (class, view)),
sr AS (SELECT *, true_positives / total_cases AS recall, true_positives / nullif(true_positives + false_positives, 0) AS precision FROM su)"""


@query(f"WITH {_SUMMARY} SELECT class, view, true_positives, total_cases, false_positives, round(recall, 9) AS recall, round(precision, 9) AS precision FROM sr")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.summarize(*_runs(spark, sf_dir), by="k")
    return s.withColumn("recall", F.round("recall", 9)).withColumn("precision", F.round("precision", 9))


@query(f"WITH {_SUMMARY} SELECT class, view, printf('%.3f', recall) AS recall, coalesce(printf('%.3f', precision), '-') AS precision FROM sr")
def metrics_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.summarize(*_runs(spark, sf_dir), by="k")
    return s.select("class", "view", E.rendered(F.col("recall")).alias("recall"), E.rendered(F.col("precision")).alias("precision"))


@query(f"WITH {_D}, {_V} SELECT view, count(DISTINCT (handler, d.class)) FILTER (WHERE handler IS NOT NULL) AS findings, 470::BIGINT AS loc, count(DISTINCT (handler, d.class)) FILTER (WHERE handler IS NOT NULL) * 1000.0::DOUBLE / 470 AS per_kloc FROM v LEFT JOIN (SELECT * FROM d WHERE NOT introduced) d USING (track) GROUP BY view")
def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.noise_floor(_diff(spark, sf_dir), 470)


_HOLDOUT = f"""WITH {_F}, {_LABELS}, t AS (SELECT lb.c, lb.class, lb.handler, q > 0 AS available FROM lb JOIN (SELECT doc_id AS c, max(quality + toxic) AS q FROM labels GROUP BY 1) USING (c)),
cs AS (SELECT handler, class, subject, row_number() OVER (PARTITION BY subject, class ORDER BY line, handler) AS r FROM f WHERE subject IS NOT NULL),
rep AS (SELECT class, handler, 0 AS way, handler AS on_ FROM cs WHERE r = 1 UNION ALL SELECT class, handler, 0, handler FROM f WHERE subject IS NULL
UNION ALL SELECT o.class, o.handler, 1, s.handler FROM cs o JOIN cs s ON s.subject = o.subject AND s.class = o.class AND s.r = 1 WHERE o.handler <> s.handler),
b AS (SELECT class, handler, min((way, on_)) AS best FROM rep GROUP BY ALL),
ho AS (SELECT t.c AS "case", t.class, t.handler, CASE WHEN NOT available THEN 'unavailable' WHEN best[1] = 0 THEN 'direct' WHEN best[1] = 1 THEN 'absorbed' ELSE 'missed' END AS outcome,
CASE WHEN available AND best[1] = 1 THEN best[2] END AS reported_on FROM t LEFT JOIN b USING (class, handler))"""


def _holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    available = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("case")).agg((F.max(F.col("quality") + F.col("toxic")) > 0).alias("available"))
    targets = _labels(spark, sf_dir).join(available, "case")
    return E.holdout(targets, O.collapse_by_subject(findings(spark, sf_dir)))


@query(f"{_HOLDOUT} SELECT * FROM ho")
def holdout_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holdout(spark, sf_dir)


@query(f"""{_HOLDOUT} SELECT class, count(*) AS targets, count(*) FILTER (WHERE outcome <> 'unavailable') AS scored, count(*) FILTER (WHERE outcome = 'direct') AS direct, count(*) FILTER (WHERE outcome = 'absorbed') AS absorbed,
round(count(*) FILTER (WHERE outcome IN ('direct', 'absorbed')) / nullif(count(*) FILTER (WHERE outcome <> 'unavailable'), 0), 9) AS recall FROM ho GROUP BY class""")
def holdout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summarize_holdout(_holdout(spark, sf_dir), True).withColumn("recall", F.round("recall", 9))


@query(f"WITH {_LABELS} SELECT class AS operator, count(*) AS cases FROM lb GROUP BY class")
def cases_per_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cases_per_operator(_labels(spark, sf_dir).withColumnRenamed("class", "operator"))


@query(f"WITH {_LABELS} SELECT c AS \"case\", class || '-' || left(sha256(c::VARCHAR), 16) AS name FROM lb")
def case_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.functions.text import stable_id

    return _labels(spark, sf_dir).select("case", F.concat("class", F.lit("-"), stable_id(F.col("case").cast("string"))).alias("name"))


@query(f"WITH {_F} SELECT class, count(*) AS total, count(*) FILTER (WHERE subject IS NOT NULL) AS examined FROM f GROUP BY class")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.coverage(findings(spark, sf_dir), "class", F.col("subject").isNotNull())


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS r FROM documents) WHERE r = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = O.first_wins(table(spark, sf_dir, "documents"), "source", ("n_chars", "doc_id"))
    return kept.select("doc_id", "source")


@query(f"WITH {_F} SELECT track, class, count(*) AS n FROM (SELECT track, class FROM f WHERE track = 'static' UNION ALL SELECT track, class FROM f WHERE track = 'llm') GROUP BY ALL")
def union_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    return union_all([f.where("track = 'static'"), f.where("track = 'llm'")]).groupBy("track", "class").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, array_to_string(list_sort(list_distinct(['h' || (event_id % 7), 'h' || (event_id % 3), 'h' || (user_id % 5)])), ',') AS handlers FROM events")
def handler_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = lambda c, n: F.concat(F.lit("h"), (F.col(c) % n).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(O.handler_union(F.array(h("event_id", 7), h("event_id", 3)), F.array(h("user_id", 5))), ",").alias("handlers"))


@query("SELECT event_id, array_to_string(list_filter(['owner', 'address', 'seeds', 'signer'], lambda c: NOT list_contains(p, c)), ',') AS absent FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ['seeds'] WHEN 1 THEN ['owner', 'signer'] WHEN 2 THEN ['address', 'other'] ELSE ['signer', 'seeds', 'address', 'owner'] END AS p FROM events)")
def array_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.lang.units import absent

    lits = lambda *x: F.array(*[F.lit(v) for v in x])
    k = F.col("event_id") % 4
    present = F.when(k == 0, lits("seeds")).when(k == 1, lits("owner", "signer")).when(k == 2, lits("address", "other")).otherwise(lits("signer", "seeds", "address", "owner"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(absent(present), ",").alias("absent"))


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'skipped' END AS diagnostic, quality FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)")
def left_join_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return matched(table(spark, sf_dir, "documents").select("doc_id"), q, ["doc_id"]).select("doc_id", "diagnostic", "quality")


@query("SELECT c_custkey FROM customer a WHERE NOT EXISTS (SELECT 1 FROM customer b WHERE b.c_nationkey = a.c_nationkey AND b.c_custkey <> a.c_custkey AND contains(b.c_name, right(a.c_name, 3)))")
def anti_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that no sibling mentions: an anti-join by the family's key, with a contained name as the condition.

    The mention is turned into an equal join on the tokens that it can be: every
    run of three characters of the sibling's name.
    """
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    grams = c.select("c_nationkey", F.col("c_custkey").alias("other"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("c_name") - 2), lambda i: F.substring("c_name", i, F.lit(3))))).alias("gram"))
    # of a token's bearers only the least and the greatest matter: one of them is another row than any given one
    bearers = grams.groupBy("c_nationkey", "gram").agg(F.min("other").alias("low"), F.max("other").alias("high"))
    own = c.withColumn("gram", F.right("c_name", F.lit(3)))
    return own.join(bearers, ["c_nationkey", "gram"], "left").where("low is null or (low = c_custkey and high = c_custkey)").select("c_custkey")


@query("""WITH o AS (SELECT doc_id AS seq, 0 AS offer, 'd' || doc_id AS d, 'u' || (doc_id % 10) AS u, lang AS t FROM documents UNION ALL SELECT doc_id, 1, 'd' || (doc_id + 1), 'u' || (doc_id % 7), source FROM documents),
c AS (SELECT doc_id AS seq, unnest([0, 1, 2]) AS place, unnest(['u' || (doc_id % 3), 'd' || doc_id, source]) AS name FROM documents),
h AS (SELECT c.seq, place, min(offer) AS offer FROM c JOIN o ON o.seq = c.seq AND (o.d = name OR o.u = name OR o.t = name) GROUP BY ALL)
SELECT seq, string_agg(d, ',' ORDER BY place) AS cited FROM (SELECT h.seq, o.d, min(place) AS place FROM h JOIN o ON o.seq = h.seq AND o.offer = h.offer GROUP BY ALL) GROUP BY seq""")
def citation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    tag = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    i = F.col("doc_id")
    offers = d.select(i.alias("seq"), F.lit(0).alias("offer"), tag("d", i).alias("doc_id"), tag("u", i % 10).alias("source_url"), F.col("lang").alias("title"))
    offers = offers.unionByName(d.select(i.alias("seq"), F.lit(1).alias("offer"), tag("d", i + 1).alias("doc_id"), tag("u", i % 7).alias("source_url"), F.col("source").alias("title")))
    cited = d.select(i.alias("seq"), F.array(tag("u", i % 3), tag("d", i), F.col("source")).alias("cited"))
    return O.resolve_citations(cited, offers).select("seq", F.array_join(F.transform("citations", lambda c: c["doc_id"]), ",").alias("cited"))


@query(f"WITH {_F} SELECT class, row_number() OVER (ORDER BY place) - 1 AS rule_index, severity FROM (SELECT class, list_position(['purchase', 'signup', 'absent', 'click', 'view', 'logout'], class) AS place, arg_max(severity, {_SORD}) AS severity FROM f GROUP BY class) WHERE place IS NOT NULL")
def rule_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.report import rule_index as numbered

    rules = spark.createDataFrame([(c, i) for i, c in enumerate(("purchase", "signup", "absent", "click", "view", "logout"))], "class string, ord int")
    return numbered(findings(spark, sf_dir), rules).select("class", F.col("rule_index").cast("long").alias("rule_index"), "severity")


@query(f"WITH {_LABELS} SELECT class, count(*) AS cases FROM lb WHERE class NOT IN (SELECT event_type FROM events WHERE event_type <> 'view') GROUP BY class")
def unreachable_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "events").where("event_type <> 'view'").select(F.col("event_type").alias("class")).distinct()
    return unreachable(_labels(spark, sf_dir), known)


@query("SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 9 = 0 THEN 'rewritten' ELSE source END AS text FROM documents")
def overlay_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("source").alias("text"), "doc_id")
    return E.overlay(d.select("path", "text"), d.where("doc_id % 9 = 0").select("path", F.lit("rewritten").alias("text")))


@query("SELECT * FROM (VALUES ('static', 'static'), ('static', 'corroborated'), ('llm', 'llm'), ('llm', 'corroborated'), ('merged', 'static'), ('merged', 'llm'), ('merged', 'corroborated')) v(view, track)")
def view_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.views(spark)


@query(f"{_HOLDOUT} SELECT outcome, count(*) AS targets, bool_and(outcome IN ('direct', 'absorbed')) AS hit, bool_and(outcome <> 'unavailable') AS scored FROM ho GROUP BY outcome")
def outcome_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _holdout(spark, sf_dir).select("outcome", E.is_hit(F.col("outcome")).alias("hit"), E.was_scored(F.col("outcome")).alias("scored"))
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("targets"), F.bool_and("hit").alias("hit"), F.bool_and("scored").alias("scored"))


@query("SELECT event_id, '{\"event_id\":' || event_id || ',\"class\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS json FROM events")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.report import to_json

    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("class"), "user_id")
    return to_json(e).select(F.get_json_object("json", "$.event_id").cast("long").alias("event_id"), "json")


@query("""SELECT doc_id, '| high | ' || printf('%.2f', (doc_id % 100) / 100.0) || ' | ' || lang || ' | ' || replace(replace(coalesce(source, ''), '|', '\\|'), chr(10), ' ') || ':' || doc_id || ' | h | ' || replace(replace(left(text, 80), '|', '\\|'), chr(10), ' ') || ' |' AS row FROM documents WHERE source IS NOT NULL""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as rows of a Markdown table: bars escaped, line feeds as spaces."""
    from lodestone.operators.report import markdown_rows

    d = table(spark, sf_dir, "documents").where("source is not null")
    rows = d.select(F.col("doc_id").cast("string").alias("track"), F.lit("high").alias("severity"), ((F.col("doc_id") % 100) / 100.0).alias("confidence"), F.col("lang").alias("class"), F.col("source").alias("file"), F.col("doc_id").alias("line"), F.lit("h").alias("handler"), F.substring("text", 1, 80).alias("evidence"))
    return markdown_rows(rows).select(F.col("track").cast("long").alias("doc_id"), "row")
