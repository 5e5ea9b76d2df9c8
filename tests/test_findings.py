"""Findings algebra, evaluation, reports, history and the model track."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluate as E
from lodestone.operators import findings as O
from lodestone.operators import history as H
from lodestone.operators import merging as G
from lodestone.operators import model_track as M
from lodestone.operators import report as R

SCHEMA = "seq long, handler string, class string, severity string, confidence double, track string, line int, file string, subject string, evidence string, absorbed_handlers array<string>, citations array<struct<doc_id:string,source_url:string,title:string>>, id string"


def made(spark, *rows):
    base = dict(handler="h", severity="high", confidence=0.5, track="static", line=1, file="f", subject=None, evidence="e", absorbed_handlers=[], citations=[], id="i")
    full = [base | {"class": "c", "seq": i} | r for i, r in enumerate(rows)]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], SCHEMA)


def merged(spark, *rows):
    both = made(spark, *rows)
    full = {(r.handler, r["class"]): r for r in G.merge(both).collect()}
    for r in O.merge_scores(both).collect():
        m = full[r.handler, r["class"]]
        assert (r.track, r.severity) == (m.track, m.severity) and r.confidence == pytest.approx(m.confidence)
    return full


def test_two_tracks_corroborate(spark):
    m = merged(spark, dict(confidence=0.5, evidence="s"), dict(track="llm", confidence=0.6, severity="critical", evidence="l"))["h", "c"]
    assert (m.track, m.severity, m.evidence) == ("corroborated", "critical", "s\n\n---\n\nl") and m.confidence == pytest.approx(0.8)


def test_noisy_or_is_capped_and_later_rows_only_raise(spark):
    assert merged(spark, dict(confidence=0.9), dict(track="llm", confidence=0.9))["h", "c"].confidence == pytest.approx(0.98)
    assert merged(spark, dict(confidence=0.5), dict(track="llm", confidence=0.5), dict(track="llm", confidence=0.9))["h", "c"].confidence == pytest.approx(0.9)
    assert merged(spark, dict(confidence=0.5), dict(track="llm", confidence=0.5), dict(track="llm", confidence=0.6))["h", "c"].confidence == pytest.approx(0.75)


def test_one_track_keeps_the_stronger(spark):
    m = merged(spark, dict(confidence=0.5, evidence="a", subject="x"), dict(confidence=0.7, evidence="b", subject="y"))["h", "c"]
    assert (m.track, m.confidence, m.subject, m.evidence) == ("static", 0.7, "y", "b\n\n---\n\na")
    tie = merged(spark, dict(evidence="b"), dict(evidence="a"))["h", "c"]
    assert tie.evidence == "a\n\n---\n\nb"


def test_split_merge_is_the_fold(spark):
    """Random rows with equal weights, evidence that begins others, merged rows, equal seqs and a hot group: the same as the fold."""
    import random

    rng = random.Random(9)
    texts = ["a", "b", "ab", "a\nb", "a\x01", "a b", "", "c\n\n---\n\nd", "c", "c\n\nx"]
    rows = []
    for k in range(700):
        hot = rng.random() < 0.35
        rows.append({
            "handler": "hot" if hot else rng.choice(["h1", "h2", "h3", None]), "class": "c" if hot else rng.choice("cdefghij"), "severity": rng.choice(["low", "high", "info"]), "confidence": rng.choice([0.2, 0.4, 0.6]),
            "track": rng.choice(["static", "llm", "llm"] + (["corroborated"] if k % 40 == 0 else [])), "line": k, "subject": rng.choice([None, "s", "t"]), "evidence": rng.choice(texts) if k % 3 else f"e{rng.randint(0, 5)}",
            "absorbed_handlers": rng.choice([[], ["z", "y"], ["x"]]), "citations": rng.choice([[], [("d", "u", f"t{k}")]]), "id": f"i{k}", "seq": k if rng.random() < 0.97 else k - 1,
        })
    both = made(spark, *rows).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(str, G.merge(both).select(*G.COLUMNS).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(map(str, G.fold(both).select(*G.COLUMNS).collect()))


def test_rows_with_different_keys_stay(spark):
    assert len(merged(spark, dict(handler="a"), dict(handler="b"), {"class": "d"})) == 3


def test_collapse(spark):
    rows = [dict(handler="b", line=5, subject="s"), dict(handler="a", line=3, subject="s"), dict(handler="c", line=9, subject="s", absorbed_handlers=["q"]), dict(handler="z", subject="t"), dict(handler="n"), dict(handler="n")]
    got = O.collapse_by_subject(made(spark, *rows)).collect()
    one = next(r for r in got if r.subject == "s")
    assert len(got) == 4 and one.handler == "a" and one.absorbed_handlers == ["b", "c"]
    assert one.evidence.endswith("The same defect is reachable from 2 other handler(s): b, c.")
    assert next(r for r in got if r.subject == "t").evidence == "e"


def test_collapse_within_one_handler_says_zero(spark):
    got = O.collapse_by_subject(made(spark, dict(subject="s", line=1), dict(subject="s", line=2))).collect()
    assert len(got) == 1 and "0 other handler(s)" in got[0].evidence


def test_rank_order(spark):
    rows = [dict(handler="b"), dict(handler="a"), dict(handler="c", severity="critical"), dict(handler="d", severity="info", confidence=0.9)]
    assert [r.handler for r in O.ranked(made(spark, *rows), ("seq",)).collect()] == ["c", "a", "b", "d"]


def test_citations(spark):
    f = spark.createDataFrame([(1, ["u", "d1", "nope"]), (2, ["nope"]), (3, [])], "seq long, cited array<string>")
    offers = spark.createDataFrame([(1, 0, "d1", "u", "t1"), (1, 1, "d2", "u", "t2"), (2, 0, "d1", "u", "t1")], "seq long, offer int, doc_id string, source_url string, title string")
    got = O.resolve_citations(f, offers).collect()
    assert [(r.seq, [c.doc_id for c in r.citations]) for r in got] == [(1, ["d1"])]


def case(spark, baseline, mutant, label=("h", "c")):
    d = E.diff(made(spark, *baseline), made(spark, *mutant)).withColumn("case", F.lit("k"))
    labels = spark.createDataFrame([("k", *label)], "case string, handler string, class string")
    return d, labels


@pytest.mark.parametrize("baseline,mutant,tracks", [
    ([], [dict()], ["static"]),
    ([dict()], [dict()], []),
    ([], [dict(handler="x")], []),
    ([], [{"class": "x"}], []),
    ([], [dict(track="llm"), dict(track="static")], ["static", "llm"]),
    ([dict(track="llm")], [dict(track="llm"), dict(track="static")], ["static"]),
    ([], [], []),
])
def test_detection(spark, baseline, mutant, tracks):
    r = E.detected(*case(spark, baseline, mutant)).first()
    assert (r.detected, r.detecting_tracks) == (bool(tracks), tracks)


def test_summary_and_noise(spark):
    wrong = {"class": "x", "handler": "y"}
    d, labels = case(spark, [dict(handler="old"), dict(handler="old")], [dict(), wrong, wrong, {"class": "x"}, dict(handler="old"), dict(handler="old")])
    rows = {r.view: r for r in E.summarize(d, labels).collect()}
    assert (rows["static"].true_positives, rows["static"].false_positives) == (1, 2) and rows["static"].precision == pytest.approx(1 / 3)
    assert rows["llm"].recall == 0 and rows["llm"].precision is None and rows["merged"].recall == 1
    noise = {r.view: r for r in E.noise_floor(d, 500).collect()}
    assert (noise["static"].findings, noise["static"].per_kloc, noise["llm"].findings) == (1, 2.0, 0)
    assert E.noise_floor(d, 0).first().per_kloc == 0


def test_holdout(spark):
    f = made(spark, dict(handler="a", absorbed_handlers=["b"]), dict(handler="b", **{"class": "d"}))
    t = spark.createDataFrame([(1, "c", "a", True), (2, "c", "b", True), (3, "c", "z", True), (4, "c", "a", False)], "case int, class string, handler string, available boolean")
    out = E.holdout(t, f)
    assert {r.case: (r.outcome, r.reported_on) for r in out.collect()} == {1: ("direct", None), 2: ("absorbed", "a"), 3: ("missed", None), 4: ("unavailable", None)}
    s = E.summarize_holdout(out).first()
    assert (s.targets, s.scored, s.direct, s.absorbed) == (4, 3, 1, 1) and s.recall == pytest.approx(2 / 3)
    assert E.summarize_holdout(out.where("case = 4")).first().recall is None


def test_overlay(spark):
    clean = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, text string")
    assert {tuple(r) for r in E.overlay(clean, spark.createDataFrame([("b", "x")], clean.schema)).collect()} == {("a", "1"), ("b", "x")}
    with pytest.raises(ValueError, match="outside"):
        E.overlay(clean, spark.createDataFrame([("c", "x")], clean.schema))


def test_reports(spark):
    found = [dict(id="1", severity="high", confidence=0.9, track="static", file="/r/a.rs", line=3, handler="h", evidence="a|b\nc", citations=[]) | {"class": "x"}, dict(id="", severity="low", confidence=0.5, track="llm", file="b.rs", line=0, handler="k", evidence="z") | {"class": "y"}]
    rules = [dict(id=i, title=i, text=i, help="u") for i in ("w", "y", "x")]
    s = json.loads(R.sarif(found, rules, [dict(kind="skipped", message="m")], base="/r"))
    run = s["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["y", "x"] and [r["ruleIndex"] for r in run["results"]] == [1, 0]
    first, second = run["results"]
    assert first["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "a.rs"}, "region": {"startLine": 3}} and first["level"] == "error"
    assert "region" not in second["locations"][0]["physicalLocation"] and "partialFingerprints" not in second
    text = R.markdown(found, {"handlers": 2}, [])
    assert "a\\|b c" in text and "## Static track (1)" in text and "## All, in order (2)" in text
    assert R.sarif(found, rules, []) == R.sarif(found, rules, [])


def test_history(tmp_path):
    path = str(tmp_path / "h.json")
    with pytest.raises(FileNotFoundError):
        H.append(path, {})
    (tmp_path / "h.json").write_text("[]")
    H.append(path, {"run": 1})
    assert H.read(path) == [{"run": 1}]
    (tmp_path / "h.json").write_text("{}")
    with pytest.raises(H.Refused):
        H.append(path, {})
    hold = str(tmp_path / "runs.json")
    with pytest.raises(H.Refused):
        H.append_holdout(hold, {"scored": 0})
    H.append_holdout(hold, {"scored": 3})
    with pytest.raises(H.Refused):
        H.append_holdout(hold, {"scored": 4})
    H.append_holdout(hold, {"scored": 4}, force=True)
    assert len(H.read(hold)) == 2


GOOD = {"class": "c", "severity": "high", "confidence": 0.7, "handler": "h", "evidence": "e", "citations": ["d"]}


@pytest.mark.parametrize("reply,n", [
    (json.dumps({"findings": [GOOD]}), 1), (json.dumps({"findings": []}), 0), (json.dumps([GOOD, GOOD]), 2), ("```json\n" + json.dumps([GOOD]) + "\n```", 1),
    ("Sure [see below]: " + json.dumps([GOOD]) + " done]", 1), ("[] and " + json.dumps([GOOD]), 1), ("note [1] " + json.dumps([GOOD | {"evidence": "a ] \\\" ["}]), 1),
])
def test_replies(reply, n):
    assert len(M.parse_reply(reply)) == n


@pytest.mark.parametrize("reply", ["", "no list", "[1, 2]", json.dumps({"findings": [{}]}), json.dumps({"findings": 3}), json.dumps([GOOD | {"confidence": "x"}]), "[ open"])
def test_bad_replies(reply):
    with pytest.raises(M.ReplyProblem):
        M.parse_reply(reply)


def test_retry_then_drop():
    client = M.Replay({"u": ["junk", json.dumps([GOOD])]})
    assert M.complete(client, "", "u") == ([GOOD | {"line": None}], None) and "refused" in client.asked[1]
    found, problem = M.complete(M.Replay({"u": ["junk", "junk"]}), "", "u")
    assert found == [] and problem
    with pytest.raises(M.Unavailable):
        M.complete(M.Replay({}), "", "u")


def test_model_track(spark):
    replies = {"unit 1": [json.dumps([GOOD, GOOD | {"citations": ["nope"]}, GOOD | {"handler": "ghost"}])], "unit 2": ["junk", "junk"]}
    units = spark.createDataFrame([(1, "unit 1"), (2, "unit 2"), (3, "unit 3")], "seq long, user string").coalesce(1)
    answers = M.replies(units, lambda: M.Replay({k: list(v) for k, v in replies.items()})).cache()
    assert {r.seq: r.status for r in answers.collect()} == {1: "examined", 2: "dropped", 3: "unavailable"}
    offers = spark.createDataFrame([(1, 0, "d", "u", "t")], "seq long, offer int, doc_id string, source_url string, title string")
    handlers = spark.createDataFrame([("h", "f.rs", 12)], "name string, file string, line int")
    kept, lost = M.validated(answers, offers, handlers)
    row = kept.first()
    assert kept.count() == 1 and (row.line, row.track, row.severity) == (12, "llm", "high") and row.confidence == pytest.approx(0.56)
    assert [r.message for r in lost.collect()] == ["no handler `ghost`"]


def test_cases_that_share_a_run(spark):
    """Findings of a run that many cases share are counted as they are for each case by itself, and are not joined in pairs."""
    import random

    rng = random.Random(4)
    some = lambda: (f"h{rng.randint(0, 3)}", rng.choice("abc"))
    found = [(k, rng.choice(["static", "llm", "corroborated"]), *some(), rng.random() < 0.7) for k in range(3) for _ in range(40)] + [(0, "llm", None, "a", True), (1, "static", "h0", None, True)]
    d = spark.createDataFrame(found, 'k int, track string, handler string, class string, introduced boolean')
    labels = spark.createDataFrame([(f"c{i}", i % 4, *some()) for i in range(30)], "case string, k int, handler string, class string")
    every = d.join(labels.select("case", "k"), "k").drop("k")
    alone = labels.drop("k")
    assert sorted(map(str, E.summarize(d, labels, by="k").collect())) == sorted(map(str, E.summarize(every, alone).collect()))
    keys = lambda df: sorted((r.case, r.detected, tuple(r.detecting_tracks)) for r in df.collect())
    assert keys(E.detected(d, labels, by="k")) == keys(E.detected(every, alone))
    pairs = sum(1 for k, t, h, c, new in found if new and h and c for r in labels.collect() if r.k == k and r.handler != h and r["class"] != c)
    assert sum(r.n for r in E._wrong(d, labels, "k").collect()) == pairs
