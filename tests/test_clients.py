"""Transports, model clients, embedding, fetching, the model track, holdout and case trees: all without a network."""

import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from lodestone.clients import models as C
from lodestone.clients import transport as T
from lodestone.operators import cases, embedding, holdout, index, model_track, report
from lodestone.plans.sample_programs import LOCKER, SIEVE
from lodestone.sources import corpus


def answering(*answers):
    """A transport that gives recorded answers and keeps what was asked."""
    left, asked = list(answers), []

    def transport(method, url, body, headers, timeout):
        asked.append((method, url, json.loads(body) if body else None, headers, timeout))
        a = left.pop(0)
        if isinstance(a, Exception):
            raise a
        status, value = a
        return status, value if isinstance(value, bytes) else json.dumps(value).encode()

    return transport, asked


def test_errors_of_the_transport():
    for answer, kind in (((500, {}), "status"), ((200, b"{"), "transport"), (T.Unavailable("no"), "unavailable"), (T.TimedOut("late"), "timeout")):
        transport, _ = answering(answer)
        assert T.outcome(lambda: T.post_json("http://x", {}, transport=transport)) == (None, kind)
    transport, _ = answering((200, {"a": 1}))
    assert T.outcome(lambda: T.post_json("http://x", {}, transport=transport)) == ({"a": 1}, "ok")
    with pytest.raises(T.Unavailable):
        T.urlopen("GET", "http://127.0.0.1:9/", None, {}, 2)


def test_local_model():
    transport, asked = answering((200, {"response": "hi"}), (200, {"error": "x"}), (403, {}), (500, {}))
    m = C.LocalModel("http://h/", "m", transport)
    assert m.complete("s", "u", {"type": "object"}) == "hi" and m.name == "local/m"
    method, url, body, _, seconds = asked[0]
    assert (method, url, seconds) == ("POST", "http://h/api/generate", 120.0)
    assert body == {"model": "m", "system": "s", "prompt": "u", "stream": False, "options": {"temperature": 0.0, "num_predict": 1024}, "format": {"type": "object"}}
    assert "format" not in m.body(C.Request("s", "u"))
    with pytest.raises(C.Broken):
        m.complete("s", "u")
    with pytest.raises(C.Refused):
        m.complete("s", "u")
    with pytest.raises(C.Broken):
        m.complete("s", "u")


def test_hosted_model_keeps_its_key_to_itself(monkeypatch):
    monkeypatch.delenv(C.HOSTED_KEY, raising=False)
    with pytest.raises(C.Refused) as e:
        C.HostedModel("m")
    assert C.HOSTED_KEY in str(e.value)
    transport, asked = answering((200, {"candidates": [{"content": {"parts": [{"text": "[]"}]}}]}), (200, {"candidates": []}), (401, {"k": "topsecret"}))
    m = C.HostedModel("m", "topsecret", transport)
    assert "topsecret" not in repr(m) and m.complete("s", "u", model_track.SCHEMA) == "[]"
    _, url, body, headers, _ = asked[0]
    assert "topsecret" not in url and headers == {"Content-Type": "application/json", "x-goog-api-key": "topsecret"}
    assert body["generationConfig"]["responseMimeType"] == "application/json" and body["generationConfig"]["responseSchema"] == model_track.SCHEMA
    with pytest.raises(C.Broken):
        m.complete("s", "u")
    with pytest.raises(C.Refused) as e:
        m.complete("s", "u")
    assert "topsecret" not in str(e.value)


def test_embedder():
    transport, asked = answering((200, {"embeddings": [[1, 2], [3, 4]]}), (200, {"embeddings": [[1, 2]]}), (200, {"embeddings": [["x"]]}), (404, {}), (200, {"embedding": [5]}), (200, {"embedding": [6]}), T.Unavailable("no"))
    e = C.Embedder("http://h", "m", transport)
    assert e.embed([]) == [] and e.embed(["a", "b"]) == [[1.0, 2.0], [3.0, 4.0]]
    for texts in (["a", "b"], ["a"]):
        with pytest.raises(C.Broken):
            e.embed(texts)
    assert e.embed(["a", "b"]) == [[5.0], [6.0]] and asked[-1][1].endswith("/api/embeddings")
    with pytest.raises(C.Unavailable):
        e.embed(["a"])


class Counting(embedding.HashEmbedder):
    def embed(self, texts):
        assert len(texts) <= 32
        return super().embed(texts)


class Short(embedding.HashEmbedder):
    def embed(self, texts):
        return super().embed(texts)[1:]


class Uneven:
    def embed(self, texts):
        return [[1.0] * (1 + len(t) % 2) for t in texts]


class Flat:
    def embed(self, texts):
        return [[] for _ in texts]


class Gone:
    def embed(self, texts):
        raise T.Unavailable("nobody there")


def test_embedding_in_batches(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"word{i} and " + "x" * i, "t") for i in range(100)], "doc_id string, text string, title string").repartition(2)
    got = embedding.embed_documents(docs, lambda: Counting(8))
    assert got.count() == 100 and got.selectExpr("min(size(embedding))").first()[0] == 8
    assert embedding.embed_documents(docs.limit(0), lambda: Counting(8)).count() == 0
    for bad in (Short, Uneven, Flat):
        with pytest.raises(embedding.BadVectors):
            embedding.embed_documents(docs, bad)
    with pytest.raises(T.Unavailable):
        embedding.embed_documents(docs, Gone)
    path = f"file://{tmp_path}/i"
    assert index.build(docs, path, lambda d: embedding.embed_documents(d, Gone), "m", 8) is False
    assert index.build(docs, path, lambda d: embedding.embed_documents(d, lambda: Counting(8)), "m", 8) is True
    assert index.size(index.open_vectors(spark, path, "m", 8)).first().asDict() == {"vectors": 100, "dim": 8, "is_empty": False}


def test_phrases_may_overlap(spark, tmp_path):
    from lodestone.operators.retrieval import bm25

    docs = spark.createDataFrame([("a", "ha ha ha ho", "x"), ("b", "ha ho ha", "ha ha"), ("c", "", ""), ("d", None, None), ("e", "the ha-ha of ha, ha", "t")], "doc_id string, text string, title string")
    path = f"file://{tmp_path}/i"
    index.build_sparse(docs, path)
    for queries in ({"q": "ha-ha"}, {"q": "ha ho"}, {"q": "ho-ha zebra", "r": "the"}, {"q": "zebra"}):
        a = {(r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in bm25(docs, queries, 3).collect()}
        b = {(r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in index.search(spark, path, queries, 3).collect()}
        assert a == b
    counts = docs.select(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\w]+").alias("w"))
    from lodestone.operators.retrieval import _count

    assert [r[0] for r in counts.select(_count(F.col("w"), ("ha", "ha"))).collect()] == [2, 0, 0, 0, 2]
    assert {r.doc_id: r.title for r in index.described(spark, path, docs.where("doc_id in ('a', 'zz')")).collect()} == {"a": "x"}


def archive(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_fetch(spark, tmp_path):
    (tmp_path / "m.toml").write_text(
        '[[source]]\nid = "a"\nurl = "http://a"\ntitle = "A"\n[[source]]\nid = "b"\nurl = "http://b"\ntitle = "B"\nkind = "archive"\ninclude_paths = ["docs/"]\n'
        '[[source]]\nid = "c"\nurl = "http://c"\ntitle = "C"\n'
    )
    m = corpus.load_manifest(spark, f"file://{tmp_path}/m.toml")
    packed = archive({"top/docs/x.md": b"# X", "top/other/y.md": b"no", "top/docs/z.bin": b"no", "top/docs/bad.md": b"\xff\xfe", "top/docs/../../e.md": b"no"})

    def web(page, packed=packed):
        def transport(method, url, body, headers, timeout):
            if url == "http://c":
                raise T.Unavailable("down")
            return 200, page if url == "http://a" else packed

        return transport

    first = {r.source_id: r for r in corpus.fetch(m, f"{tmp_path}/cache", web(b"<p>one</p>")).collect()}
    assert (first["a"].outcome, first["b"].outcome, first["c"].outcome, first["c"].status) == ("fetched", "fetched", "failed", "unavailable")
    assert (tmp_path / "cache/b.txt").read_text() == "# top/docs/x.md\n\n# X"
    known = m.withColumn("sha256", F.when(F.col("id") == "a", first["a"].new_sha256).otherwise(F.lit("0" * 64)))
    again = {r.source_id: r for r in corpus.fetch(known, f"{tmp_path}/cache", web(b"<p>one</p>")).collect()}
    assert (again["a"].outcome, again["b"].outcome, again["b"].size_change) == ("unchanged", "changed", "same size, different content")
    with pytest.raises(ValueError):
        corpus.fetch(m, f"{tmp_path}/cache", web(b"<p>one</p>", archive({"top/z.md": b"x"})))
    assert {r.source_id for r in corpus.cached(m, f"file://{tmp_path}/cache").collect()} == {"a", "b"}


def test_archives_that_match_nothing(spark, tmp_path):
    (tmp_path / "x.tar.gz").write_bytes(archive({"top/a.md": b"x"}))
    assert corpus.archive_files(spark, f"file://{tmp_path}/x.tar.gz").count() == 1
    with pytest.raises(ValueError):
        corpus.archive_files(spark, f"file://{tmp_path}/x.tar.gz", includes=("docs/",))


GOOD = {"class": "missing-signer", "severity": "high", "confidence": 0.8, "handler": "drain", "line": 0, "evidence": "no signer", "citations": ["one"]}


def test_review(spark, tmp_path):
    from lodestone.lang.ir import program
    from lodestone.lang.units import units

    files = spark.createDataFrame([("s", "s.rs", SIEVE)], "program string, path string, text string")
    docs = spark.createDataFrame([("one", "Instruction accounts must sign", "Signers", "http://one"), ("two", "cheese", "Food", "http://two")], "doc_id string, text string, title string, source_url string")
    path = f"file://{tmp_path}/i"
    index.build_sparse(docs, path)
    p = program(files)
    u, handlers = units(p, files), p.handlers.select("name", "file", "line")
    said = {"`drain`": [json.dumps({"findings": [GOOD, GOOD | {"handler": "ghost"}, GOOD | {"citations": ["nope"]}]})], "`fill`": ["junk", "junk"]}
    said |= {f"`{h.name}`": ['{"findings": []}'] for h in handlers.collect() if h.name not in ("drain", "fill")}
    r = model_track.review(u, handlers, path, lambda: model_track.Replay({k: list(v) for k, v in said.items()}), 2)
    found = r.findings.collect()
    assert [(f.handler, f["class"], f.track, f.citations[0].source_url) for f in found] == [("drain", "missing-signer", "llm", "http://one")] and found[0].line > 0
    told = sorted((d.kind, d.message.split(":")[0]) for d in r.diagnostics.collect())
    assert told == [("skipped", "handler `fill` was not reviewed"), ("skipped", "no handler `ghost`")]
    assert r.units == handlers.count() and r.examined == r.units - 1
    gone = model_track.review(u, handlers, path, lambda: model_track.Replay({}), 2)
    assert gone.findings.count() == 0 and gone.examined == 0 and [d.kind for d in gone.diagnostics.collect()] == ["track skipped"]


def test_retrieval_of_many_queries_is_that_of_each(spark, tmp_path):
    from lodestone.operators.retrieval import hybrid

    docs = spark.createDataFrame([(f"d{i}", " ".join(f"w{(i * k) % 7}" for k in range(1, 9)), f"t{i}") for i in range(30)], "doc_id string, text string, title string")
    path = f"file://{tmp_path}/i"
    index.build(docs, path, lambda d: embedding.embed_documents(d, lambda: embedding.HashEmbedder(8)), "h", 8)
    vectors = index.open_vectors(spark, path, "h", 8)
    queries = {"a": "w1 w2", "b": "w3", "c": "nothing"}
    embed = embedding.HashEmbedder(8).embed
    key = lambda r: (r["rank"], r.doc_id, round(r.rrf, 9), None if r.dense is None else round(r.dense, 6), None if r.bm25 is None else round(r.bm25, 6))
    for dense in (True, False):
        got = model_track.retrieved(spark, path, queries, 4, vectors if dense else None, embed if dense else None).collect()
        for q, text in queries.items():
            want = hybrid(docs, vectors if dense else None, text, embed([text])[0] if dense else None, 4).collect()
            assert sorted(key(r) for r in got if r.query_id == q) == sorted(map(key, want))


CASES = """
[[case]]
id = "one"
repo = "r"
commit = "c0ffee000000aaaa"
path = "programs/s/src/lib.rs"
handler = "drain"
class = "missing-owner-check"
severity = "high"
source = "x"
[[case]]
id = "two"
repo = "r"
commit = "c0ffee000000aaaa"
path = "programs/s/src/lib.rs"
handler = "nobody"
class = "no-such-class"
[[case]]
id = "three"
repo = "gone"
commit = "1"
path = "x.rs"
handler = "h"
class = "missing-signer"
[[case]]
id = "four"
repo = "empty"
commit = "2"
path = "lib.rs"
handler = "h"
class = "missing-signer"
"""


def test_holdout(spark, tmp_path):
    (tmp_path / "cases.toml").write_text(CASES)
    held = holdout.load_cases(tmp_path / "cases.toml")
    fetched = []

    def fetch(repo, commit, folder):
        fetched.append(repo)
        if repo == "gone":
            raise holdout.NoCheckout("no such repository")
        where = os.path.join(folder, "programs/s/src") if repo == "r" else folder
        os.makedirs(where)
        open(os.path.join(os.path.dirname(where) if repo == "r" else where, "Cargo.toml"), "w").close()
        with open(os.path.join(where, "lib.rs"), "w") as f:
            f.write(SIEVE if repo == "r" else "fn main() {}")

    folder = str(tmp_path / "checkouts")
    got = {r["case"]: r for r in holdout.score(spark, held, folder, fetch=fetch).collect()}
    assert got["one"].outcome in ("direct", "absorbed") and got["two"].outcome == "missed"
    assert got["three"].outcome == "unavailable" and "no such" in got["three"].reason
    assert got["four"].outcome == "unavailable" and "0 handlers" in got["four"].reason
    assert fetched == ["r", "r", "gone", "empty"] and held[0].folder == "one-c0ffee000000"
    again = holdout.score(spark, held[:2], folder, offline=True, fetch=fetch)
    assert len(fetched) == 4 and {r.outcome for r in again.collect()} <= {"direct", "absorbed", "missed"}
    with pytest.raises(holdout.NoCheckout):
        holdout.checkout(held[2], folder, offline=True)
    (tmp_path / "checkouts" / held[0].folder / holdout.MARKER).write_text("other")
    with pytest.raises(holdout.NoCheckout):
        holdout.checkout(held[0], folder)
    with pytest.raises(holdout.NoCheckout):
        holdout.program_root(folder, "nothing.rs")
    assert "1 of 4" in holdout.warning(held, ["missing-signer", "missing-owner-check"]) and holdout.warning(held[:1], ["missing-owner-check"]) is None
    runs = str(tmp_path / "runs.json")
    row = holdout.record(runs, again, "r1", "1")
    assert row["scored"] == 2 and row["is_complete"] and row["tracks"] == ["static"]
    from lodestone.operators.history import Refused

    with pytest.raises(Refused):
        holdout.record(runs, again, "r2", "1")


def test_case_trees(spark, tmp_path):
    from lodestone.lang.ir import program
    from lodestone.lang.mutations import mutants

    root = tmp_path / "locker"
    (root / "src").mkdir(parents=True)
    (root / "target").mkdir()
    (root / "target/x.rs").write_text("no")
    (root / "src/lib.rs").write_text(LOCKER)
    files = spark.createDataFrame([("locker", "src/lib.rs", LOCKER)], "program string, path string, text string")
    made = mutants(program(files), files).orderBy("operator", "id").collect()
    out = str(tmp_path / "out")
    names = cases.materialize(str(root), made, out)
    assert names == [f"{m.operator}-{m.id}" for m in made] and len(names) > 5
    assert open(f"{out}/original/src/lib.rs").read() == LOCKER and not os.path.exists(f"{out}/original/target")
    label = json.load(open(f"{out}/cases/{names[0]}/label.json"))
    assert label["operator"] == made[0].operator and open(f"{out}/cases/{names[0]}/src/lib.rs").read() == made[0].text != LOCKER
    assert cases.reject(out, names[0], "does not build")["name"] == names[0] and os.path.isdir(f"{out}/rejected/{names[0]}")
    assert cases.materialize(str(root), made[:2], out) == names[:2] and sorted(os.listdir(f"{out}/cases")) == sorted(names[:2])
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine/file").write_text("x")
    with pytest.raises(cases.NotOurs):
        cases.materialize(str(root), made, str(tmp_path / "mine"))
    with pytest.raises(ValueError):
        cases.materialize(str(root), [made[0].asDict() | {"file": "../x.rs"}], out)


def test_report_detail():
    f = {"id": "i", "class": "missing-signer", "severity": "high", "confidence": 0.9, "track": "llm", "file": "/r/a.rs", "line": 0, "handler": "h", "evidence": "a|b\nc", "subject": "s", "absorbed_handlers": ["g"], "citations": [{"doc_id": "d", "source_url": "http://u", "title": "T"}]}
    notes = [{"kind": "parse", "file": "/r/b.rs", "message": "m"}, {"kind": "ambiguity", "file": None, "message": "n"}]
    doc = json.loads(report.sarif([f], [], notes, "/r"))["runs"][0]
    r = doc["results"][0]
    assert r["relatedLocations"] == [{"physicalLocation": {"artifactLocation": {"uri": "http://u"}}, "message": {"text": "T"}}]
    assert r["properties"]["subject"] == "s" and r["properties"]["absorbedHandlers"] == ["g"] and "region" not in r["locations"][0]["physicalLocation"]
    told = doc["invocations"][0]["toolExecutionNotifications"]
    assert [t["level"] for t in told] == ["warning", "note"] and told[0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "b.rs" and "locations" not in told[1]
    text = report.markdown([f], {"handlers": 1}, notes, {"model": None})
    assert "No findings." in text and "cites [T](http://u)" in text and "a\\|b c" in text and "- model: none" in text


def test_commands(spark, tmp_path, capsys):
    from lodestone.__main__ import main

    (tmp_path / "locker").mkdir()
    (tmp_path / "locker/lib.rs").write_text(LOCKER)
    assert main(["mutate", f"{tmp_path}/locker", f"{tmp_path}/out"]) == 0 and "case(s) below" in capsys.readouterr().out
    (tmp_path / "cases.toml").write_text(CASES)
    assert main(["holdout", "--cases", f"{tmp_path}/cases.toml"]) == 0
    assert "4 case(s); nothing scored" in capsys.readouterr().out
    assert main(["analyze", f"file:{tmp_path}/locker", "--llm", "--host", "http://127.0.0.1:9", "--index", f"file:{tmp_path}/none"]) == 0
    assert "track skipped" in capsys.readouterr().out
