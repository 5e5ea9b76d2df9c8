"""Blocks of postings with greatest impacts: exact results, skipped spans, stored frequencies, keyed lookups."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import index as I
from lodestone.operators import keyed, postings
from lodestone.operators.retrieval import bm25

SCHEMA = "doc_id long, text string, title string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents by topic, so that a topic's words and long runs of them lie in few spans."""
    rng = random.Random(12)
    common = "the of and to in a is that it for".split()
    rows = []
    for i in range(600):
        topic = i // 60
        words = [rng.choice(common) if rng.random() < 0.6 else f"w{topic}x{rng.randint(0, 5)}" for _ in range(rng.randint(1, 60))]
        if i % 97 == 0:
            words += ["needle"] * (1 + i // 97)
        rows.append((i, " ".join(words), f"topic {topic}"))
    rows += [(1000, None, None), (1001, "", "needle"), (1002, "ha ha ha ha", "x"), (1003, "the-the and", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    path = f"file://{tmp_path_factory.mktemp('postings')}/index"
    I.build_sparse(docs, path, span_docs=8)
    return docs, path


QUERIES = {"a": "needle", "b": "the needle", "c": "w3x1 w3x2", "d": "and the", "e": "the_and ha-ha", "f": "ha_ha_ha", "g": "nowhere", "h": "needle nowhere w9x0", "i": "the the", "j": "topic"}


def rows(df):
    return {(r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 3, 25, 5000])
def test_same_as_a_scan(spark, corpus, k):
    docs, path = corpus
    assert rows(I.search(spark, path, QUERIES, k)) == rows(bm25(docs, QUERIES, k))


def test_queries_as_rows(spark, corpus):
    docs, path = corpus
    asked = spark.createDataFrame([*QUERIES.items(), ("empty", ""), ("null", None), ("signs", "***")], "query_id string, text string")
    assert rows(I.search(spark, path, asked, 4)) == rows(bm25(docs, QUERIES, 4))


def test_spans_are_skipped(spark, corpus):
    """Spans that cannot reach the k-th best score are not read, and each document that counts is among the others."""
    docs, path = corpus
    work = postings.searching(spark, path, {"q": "the needle w7x0"}, 2)
    found = {r.doc_id for r in work.run().collect()}
    every, scored = work.bounds.count(), work.seeds.count() + work.rest.count()
    assert every > 70 and scored <= every / 3
    assert found == {r.doc_id for r in bm25(docs, {"q": "the needle w7x0"}, 2).collect()}
    # no document's score is above its span's bound
    spans = keyed.read(spark, f"{path}/documents").select("doc_id", F.col("_span").alias("span"))
    above = work.scored(None).join(spans, "doc_id").join(work.bounds, ["query_id", "span"], "left").where("bound is null or score > bound")
    assert above.count() == 0


def test_many_tokens_are_joined(spark, corpus, monkeypatch):
    docs, path = corpus
    monkeypatch.setattr(postings, "MOST_TOKENS", 2)
    monkeypatch.setattr(postings, "MOST_BROADCAST", 1)
    assert rows(I.search(spark, path, QUERIES, 6)) == rows(bm25(docs, QUERIES, 6))


def test_dictionary_has_frequencies(spark, corpus):
    docs, path = corpus
    held = {(r.tok, r.field): r.df for r in spark.read.parquet(f"{path}/dictionary").collect()}
    assert held["needle", "text"] == 7 and held["needle", "title"] == 1
    assert held["the", "text"] == docs.where("concat(' ', text, ' ') like '% the %' or text = 'the-the and'").count()


def test_search_reads_heads_before_entries(spark, corpus):
    _, path = corpus
    work = postings.searching(spark, path, {"q": "the"}, 2)
    plan = work.bounded()._jdf.queryExecution().executedPlan().toString()
    assert "places" not in plan and "tf#" not in plan.split("ReadSchema", 1)[1].split("\n", 1)[0]
    work = postings.searching(spark, path, {"q": "the"}, 2)
    assert "places" not in work.scored(None)._jdf.queryExecution().executedPlan().toString()  # no phrase, no places


def test_parts_follow_bytes(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert keyed.parts_for(spark, 0) == n and keyed.parts_for(spark, 100 * keyed.PART_BYTES) == 100 and keyed.parts_for(spark, 100 * keyed.PART_BYTES + 1) == 101
    assert keyed.measured(spark.createDataFrame([("abc", 1), ("é", None)], "a string, b long")) == 3 + 2 + 16


def scan_metrics(df):
    """What the scans of a plan that has run have read."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []
    todo = [plan.executedPlan() if hasattr(plan, "executedPlan") and "Adaptive" in plan.nodeName() else plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            m = node.metrics()
            out.append({k: m.apply(k).value() for k in ("numFiles", "numOutputRows")})
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


def test_lookup_reads_few_files(spark, tmp_path):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    path = f"file://{tmp_path}/keyed"
    keyed.write(docs, path, 16)
    ids = spark.createDataFrame([(5,), (6,), (19_000,), (-4,), (None,)], "doc_id long")
    found = keyed.lookup(spark, path, ids)
    read = scan_metrics(found)
    assert {r.doc_id for r in found.collect()} == {5, 6, 19_000}
    assert len(read) == 1 and read[0]["numFiles"] == 2
    assert keyed.lookup(spark, path, ids.where("doc_id < 0")).count() == 0 and keyed.lookup(spark, path, ids.limit(0)).count() == 0


def test_lookup_of_many_ids_and_strings(spark, tmp_path, monkeypatch):
    docs = spark.range(300).select(F.concat(F.lit("k"), "id").alias("doc_id"), "id")
    path = f"file://{tmp_path}/strings"
    keyed.write(docs, path, 5)
    ids = docs.where("id % 3 = 0").select("doc_id").union(docs.limit(3).select("doc_id"))
    few = keyed.lookup(spark, path, ids).count()
    monkeypatch.setattr(keyed, "MOST_IDS", 10)
    assert few == keyed.lookup(spark, path, ids).count() == ids.distinct().count()


def test_empty_and_single(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    I.build_sparse(spark.createDataFrame([], SCHEMA), path)
    assert I.search(spark, path, {"q": "a"}, 3).count() == 0 and I.open_sparse(spark, path).count() == 0
    I.build_sparse(spark.createDataFrame([(1, "a", "b")], SCHEMA), path)
    assert [r.doc_id for r in I.search(spark, path, {"q": "a b"}, 3).collect()] == [1]
    assert I.search(spark, path, {"q": ""}, 3).count() == 0 and I.search(spark, path, {"q": "a"}, 0).count() == 0
    assert I.open_sparse(spark, path).columns == ["doc_id", "text", "title"]


def test_a_span_in_several_blocks(spark, tmp_path, monkeypatch):
    """Spans with more tokens than a task holds are cut between documents, and nothing is found otherwise."""
    held = []
    for most in (3, 1_000_000):
        monkeypatch.setattr(postings, "MOST_HELD", most)
        batches = [pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "span": [0, 0, 0], "t0": [["a", "b", "a"], [], ["b"]]}), pa.RecordBatch.from_pydict({"doc_id": [4, 5], "span": [0, 1], "t0": [["a", "a", "a", "a"], ["a"]]})]
        rows = [r for b in postings._inverted(iter(batches), ("t0",), {"t0": 2.0}) for r in b.to_pylist()]
        held.append((len(rows), sorted((r["tok"], r["span"], d, x[i], x[n + i], tuple(x[3 * n :][x[2 * n + i] : x[2 * n + i] + x[n + i]])) for r in rows for x, n in ((r["packed"], r["n"]),) for i, d in enumerate(r["doc_id"]))))
    assert [n for n, _ in held] == [5, 3] and held[0][1] == held[1][1]
    assert held[0][1] == [("a", 0, 1, 3, 2, (0, 2)), ("a", 0, 4, 4, 4, (0, 1, 2, 3)), ("a", 1, 5, 1, 1, (0,)), ("b", 0, 1, 3, 1, (1,)), ("b", 0, 3, 1, 1, (0,))]


def test_phrases_exchange_documents(spark, tmp_path):
    """A phrase's rows are a document's, with its places in them: these are not rows of their own."""
    docs = spark.createDataFrame([(i, "ha " * (20 + i), "x") for i in range(64)], SCHEMA)
    path = f"file://{tmp_path}/index"
    I.build_sparse(docs, path, span_docs=8)
    plan = postings.searching(spark, path, {"q": "ha-ha"}, 3).scored(None)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2  # the documents of blocks, for words and for phrases
    assert rows(I.search(spark, path, {"q": "ha-ha"}, 3)) == rows(bm25(docs, {"q": "ha-ha"}, 3))
