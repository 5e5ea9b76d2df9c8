"""Sparse, dense and hybrid retrieval: the properties that the library promises."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions.score import cosine
from lodestone.functions.text import tokens
from lodestone.operators import retrieval as R


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        ("a", "missing_owner_check in the vault", "t"), ("b", "an owner of a missing thing may check it", "t"), ("c", "vault", "short"), ("d", "vault " + "filler words that say nothing " * 20, "long"),
        ("e", "accounts", "t"), ("f", "account", "t"), ("g", None, None), ("h", "", "vault"),
    ]
    return spark.createDataFrame(rows, "doc_id string, text string, title string")


def search(docs, q, k=10):
    return [(r.doc_id, r.score) for r in R.bm25(docs, {"q": q}, k).orderBy("rank").collect()]


def test_underscored_term_is_a_phrase(docs):
    assert [d for d, _ in search(docs, "missing_owner_check")] == ["a"]
    assert [d for d, _ in search(docs, "missing-owner-check")] == ["a"]
    assert {d for d, _ in search(docs, "missing owner check")} == {"a", "b"}


def test_shorter_focused_document_first(docs):
    found = search(docs, "vault")
    order = [d for d, _ in found]
    assert order.index("c") < order.index("d")
    assert all(s > 0 for _, s in found) and [s for _, s in found] == sorted((s for _, s in found), reverse=True)


def test_no_stemming_and_no_case(docs):
    assert [d for d, _ in search(docs, "ACCOUNTS")] == ["e"]
    assert [d for d, _ in search(docs, "account")] == ["f"]


def test_syntax_characters_and_empty_queries(docs):
    assert [d for d, _ in search(docs, '+"accounts"~ (')] == ["e"]
    assert search(docs, "") == [] and search(docs, "***") == [] and search(docs, "nowhere") == []
    assert len(search(docs, "vault", 1)) == 1 and search(docs, "vault", 0) == []


def test_repeated_phrases_side_by_side(spark):
    d = spark.createDataFrame([(1, "a b a b x a b", ""), (2, "aa b", "")], "doc_id long, text string, title string")
    got = d.select("doc_id", R._count(R.tokens(F.col("text")), ("a", "b")).alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {1: 3, 2: 0}


def test_ties_go_by_id(spark):
    d = spark.createDataFrame([(i, "same text", "t") for i in (3, 1, 2)], "doc_id long, text string, title string")
    assert [r.doc_id for r in R.bm25(d, {"q": "same"}, 2).orderBy("rank").collect()] == [1, 2]


def test_many_queries_at_once(docs):
    rows = R.bm25(docs, {"x": "vault", "y": "accounts"}, 2).collect()
    assert {r.query_id for r in rows} == {"x", "y"} and max(r.rank for r in rows) == 2


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [("c", [2.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.5, 0.0]), ("n", [0.0, 0.0]), ("z", [0.0, 1.0])]
    return spark.createDataFrame(rows, "doc_id string, embedding array<float>")


def test_cosine(spark, vectors):
    one = spark.range(1)
    score = lambda a, b: one.select(cosine(F.array(*[F.lit(x) for x in a]), F.array(*[F.lit(x) for x in b]))).first()[0]
    assert score([1.0, 2.0], [2.0, 4.0]) == pytest.approx(1)
    assert score([0.0, 0.0], [1.0, 1.0]) == 0 and score([1.0], [1.0, 1.0]) == 0


def test_nearest_ties_and_batch(spark, vectors):
    got = R.nearest(vectors, [3.0, 0.0], 3).collect()
    assert [r.doc_id for r in got] == ["a", "b", "c"]
    q = spark.createDataFrame([("q", [3.0, 0.0]), ("r", [0.0, 1.0])], "query_id string, embedding array<float>")
    rows = R.knn(vectors.repartition(3), q, 3).collect()
    assert [r.doc_id for r in sorted((r for r in rows if r.query_id == "q"), key=lambda r: r.rank)] == ["a", "b", "c"]
    assert sorted((r for r in rows if r.query_id == "r"), key=lambda r: r.rank)[0].doc_id == "z"


def test_lookup_skips_unknown_ids(spark, vectors):
    ids = spark.createDataFrame([("a",), ("nope",)], "doc_id string")
    assert [r.doc_id for r in R.scores_for(vectors, [1.0, 0.0], ids).collect()] == ["a"]


def test_dimension_guard(vectors):
    with pytest.raises(R.DimensionMismatch, match="2 numbers.*3"):
        R.check_dimension(vectors, 3)
    R.check_dimension(vectors.limit(0), 3)


def test_rrf(spark):
    rows = [("q", r, d) for r, d in ((1, "a"), (2, "b"), (3, "c"), (1, "z"), (2, "b"), (3, "y"))]
    got = {r.doc_id: r.rrf for r in R.rrf(spark.createDataFrame(rows, "query_id string, rank int, doc_id string")).collect()}
    assert max(got, key=got.get) == "b" and got["a"] == pytest.approx(1 / 61) and got["b"] == pytest.approx(2 / 62)


def test_hybrid(docs, vectors):
    hits = R.hybrid(docs, vectors, "vault accounts", [1.0, 0.0], 3).orderBy("rank").collect()
    assert len(hits) == 3 and [h.rank for h in hits] == [1, 2, 3]
    assert all(h.doc_id in "abcdefgh" for h in hits)  # n and z are not in the corpus and take no place
    sparse = R.hybrid(docs, None, "vault", None, 5).collect()
    assert sparse and all(h.dense is None for h in sparse)
    assert R.hybrid(docs, vectors, "vault", [1.0, 0.0], 0).count() == 0
    with pytest.raises(R.DimensionMismatch):
        R.hybrid(docs, vectors, "vault", [1.0], 3)


@pytest.mark.parametrize("hits,want", [([(0.62, None)], True), ([(0.61, 20.0)], False), ([(None, 0.1)], True), ([(None, None)], False), ([(None, 9.0), (0.3, None)], False), ([(0.1, None), (0.9, None)], True)])
def test_grounding(spark, hits, want):
    rows = spark.createDataFrame([("q", d, b) for d, b in hits], "query_id string, dense double, bm25 double")
    assert R.grounded(rows).first().grounded is want


def test_corpus_hash_ignores_order_and_sees_changes(docs, spark):
    full = docs.where("text is not null")
    one = R.corpus_hash(full).first()
    assert one == R.corpus_hash(full.orderBy(F.desc("doc_id")).repartition(5)).first() and one.documents == 7
    assert one != R.corpus_hash(full.withColumn("text", F.when(F.col("doc_id") == "c", "vaults").otherwise(F.col("text")))).first()


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "doc_id string, v int, seq int")
    assert {tuple(r) for r in R.upsert(old, new).collect()} == {("a", 1), ("b", 4), ("c", 5)}


def test_scan_takes_texts_apart_once(spark):
    """What is ranked are written counts: no text is split for a condition, or again for the scores."""
    docs = spark.createDataFrame([(i, "ha ha ha the", "the") for i in range(3)], "doc_id long, text string, title string")
    plan = R.bm25(docs, {"q": "ha-ha the-the"}, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan


def test_words_are_hashed_once(spark):
    d = spark.createDataFrame([("a b c",)], "text string").select(R.hash_embed(tokens(F.col("text")), 8).alias("e"))
    plan = d._jdf.queryExecution().analyzed().toString()
    assert plan.count("md5(") == 1 and plan.index("md5(") < plan.index("sequence(")  # outside of what runs for each bucket
