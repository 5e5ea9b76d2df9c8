"""Nearest vectors by pivots: the same as a scan whatever the data, with most of clustered vectors never scored."""

import numpy as np
import pytest

from lodestone.operators import pivots as P
from lodestone.operators import retrieval as R


def frame(spark, rows, key="doc_id"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{key} long, embedding array<double>")


def found(df):
    return {(r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect()}


def clustered(rng, n, width=16):
    centers = rng.normal(size=(20, width))
    hot = rng.random(n) < 0.35  # one cluster with a third of all
    which = np.where(hot, 0, rng.integers(0, 20, n))
    return centers[which] + 0.05 * rng.normal(size=(n, width))


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    rows = list(enumerate(clustered(rng, 6_000)))
    path = f"file://{tmp_path_factory.mktemp('pivots')}/p"
    v = frame(spark, rows)
    P.build(v, path, block=64)
    return rows, v, path


def test_exact_with_most_left_out(spark, many):
    rows, v, path = many
    asked = frame(spark, rows[::50], "query_id")
    work = P.Nearest(spark, path, 5, asked)
    got = found(work.run())
    assert got == found(R.knn(v, asked, 5))
    assert work.share() < 0.5


def test_exact_on_random_data(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = list(enumerate(rng.normal(size=(1_500, 24))))
    v, asked = frame(spark, rows), frame(spark, [(10_000 + i, x) for i, x in enumerate(rng.normal(size=(40, 24)))], "query_id")
    P.build(v, f"file://{tmp_path}/r", block=32)
    assert found(P.search(spark, f"file://{tmp_path}/r", asked, 7)) == found(R.knn(v, asked, 7))


def test_odd_vectors_and_queries(spark, tmp_path):
    """Zero, empty, null and other widths score 0; opposite ones below that; copies tie by id."""
    rows = [(9, [1, 0, 0]), (2, [1, 0, 0]), (5, [2, 0, 0]), (7, [0, 0, 0]), (1, None), (3, []), (4, [1, 1]), (6, [-1, 0, 0]), (8, [-2, 0.1, 0]), (0, [-1, 0, 0])]
    v = frame(spark, rows)
    path = f"file://{tmp_path}/odd"
    P.build(v, path, block=2)
    asked = frame(spark, [(1, [3, 0, 0]), (2, [0, 0, 0]), (3, None), (4, [1, 2]), (5, [-1, 0, 0])], "query_id")
    got = {q: [d for _, d in sorted((r["rank"], r.doc_id) for r in P.search(spark, path, asked, 8).collect() if r.query_id == q)] for q in range(1, 6)}
    assert got[1] == [2, 5, 9, 1, 3, 4, 7, 8] and got[5][:3] == [0, 6, 8] and got[5][3:] == [1, 3, 4, 7, 2]
    assert got[2] == got[3] == [0, 1, 2, 3, 4, 5, 6, 7]
    assert got[4] == got[2]  # vectors of the store's width only are placed; the one of this width is not compared


def test_few_vectors_and_none(spark, tmp_path):
    asked = frame(spark, [(1, [1, 0])], "query_id")
    P.build(frame(spark, []), f"file://{tmp_path}/none")
    assert P.search(spark, f"file://{tmp_path}/none", asked, 3).count() == 0
    P.build(frame(spark, [(1, [1, 1]), (2, [0, 1])]), f"file://{tmp_path}/few")
    assert [(r["rank"], r.doc_id) for r in P.search(spark, f"file://{tmp_path}/few", asked, 5).collect()] == [(1, 1), (2, 2)]
    assert P.search(spark, f"file://{tmp_path}/few", asked, 0).count() == 0 and P.search(spark, f"file://{tmp_path}/few", asked.limit(0), 2).count() == 0


def test_text_ids_and_many_queries_without_an_index(spark, many, monkeypatch):
    rows, v, _ = many
    asked = frame(spark, rows[::400], "query_id")
    want = found(R.knn(v, asked, 3))
    monkeypatch.setattr(R, "MOST_NUMBERS", 10)
    assert found(R.knn(v, asked, 3)) == want
    named = v.selectExpr("concat('k', doc_id) as doc_id", "embedding")
    assert {(q, r, f"k{d}") for q, r, d, _ in want} >= {(r.query_id, r["rank"], r.doc_id) for r in R.knn(named, asked.where("query_id = 400"), 1).collect()}
