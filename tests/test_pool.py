"""Requests at a time: wall time, order, retries, and one stop for all tasks."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lodestone.clients import pool
from lodestone.clients.transport import Broken, Status, TimedOut, Unavailable
from lodestone.operators import embedding
from lodestone.operators import model_track as M


class Slow:
    """Answers after a while."""

    def __init__(self, seconds=0.1):
        self.seconds = seconds

    def complete(self, system, user, schema=None):
        time.sleep(self.seconds)
        return json.dumps({"findings": [{"class": "c", "severity": "high", "confidence": 0.5, "handler": user, "evidence": "e", "citations": []}]})

    def embed(self, texts):
        time.sleep(self.seconds)
        return [[float(len(t)), 1.0] for t in texts]


def test_wall_time_falls_and_results_are_equal(spark):
    units = spark.createDataFrame([(k, f"h{k}") for k in range(40)], "seq long, user string").coalesce(1)
    took, got = {}, {}
    for workers in (1, 8):
        began = time.time()
        got[workers] = [(r.seq, r.status, r.findings[0].handler) for r in M.replies(units, Slow, workers=workers).collect()]
        took[workers] = time.time() - began
    assert got[1] == got[8] == [(k, "examined", f"h{k}") for k in range(40)]
    assert took[1] > 4.0 and took[8] < took[1] / 2


def test_embedding_at_a_time(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text")).coalesce(1)
    got = embedding.embed_documents(docs, Slow, batch=5, workers=10)
    assert {r.doc_id: r.embedding[0] for r in got.collect()} == {k: float(k) for k in range(100)}


def asked(failures):
    """An ask that fails by a list of problems, then answers."""
    left = list(failures)

    def ask(*_):
        if left:
            raise left.pop(0)
        return "done"

    return ask


def test_retries():
    assert pool.tried(asked([TimedOut("t"), Broken("b")]), 2, 0.001) == "done"
    assert pool.tried(asked([Status(503), Status(429)]), 2, 0.001) == "done"
    with pytest.raises(TimedOut):
        pool.tried(asked([TimedOut("t")] * 3), 2, 0.001)
    with pytest.raises(Status):
        pool.tried(asked([Status(400)]), 2, 0.001)
    with pytest.raises(Unavailable):
        pool.tried(asked([Unavailable("gone")]), 2, 0.001)


def test_order_and_what_is_held():
    taken = []

    def items():
        for k in range(50):
            taken.append(k)
            yield k

    out = pool.in_order(items(), object, lambda _, k: time.sleep(0.002 * (k % 5)) or k * k, pool.Stop(None), workers=4)
    assert next(out) == (0, 0, None) and len(taken) <= 8
    assert [x for x, *_ in out] == list(range(1, 50))


def test_a_problem_costs_one_item():
    def ask(_, k):
        if k == 3:
            raise ValueError("odd")
        return k

    got = {k: (r, str(p) if p else None) for k, r, p in pool.in_order(range(6), object, ask, pool.Stop(None), workers=2)}
    assert got[3] == (None, "odd") and got[4] == (4, None)


def test_one_stop_for_all_tasks(spark, tmp_path, monkeypatch):
    """A service that is gone for one task is not asked by another one, wherever that runs."""
    monkeypatch.setattr(pool, "_LOOK", 0.0)
    uri = f"file://{tmp_path}/flags/gone"
    calls = []

    def ask(_, k):
        calls.append(k)
        raise Unavailable("down")

    first = list(pool.in_order(range(20), object, ask, pool.Stop(uri), workers=2))
    assert all(p == "down" for *_, p in first) and len(calls) <= 4
    calls.clear()
    second = list(pool.in_order(range(20), object, ask, pool.Stop(uri), workers=2))
    assert all(p == "down" for *_, p in second) and not calls
    units = spark.createDataFrame([(k, f"u{k}") for k in range(12)], "seq long, user string").repartition(3)
    assert {r.status for r in M.replies(units, lambda: M.Replay({})).collect()} == {"unavailable"}
