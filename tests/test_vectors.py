"""The store of vectors as a log: writes of a put, merging, compaction, and writers that die or meet."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import keyed, vectors as V
from lodestone.operators.retrieval import DimensionMismatch

SCHEMA = "doc_id string, embedding array<float>, seq int"


def put(spark, path, rows):
    return V.put_vectors(spark.createDataFrame(rows, SCHEMA), path)


def held(spark, path, ids=None):
    return {r.doc_id: list(r.embedding) for r in V.open_vectors(spark, path, "m", 2, ids).collect()}


@pytest.fixture
def store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    V.init_vectors(spark, path, "m", 2)
    put(spark, path, [(f"k{i}", [float(i), 0.0], 0) for i in range(20)])
    return path


def test_a_put_writes_only_its_rows(spark, store):
    before = V.manifest(spark, store)
    assert before.base and not before.deltas and before.rows[before.base] == 20
    after = put(spark, store, [("k3", [1.0, 1.0], 0), ("k3", [2.0, 2.0], 1), ("new", [3.0, 3.0], 0)])
    assert after.base == before.base and len(after.deltas) == 1
    assert keyed.read(spark, f"{store}/data/{after.deltas[0]}").count() == 2
    now = held(spark, store)
    assert len(now) == 21 and now["k3"] == [2, 2] and now["new"] == [3, 3] and now["k4"] == [4, 0]


def test_newest_delta_holds_until_compaction_and_after(spark, store):
    for k in range(V.MOST_DELTAS + 3):
        m = put(spark, store, [("k1", [float(k), 9.0], 0)])
        assert held(spark, store)["k1"] == [k, 9] and len(m.deltas) < V.MOST_DELTAS
    now = held(spark, store)
    assert len(now) == 20
    m = V.compact(spark, store)
    assert not m.deltas and m.rows[m.base] == 20 and held(spark, store) == now
    assert V.vacuum(spark, store) > 0 and held(spark, store) == now
    assert len(V._Files(spark, store).names(V._Files(spark, store).at("data"))) == 1


@pytest.mark.parametrize("at", ["rows", "manifest", "compaction"])
def test_a_writer_that_dies(spark, store, monkeypatch, at):
    """Killed after its rows are written, while the manifest is, or in a compaction: the store is as before, and goes on."""
    before = held(spark, store)

    class Killed(BaseException):
        pass

    def die(*_):
        raise Killed

    with monkeypatch.context() as m:
        if at == "rows":
            m.setattr(V, "_changed", die)
        elif at == "manifest":
            m.setattr(V, "asdict", die)
        else:
            m.setattr(V, "_write", lambda df, path, w=V._write: die() if "late" in str(df._jdf.queryExecution().logical()) else w(df, path))
        with pytest.raises(Killed):
            if at == "compaction":
                put(spark, store, [("k1", [7.0, 7.0], 0)])
                V.compact(spark, store)
            else:
                put(spark, store, [("k1", [7.0, 7.0], 0)])
    assert held(spark, store) == (before | {"k1": [7.0, 7.0]} if at == "compaction" else before)
    put(spark, store, [("k2", [8.0, 8.0], 0)])
    assert held(spark, store)["k2"] == [8, 8]
    V.vacuum(spark, store)
    assert held(spark, store)["k2"] == [8, 8]


def test_two_writers_meet(spark, store, monkeypatch):
    """Another writer takes the number first: both puts hold."""
    commit, done = V._Files.commit, []

    def late(self, version, manifest):
        if not done:
            done.append(1)
            put(spark, store, [("other", [5.0, 5.0], 0)])
        return commit(self, version, manifest)

    monkeypatch.setattr(V._Files, "commit", late)
    put(spark, store, [("mine", [6.0, 6.0], 0)])
    now = held(spark, store)
    assert now["other"] == [5, 5] and now["mine"] == [6, 6] and len(now) == 22


def test_compaction_keeps_what_comes_meanwhile(spark, store, monkeypatch):
    put(spark, store, [("k1", [7.0, 7.0], 0)])
    write = V._write
    done = []

    def slow(df, path):
        out = write(df, path)
        if not done:
            done.append(1)
            put(spark, store, [("k1", [8.0, 8.0], 0)])
        return out

    monkeypatch.setattr(V, "_write", slow)
    m = V.compact(spark, store)
    assert len(m.deltas) == 1 and held(spark, store)["k1"] == [8, 8] and held(spark, store)["k5"] == [5, 0]


def test_lookup_over_base_and_deltas(spark, store):
    put(spark, store, [("k1", [7.0, 7.0], 0)])
    put(spark, store, [("k2", [8.0, 8.0], 0), ("x", [9.0, 9.0], 0)])
    ids = spark.createDataFrame([("k1",), ("k3",), ("x",), ("none",)], "doc_id string")
    assert held(spark, store, ids) == {"k1": [7, 7], "k3": [3, 0], "x": [9, 9]}


def test_guards(spark, store, tmp_path):
    with pytest.raises(DimensionMismatch):
        put(spark, store, [("a", [1.0], 0)])
    with pytest.raises(DimensionMismatch):
        put(spark, store, [("a", None, 0)])
    assert len(held(spark, store)) == 20
    with pytest.raises(V.NoModel):
        put(spark, f"file://{tmp_path}/none", [("a", [1.0, 2.0], 0)])
    assert V.open_vectors(spark, f"file://{tmp_path}/none", "m", 2) is None and V.vacuum(spark, f"file://{tmp_path}/none") == 0
    V.init_vectors(spark, store, "m", 2)
    assert len(held(spark, store)) == 20
    V.init_vectors(spark, store, "other", 2)
    assert V.open_vectors(spark, store, "other", 2).count() == 0
    assert V.size(V.open_vectors(spark, store, "other", 2)).first().is_empty
    V.put_vectors(spark.createDataFrame([(None, [1.0, 1.0], 0), (None, [2.0, 2.0], 1)], SCHEMA), store)
    assert V.open_vectors(spark, store, "other", 2).where(F.col("doc_id").isNull()).first().embedding == [2.0, 2.0]
