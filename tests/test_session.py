"""Scratch space: where it lies, and that it is cleared."""

import os

import pytest

from lodestone import session


def _there(uri):
    return os.path.exists(uri.replace("file:", "", 1))


def test_stored_tables_can_be_released(spark):
    first = session.mark(spark)
    a = session.stored(spark.range(10).toDF("x"), "a")
    b = session.stored(a.where("x > 3"), "b")
    paths = [p for p in session._written(spark)[first:]]
    assert len(paths) == 2 and all(map(_there, paths))
    assert session.release(spark, first, keep=b) == 1
    assert b.count() == 6 and [_there(p) for p in paths] == [False, True]
    c = session.stored(b.where("x > 5"), "c")
    session.forget(b)
    assert not _there(paths[1]) and c.count() == 4
    assert session.release(spark, first) == 1


def test_root_is_a_qualified_uri_and_honours_the_set_folder(spark):
    root = session.checkpoint_root(spark)
    assert root.startswith("file:") and root == session.checkpoint_root(spark)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        assert held.isDefined() and root.rstrip("/").endswith(held.get().rstrip("/").rpartition("/")[2])


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Held:
        def isDefined(self):
            return False

    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": lambda self: Held()})()

        def getConf(self):
            return {}

    with pytest.raises(session.NoSharedFolder):
        session.checkpoint_root(type("Spark", (), {"sparkContext": Context()})())


def test_stores_as_tasks_open_them(tmp_path):
    import pyarrow.fs as pafs

    from lodestone.session import UnknownStore, arrow_store

    for uri in (f"file:{tmp_path}/x", f"file://{tmp_path}/x", f"{tmp_path}/x"):
        fs, path = arrow_store(uri)
        assert isinstance(fs, pafs.LocalFileSystem) and path == f"{tmp_path}/x"
    assert arrow_store("dbfs:/a/b")[1] == "/dbfs/a/b"
    with pytest.raises(UnknownStore):
        arrow_store("viewfs://shelf/in")
