"""Archives as a data source: which files, how they are dealt, and how much is held."""

import io
import tarfile
import tracemalloc

import pytest

from lodestone.sources import archives as A


def tar(path, files, mode="w:gz", **more):
    with tarfile.open(path, mode, **more) as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def test_an_archive_of_500_mb_holds_one_file_at_a_time(spark, tmp_path):
    """500 files of a megabyte, of which every tenth is wanted, and as many small ones."""
    block = (b"a line of source text that goes on\n" * 30_000)[: 1 << 20]
    tar(tmp_path / "big.tar.gz", ((f"top/{'src' if k % 10 == 0 else 'data'}/f{k}.{'rs' if k % 10 == 0 else 'bin'}", block) for k in range(500)), compresslevel=1)
    path = f"file:{tmp_path}/big.tar.gz"
    tracemalloc.start()
    with A.opened(path) as stream:
        n = sum(len(text) for _, text in A.members(stream))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 50 << 20 and peak < 12 << 20
    got = A.archive_files(spark, path)
    assert got.count() == 50 and got.selectExpr("sum(length(text))").first()[0] == 50 << 20


def test_archives_are_dealt_by_size():
    files = [(f"a{k}", n) for k, n in enumerate([500, 90, 10, 10, 10, 70, 0])]
    out = A.dealt(files, 100)
    assert sorted(p for t in out for p in t) == sorted(p for p, _ in files) and ["a0"] in out
    size = dict(files)
    assert all(len(t) == 1 or sum(size[p] for p in t) <= 100 for t in out)
    assert A.dealt([]) == []


def test_many_archives_in_tasks(spark, tmp_path, monkeypatch):
    for k in range(6):
        tar(tmp_path / f"r{k}.tar.gz", [(f"repo/src/x{k}.rs", b"fn"), ("repo/doc/y.md", "é".encode() * 900), ("/abs.rs", b"x"), ("repo/../up.rs", b"x"), ("repo/src/bad.rs", b"\xff"), ("repo/z.txt", b"z")])
    monkeypatch.setattr(A, "TASK_BYTES", 1)
    monkeypatch.setattr(A.dealt, "__defaults__", (1,))
    df = A.archive_files(spark, f"file:{tmp_path}/*.tar.gz")
    assert df.rdd.getNumPartitions() == 6
    assert sorted((r.archive[-9:], r.path) for r in df.collect()) == sorted((f"r{k}.tar.gz", p) for k in range(6) for p in (f"repo/src/x{k}.rs", "repo/doc/y.md"))
    some = A.archive_files(spark, f"file:{tmp_path}/*.tar.gz", keep=("rs",), includes=("/src/x1",))
    assert [(r.path, r.text) for r in some.collect()] == [("repo/src/x1.rs", "fn")]
    with pytest.raises(ValueError, match="no file matches"):
        A.archive_files(spark, f"file:{tmp_path}/*.tar.gz", includes=("nope/",))


def test_other_compressions_and_broken_archives(spark, tmp_path):
    tar(tmp_path / "p.tar", [("a/b.md", b"x")], "w")
    tar(tmp_path / "q.tar.bz2", [("a/c.md", b"y")], "w:bz2")
    assert sorted(r.text for r in A.archive_files(spark, f"file:{tmp_path}/*.tar*").collect()) == ["x", "y"]
    tar(tmp_path / "w.tar.gz", [("a/b.md", bytes(range(32, 127)) * 2_000)])
    cut = (tmp_path / "w.tar.gz").read_bytes()[:300]
    with pytest.raises(A.BadArchive, match="name"):
        list(A.members(io.BytesIO(cut), name="name"))
    with pytest.raises(A.BadArchive):
        list(A.members(io.BytesIO(b"no archive"), name="x"))


def test_a_store_that_only_spark_reads(spark, tmp_path):
    """A path whose scheme Arrow does not know goes through Spark's own reader."""
    tar(tmp_path / "s.tar.gz", [("a/b.md", b"x")])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.shelf.link./in", f"file://{tmp_path}")
    assert [r.text for r in A.archive_files(spark, "viewfs://shelf/in/s.tar.gz").collect()] == ["x"]
