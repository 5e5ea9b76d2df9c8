"""Tar archives as a data source: archives are dealt over tasks, and their files stream out one by one.

Archives are listed by Spark, so any path that Spark reads will do, and dealt to
tasks by size: a large one is a task of its own, small ones share one. A task
opens an archive as a stream, decompresses as it goes, and gives its wanted files
in batches of a few MB, so that it holds one file and one batch, whatever the
archive's size. ``members`` is the one place that says which files are wanted.

Cases: a file that is too large for memory is not one to read as a text; files that
are not UTF-8, not regular, of another ending or with an unsafe path are left out;
an archive that is cut short or no archive is an error that names it.
"""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession

from lodestone.session import UnknownStore, arrow_store, ship

KEEP = ("rs", "md")
SCHEMA = "archive string, path string, text string"
#: Bytes of archives that share a task, and of texts in a batch.
TASK_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
_SOURCE = "lodestone_archives"

class BadArchive(ValueError):
    """A file that is not a whole tar archive."""


def wanted(name: str, keep: tuple[str, ...] = KEEP, includes: tuple[str, ...] = ()) -> bool:
    """Whether a member's path is safe, has a known ending and lies, below the top folder, at one of the prefixes."""
    if name.startswith("/") or ".." in name.split("/") or name.rpartition(".")[2] not in keep:
        return False
    below = name.partition("/")[2] or name
    return not includes or any(below.startswith(p.lstrip("/")) for p in includes)


def members(stream: BinaryIO, keep: tuple[str, ...] = KEEP, includes: tuple[str, ...] = (), name: str = "archive") -> Iterator[tuple[str, str]]:
    """(path, text) of the wanted files of a compressed tar stream, in its order; one file is held at a time."""
    try:
        with tarfile.open(fileobj=stream, mode="r|*") as tar:
            for member in tar:
                if member.isfile() and wanted(member.name, keep, includes):
                    try:
                        text = tar.extractfile(member).read().decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    yield member.name, text
                tar.members.clear()  # or the headers of all files that have passed stay
    except (tarfile.TarError, EOFError, OSError) as e:
        raise BadArchive(f"{name}: {e}") from e


def opened(path: str) -> BinaryIO:
    """A stream of an archive's bytes."""
    store, at = arrow_store(path)
    return store.open_input_stream(at, compression=None)


def readable(path: str) -> bool:
    """Whether tasks can open a path themselves."""
    try:
        arrow_store(path)
        return True
    except (UnknownStore, OSError, ValueError):
        return False


def batches(rows: Iterator[tuple[str, str, str]]) -> Iterator:
    """Rows of texts as Arrow batches of a few MB; a larger text is a batch of its own."""
    import pyarrow as pa

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names=["archive", "path", "text"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names=["archive", "path", "text"])


def dealt(files: list[tuple[str, int]], task_bytes: int = TASK_BYTES) -> list[list[str]]:
    """Archives in tasks: the largest first, each to the task that has the least so far while that has room."""
    import heapq

    total = sum(n for _, n in files)
    heap = [(0, i) for i in range(max(1, -(-total // task_bytes)))]
    out: list[list[str]] = [[] for _ in heap]
    for path, n in sorted(files, key=lambda f: (-f[1], f[0])):
        size, i = heapq.heappop(heap)
        if out[i] and size + n > task_bytes:
            heapq.heappush(heap, (size, i))
            i, size = len(out), 0
            out.append([])
        out[i].append(path)
        heapq.heappush(heap, (size + n, i))
    return [x for x in out if x]


def _source() -> type:
    """The data source; made here, so that Spark sends it by value and needs no module to plan a read."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Archives(InputPartition):
        def __init__(self, paths):
            self.paths = paths

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.tasks, self.keep, self.includes = (json.loads(options[k]) for k in ("tasks", "keep", "includes"))

        def partitions(self):
            return [Archives(paths) for paths in self.tasks]

        def read(self, partition):
            from lodestone.sources import archives as A

            def rows():
                for path in partition.paths:
                    with A.opened(path) as stream:
                        for name, text in A.members(stream, tuple(self.keep), tuple(self.includes), path):
                            yield path, name, text

            yield from A.batches(rows())

    class Archive(DataSource):
        @classmethod
        def name(cls):
            return _SOURCE

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader(self.options)

    return Archive


def archive_files(spark: SparkSession, path: str, keep: tuple[str, ...] = KEEP, includes: tuple[str, ...] = ()) -> DataFrame:
    """(archive, path, text) of the wanted files of the archives at a path; an error if paths are asked for and none has a file."""
    ship(spark)
    listed = spark.read.format("binaryFile").load(path)
    found = [(r.path, r.length) for r in listed.select("path", "length").collect()]  # names only, as any listing is the driver's
    if not found or readable(found[0][0]):  # one path, one store
        spark.dataSource.register(_source())
        files = spark.read.format(_SOURCE).options(tasks=json.dumps(dealt(found)), keep=json.dumps(keep), includes=json.dumps(includes)).load() if found else spark.createDataFrame([], SCHEMA)
    else:

        def run(frames):
            yield from batches((p, name, text) for b in frames for p, content in zip(b.column(0).to_pylist(), b.column(1)) for name, text in members(io.BytesIO(content.as_buffer()), keep, includes, p))

        files = listed.select("path", "content").mapInArrow(run, SCHEMA)
    if includes and files.isEmpty():
        raise ValueError(f"{path}: no file matches {', '.join(includes)}; the archive's layout or the paths are not what they were")
    return files
