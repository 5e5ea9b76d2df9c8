"""Session helpers: table access, package shipping and shared scratch space."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read through Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    On a cluster whose executors do not share that folder, submit the package
    with ``--py-files``; the path set here is then simply not used.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)
    return spark


class NoSharedFolder(RuntimeError):
    """A cluster without a folder that driver and executors share."""


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as a URI.

    The one in spark.checkpoint.dir, else the one set by setCheckpointDir; a path
    without a scheme lies on the default file system, as it does for Spark. One
    of our own is made only where neither is set and driver and executors are one
    process; on a cluster that is an error, as executors would not see it.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        held = sc._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not sc.master.startswith("local"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        sc.setCheckpointDir(root)
        root = sc._jsc.sc().getCheckpointDir().get()
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


#: Schemes that Arrow opens, and its names for them.
_SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


class UnknownStore(ValueError):
    """A URI that Python code in tasks cannot open."""


def arrow_store(uri: str):
    """(file system, path) for Python code in tasks, of a URI as Spark writes it; dbfs is the folder that machines mount."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":") if ":" in uri.split("/")[0] else ("file", "", uri)
    if scheme in ("file", "dbfs"):
        return fs.LocalFileSystem(), ("/dbfs" if scheme == "dbfs" else "") + "/" + rest.lstrip("/")
    if scheme not in _SCHEMES:
        raise UnknownStore(uri)
    return fs.FileSystem.from_uri(f"{_SCHEMES[scheme]}:{rest}")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder name (a URI) below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/lodestone/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with the lineage cut at a reliable checkpoint."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The same rows, written once as Parquet in the shared scratch space and read back."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    _written(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _written(spark: SparkSession) -> list[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_lodestone_written"):
        sc._lodestone_written = []
    return sc._lodestone_written


def mark(spark: SparkSession) -> int:
    """A point in the list of tables written so far, for ``release``."""
    return len(_written(spark))


def release(spark: SparkSession, since: int, keep: DataFrame | None = None) -> int:
    """Delete the tables written since a mark, but for those that ``keep`` reads; how many they were.

    For whoever runs stages one after another and knows that no frame still reads
    the tables of those that are done.
    """
    held = _written(spark)
    kept = set() if keep is None else _tables(keep)
    gone = [p for p in held[since:] if p not in kept]
    _delete(spark, gone)
    return len(gone)


def forget(*frames: DataFrame) -> None:
    """Delete the tables that these frames read from the scratch space; what was made of them has been written."""
    for df in frames:
        _delete(df.sparkSession, list(_tables(df)))


def _tables(df: DataFrame) -> set[str]:
    """The tables written here that a frame reads."""
    plain = lambda uri: re.sub("^file:/+", "file:/", uri)
    read = {plain(f).rpartition("/")[0] for f in df.inputFiles()}
    return {p for p in _written(df.sparkSession) if plain(p) in read}


def _delete(spark: SparkSession, paths: list[str]) -> None:
    sc, held = spark.sparkContext, _written(spark)
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        held.remove(p)
