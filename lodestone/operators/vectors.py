"""A store of vectors as a log: an immutable base, deltas of later rows, and one manifest that says what counts.

A put writes its own rows, sorted by id, as a new delta, and then a manifest that
names it; what is there is not touched. A manifest is a small file with the next
number, put in place by one rename that fails if the number is taken, so that
readers see the store before a put or after it and never between, a writer that
dies leaves only files that nobody names, and of two writers one tries again with
what the other wrote. Reading merges: of an id the newest delta's row holds, else
the base's. Compaction writes a new base of all that is merged; ``vacuum`` deletes
what the last manifest does not name.

Cases: a store without a manifest has no model and holds nothing; a change of
model or width starts an empty store; of new rows with one id the last by ``seq``
holds; rows of another width are an error, and nothing is written; a null id is
an id like others.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import keyed
from lodestone.operators.retrieval import DimensionMismatch
from lodestone.session import forget, stored

#: Deltas from which a put compacts; so a read merges no more than this.
MOST_DELTAS = 8
#: A put also compacts where its deltas together have more than this share of the base's rows.
SHARE = 0.5
_TRIES = 20


@dataclass(frozen=True)
class Manifest:
    """What counts: the model and width, the base and the deltas, oldest first, and their rows."""

    model: str
    dim: int
    base: str | None = None
    deltas: list[str] = field(default_factory=list)
    rows: dict[str, int] = field(default_factory=dict)


class Busy(RuntimeError):
    """Other writers took every number that was tried."""


class NoModel(ValueError):
    """A put into a store that was not initialised."""


class _Files:
    """The manifests of a store, on whatever file system Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(conf)
        self.root = self.fs.makeQualified(self.root)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), conf)
        self.folder = self.at("versions")
        once = spark._sc._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        once[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE  # never over what is there
        self.once = once

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self, folder) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []

    def last(self) -> int:
        return max((int(n[:-5]) for n in self.names(self.folder) if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def load(self, version: int) -> Manifest:
        stream = self.fs.open(self.at(f"versions/{version:020d}.json"))
        try:
            return Manifest(**json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def commit(self, version: int, manifest: Manifest) -> bool:
        """Put a manifest in place under a number; False if it is taken."""
        made = self.at(f"versions/_{uuid.uuid4().hex}")
        stream = self.fs.create(made, True)
        stream.write(json.dumps(asdict(manifest)).encode())
        stream.close()
        try:
            self.context.rename(made, self.at(f"versions/{version:020d}.json"), self.once)
            return True
        except Exception as e:
            self.fs.delete(made, False)
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise


def _changed(files: _Files, change) -> Manifest:
    """Commit what ``change`` makes of the newest manifest; tried again on what another writer put in between."""
    for _ in range(_TRIES):
        last = files.last()
        manifest = change(files.load(last) if last else None)
        if files.commit(last + 1, manifest):
            return manifest
    raise Busy(str(files.root))


def manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The newest manifest; None if there is none."""
    files = _Files(spark, path)
    last = files.last()
    return files.load(last) if last else None


def meta(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """(model, width) of the stored vectors, or None if there are none."""
    held = manifest(spark, path)
    return (held.model, held.dim) if held else None


def init_vectors(spark: SparkSession, path: str, model: str, dim: int) -> None:
    """Keep stored vectors of the same model and width; drop those of others."""
    if meta(spark, path) != (model, dim):
        _changed(_Files(spark, path), lambda held: held if held and (held.model, held.dim) == (model, dim) else Manifest(model, dim))


def _write(df: DataFrame, path: str) -> tuple[str, int]:
    """Write rows (doc_id, embedding) as a table of their own; its name and number of rows."""
    name = uuid.uuid4().hex
    rows = keyed.write(df.select("doc_id", F.col("embedding").cast("array<float>").alias("embedding")), f"{path}/data/{name}", _parts(df.sparkSession, df))
    return name, rows.count()


def _parts(spark: SparkSession, df: DataFrame) -> int:
    return keyed.parts_for(spark, keyed.measured(df))


def put_vectors(new: DataFrame, path: str) -> Manifest:
    """Upsert rows (doc_id, embedding, seq): only they are written. The manifest that holds them."""
    spark = new.sparkSession
    held = meta(spark, path)
    if held is None:
        raise NoModel("the store has no model yet")
    once = stored(new.select("doc_id", "embedding", "seq"), "new-vectors")
    if not once.where(F.coalesce(F.size("embedding"), F.lit(-1)) != held[1]).isEmpty():
        forget(once)
        raise DimensionMismatch(f"a vector does not have {held[1]} numbers")
    last = once.groupBy("doc_id").agg(F.max_by("embedding", "seq").alias("embedding"))
    name, n = _write(last, path)
    forget(once)

    def add(now: Manifest | None) -> Manifest:
        if now is None or (now.model, now.dim) != held:
            raise DimensionMismatch("the store's model was changed while rows were written")
        return replace(now, deltas=[*now.deltas, name], rows=now.rows | {name: n})

    now = _changed(_Files(spark, path), add)
    late = sum(now.rows[d] for d in now.deltas)
    if now.base is None or len(now.deltas) >= MOST_DELTAS or late > SHARE * now.rows[now.base]:
        return compact(spark, path)
    return now


def compact(spark: SparkSession, path: str) -> Manifest:
    """Write a new base of all that counts; deltas that come meanwhile stay deltas."""
    seen = manifest(spark, path)
    if seen is None or not seen.deltas:
        return seen
    if seen.base is None and len(seen.deltas) == 1:
        base, n = seen.deltas[0], seen.rows[seen.deltas[0]]  # one delta is a base as it is
    else:
        base, n = _write(_merged(spark, path, seen), path)

    def swap(now: Manifest | None) -> Manifest:
        if now is None or now.base != seen.base or now.deltas[: len(seen.deltas)] != seen.deltas:
            raise Busy("the store was compacted or cleared meanwhile")
        left = now.deltas[len(seen.deltas) :]
        return replace(now, base=base, deltas=left, rows={base: n} | {d: now.rows[d] for d in left})

    return _changed(_Files(spark, path), swap)


def _merged(spark: SparkSession, path: str, held: Manifest, ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, embedding) of a manifest: newest deltas over older ones over the base; of some ids only, if given."""
    part = lambda name: (keyed.read(spark, f"{path}/data/{name}") if ids is None else keyed.lookup(spark, f"{path}/data/{name}", ids)).select("doc_id", "embedding")
    if not held.deltas:
        return part(held.base) if held.base else spark.createDataFrame([], "doc_id string, embedding array<float>")
    late = part(held.deltas[0]).withColumn("at", F.lit(0))
    for k, name in enumerate(held.deltas[1:], 1):
        late = late.unionByName(part(name).withColumn("at", F.lit(k)))
    late = late.groupBy("doc_id").agg(F.max_by("embedding", "at").alias("embedding")) if len(held.deltas) > 1 else late.drop("at")
    if not held.base:
        return late
    # Catalyst broadcasts the deltas' ids where they are few by its own measure
    base, gone = part(held.base), late.select(F.col("doc_id").alias("late"))
    return base.join(gone, F.col("doc_id").eqNullSafe(F.col("late")), "left_anti").unionByName(late)


def open_vectors(spark: SparkSession, path: str, model: str, dim: int, ids: DataFrame | None = None) -> DataFrame | None:
    """The stored vectors, of some ids only if given; None if there is no store, an error if it is of another model or width."""
    held = manifest(spark, path)
    if held is None:
        return None
    if (held.model, held.dim) != (model, dim):
        raise DimensionMismatch(f"stored vectors are of {held.model} with {held.dim} numbers, asked for {model} with {dim}")
    return _merged(spark, path, held, ids)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete tables and manifests that the newest manifest does not name; how many. Not while others read or write."""
    files = _Files(spark, path)
    last = files.last()
    if not last:
        return 0
    held = files.load(last)
    gone = [files.at(f"data/{n}") for n in files.names(files.at("data")) if n not in {held.base, *held.deltas}]
    gone += [files.at(f"versions/{n}") for n in files.names(files.folder) if n != f"{last:020d}.json"]
    for path_ in gone:
        files.fs.delete(path_, True)
    return len(gone)


def size(vectors: DataFrame) -> DataFrame:
    """What a vector store holds: the number of vectors, their width and whether there are none."""
    return vectors.agg(F.count(F.lit(1)).alias("vectors"), F.min(F.size("embedding")).cast("long").alias("dim"), (F.count(F.lit(1)) == 0).alias("is_empty"))
