"""Embedding of documents in batches, with checks of counts and widths."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.clients.pool import WORKERS, Stop, in_order
from lodestone.clients.transport import HttpProblem, Unavailable
from lodestone.constants import EMBED_BATCH
from lodestone.session import scratch, ship, stored
from lodestone.sources.archives import readable


class BadVectors(ValueError):
    """An embedder that gives another number of vectors than texts, or vectors of several widths or none."""


def embed_documents(docs: DataFrame, embedder: Callable[[], object], batch: int = EMBED_BATCH, workers: int = WORKERS) -> DataFrame:
    """(doc_id, embedding) of documents (doc_id, text); ``embedder`` makes an object with ``embed(texts)`` in each task.

    Calls hold at most ``batch`` texts, and a task has ``workers`` of them under
    way. The vectors are written once, so that the check of their widths over all
    tasks does not ask the embedder again. Once the service is gone, no task asks on.
    """
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    flag = scratch(docs.sparkSession, "embedder-gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = Stop(flag if readable(flag) else None)
        parts = (b.slice(at, batch) for b in batches for at in range(0, b.num_rows, batch))
        for part, vectors, problem in in_order(parts, embedder, lambda e, p: e.embed([t or "" for t in p.column(1).to_pylist()]), stop, workers):
            if problem is not None:
                raise Unavailable(problem) if isinstance(problem, str) else problem
            if len(vectors) != part.num_rows:
                raise BadVectors(f"{len(vectors)} vectors for {part.num_rows} documents")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["doc_id", "embedding"])

    try:
        out = stored(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema), "vectors")
    except Exception as e:  # what a task raises comes back as one of Spark's errors
        said = str(e)
        if "BadVectors" in said:
            raise BadVectors(said.partition("BadVectors: ")[2].split("\n")[0]) from e
        if "transport.Unavailable" in said:
            raise Unavailable(said.partition("transport.Unavailable: ")[2].split("\n")[0]) from e
        if "clients.transport." in said:
            raise HttpProblem(said.rpartition("clients.transport.")[2].split("\n")[0]) from e
        raise
    widths = out.agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    if widths.least is not None and (widths.least != widths.most or widths.least <= 0):
        raise BadVectors("vectors have no width" if widths.most <= 0 else f"vectors have {widths.least} to {widths.most} numbers")
    return out


_WORD = re.compile(r"[^\W_]+")


class HashEmbedder:
    """Vectors by counting hashed words: the same everywhere, for tests without a model."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.width
            for w in _WORD.findall(t.lower()):
                v[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % self.width] += 1.0
            out.append(v)
        return out
