"""Indexes on disk: blocks of postings for the sparse leg, vectors with a guard of model and width for the dense leg.

A folder of Parquet tables; a build is idempotent, as it replaces what is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.postings import best, build_sparse, existing, lookup, open_sparse, postings, search  # noqa: F401
from lodestone.operators.vectors import init_vectors, meta, open_vectors, put_vectors, size  # noqa: F401
from lodestone.session import stored

def described(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The documents of some ids, one row each; of a repeated id the row with the greatest content."""
    found = lookup(spark, path, ids)
    rest = [c for c in found.columns if c != "doc_id"]
    return found.groupBy("doc_id").agg(F.max(F.struct(*rest)).alias("x")).select("doc_id", "x.*")


def build(docs: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame] | None, model: str = "", dim: int = 0) -> bool:
    """Build the sparse index always and the dense one if embedding works; whether it did."""
    build_sparse(docs, path)
    if embed is None:
        return False
    try:
        vectors = stored(embed(docs), "embedded")
    except ConnectionError:
        return False
    init_vectors(docs.sparkSession, path, model, dim)
    put_vectors(vectors.select(F.col("doc_id").cast("string").alias("doc_id"), "embedding", F.lit(0).alias("seq")), path)
    return True
