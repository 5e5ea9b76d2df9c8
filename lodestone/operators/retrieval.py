"""Sparse, dense and hybrid retrieval over DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.constants import BACKFILL, BM25_B, BM25_K1, GROUNDED_COSINE, OVERFETCH, QUERY_SYNTAX, RRF_K
from lodestone.functions.score import cosine
from lodestone.functions.text import tokens
from lodestone.session import scratch, stored

_WORD = re.compile(r"[^\W_]+")


class DimensionMismatch(ValueError):
    """A query vector that does not fit the stored ones."""


def parse_query(q: str) -> list[tuple[str, ...]]:
    """The terms of a query, each a phrase of tokens."""
    plain = q.translate({ord(c): " " for c in QUERY_SYNTAX})
    return [t for t in (tuple(_WORD.findall(x.lower())) for x in plain.split()) if t]


def _count(words: Column, phrase: tuple[str, ...]) -> Column:
    """How often a phrase occurs in a token array, its tokens side by side; occurrences may overlap."""

    def here(w: Column, i: Column) -> Column:
        found = w == phrase[0]
        for k, x in enumerate(phrase[1:], 1):
            found = found & (F.get(words, i + k) == x)
        return F.coalesce(found, F.lit(False))

    return F.size(F.filter(words, here))


def bm25(docs: DataFrame, queries: dict[str, str], k: int, fields: tuple[str, ...] = ("text", "title")) -> DataFrame:
    """The k best documents of each query: (query_id, rank, doc_id, score).

    A query's terms are known when the plan is made, so a document's counts are
    taken where it is scanned and written as numbers, and nothing is exploded or
    shuffled but one row of corpus sums and the k best of each partition. Every match is scored before
    the cut, and ties go by doc_id. A phrase has the sum of its tokens' weights.
    """
    parsed = {q: parse_query(text) for q, text in queries.items()}
    phrases = sorted({t for terms in parsed.values() for t in terms} | {(w,) for terms in parsed.values() for t in terms for w in t})
    spark = docs.sparkSession
    if not phrases or k <= 0:
        return spark.createDataFrame([], "query_id string, rank int, doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    counted = docs.select("doc_id", *[tokens(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in fields])
    counted = counted.select("doc_id", *[F.size(f).alias(f"len_{f}") for f in fields], *[_count(F.col(f), p).alias(f"{f}_{i}") for f in fields for i, p in enumerate(phrases)])
    # written, so that the texts are taken apart once: a condition on counts would be moved to the scan, and make its tokens anew for each
    counted = stored(counted, "counts")
    index = {p: i for i, p in enumerate(phrases)}
    sums = counted.agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.avg(f"len_{f}").alias(f"avg_{f}") for f in fields],
        *[F.sum((F.col(f"{f}_{i}") > 0).cast("long")).alias(f"df_{f}_{i}") for f in fields for p, i in index.items() if len(p) == 1],
    )
    hits = counted.where(F.greatest(*[F.col(f"{f}_{i}") for f in fields for i in index.values()], F.lit(0)) > 0)
    both = hits.crossJoin(F.broadcast(sums))  # the sums are one row

    def term(f: str, p: tuple[str, ...]) -> Column:
        tf = F.col(f"{f}_{index[p]}")
        weight = sum((F.log(1 + (F.col("n_docs") - F.col(f"df_{f}_{index[(w,)]}") + 0.5) / (F.col(f"df_{f}_{index[(w,)]}") + 0.5)) for w in p), F.lit(0.0))
        return F.when(tf > 0, weight * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col(f"len_{f}") / F.col(f"avg_{f}")))).otherwise(0.0)

    out = None
    for q, terms in parsed.items():
        if not terms:
            continue
        score = sum((term(f, p) for f in fields for p in terms), F.lit(0.0))
        found = both.select(F.lit(q).alias("query_id"), "doc_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)
        found = found.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def check_dimension(vectors: DataFrame, width: int) -> None:
    """Raise unless stored vectors are as wide as the query; no vectors fit any query."""
    bad = vectors.select(F.size("embedding").alias("w")).where(F.col("w") != width).limit(1).collect()
    if bad:
        raise DimensionMismatch(f"stored vectors have {bad[0].w} numbers, the query has {width}")


#: Numbers of the query vectors that are sent to all tasks at once, some 32 MB; more queries stay a table.
MOST_NUMBERS = 4_000_000


def knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors of each query (query_id, embedding), by exact cosine, ties by id.

    Queries of at most ``MOST_NUMBERS`` numbers are sent to all tasks, and a task
    scores its vectors by one matrix product a batch and keeps the k best of each
    query, so rows that are exchanged follow tasks and queries, not pairs. More
    queries stay a table and meet the vectors in blocks about pivots.
    """
    held = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q"))
    numbers = held.agg(F.sum(F.coalesce(F.size("q"), F.lit(0))).alias("n")).first().n or 0
    if numbers > MOST_NUMBERS:
        from lodestone.operators import pivots

        path = scratch(vectors.sparkSession, "pivots")
        pivots.build(vectors, path)
        return pivots.search(vectors.sparkSession, path, queries, k)
    kinds = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("doc_id", vectors.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    rows = held.collect()
    out = vectors.select("doc_id", F.col("embedding").cast("array<double>").alias("v")).mapInArrow(_nearest_in([r.query_id for r in rows], [r.q for r in rows], k), kinds)
    order = [F.desc("score"), F.col("doc_id")]
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _nearest_in(ids: list, vectors: list, k: int):
    """A task's k best of each query: scores by matrix product for vectors of one width, zero for other widths and empty norms."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        by: dict[int, tuple] = {}
        for w in {len(v or []) for v in vectors}:
            place = [i for i, v in enumerate(vectors) if len(v or []) == w]
            by[w] = (np.array(place), np.array([vectors[i] or [] for i in place], float).reshape(len(place), w))
        kept: list[list[tuple]] = [[] for _ in ids]
        for b in batches:
            keys, held = b.column(0), b.column(1)
            sizes = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            scores = np.zeros((len(sizes), len(ids)))
            for w, (place, q) in by.items():
                rows = np.flatnonzero(sizes == w)
                if w and len(rows):
                    m = held.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, w)
                    norm = np.sqrt((m * m).sum(axis=1))[:, None] * np.sqrt((q * q).sum(axis=1))[None, :]
                    scores[np.ix_(rows, place)] = np.divide(m @ q.T, norm, out=np.zeros_like(norm), where=norm > 0)
            names = keys.to_pylist()
            for j, best in enumerate(kept):
                s = scores[:, j]
                floor = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
                best += [(-s[i], names[i]) for i in np.flatnonzero(s >= floor)]
                best.sort()
                del best[k:]
        rows = [(ids[j], name, -s) for j, best in enumerate(kept) for s, name in best]
        cols = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.float64())], names=["query_id", "doc_id", "score"]) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema([]))

    def full(batches):
        for b in run(batches):
            if b.num_rows:
                yield b

    return full


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k nearest vectors of one query (doc_id, score)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("doc_id", cosine(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def scores_for(vectors: DataFrame, query: list[float], ids: DataFrame) -> DataFrame:
    """Cosines of the named vectors; unknown ids are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.join(ids.select("doc_id").distinct(), "doc_id").select("doc_id", cosine(F.col("embedding"), q).alias("score"))


def scores_pairs(vectors: DataFrame, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cosines of some (query_id, doc_id); unknown ids are left out."""
    held = vectors.withColumn("doc_id", F.col("doc_id").cast("string")).join(pairs.select("query_id", "doc_id").distinct(), "doc_id")
    return held.join(queries.select("query_id", F.col("embedding").alias("q")), "query_id").select("query_id", "doc_id", cosine(F.col("embedding"), F.col("q")).alias("score"))


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rows (query_id, list_id, rank, doc_id); an id twice in a list counts twice."""
    return lists.groupBy("query_id", "doc_id").agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("rrf"))


def hybrid(docs: DataFrame, vectors: DataFrame | None, query: str, embedding: list[float] | None, top_k: int, sparse: Callable[[dict[str, str], int], DataFrame] | None = None, exists: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Fused hits: (rank, doc_id, rrf, dense, bm25).

    Each leg fetches four times what is asked for; the first two times as many
    fused ids get their cosine if the dense leg ran, even where it did not find
    them. A null says that a leg did not return a document, or did not run.
    ``sparse`` searches an index (queries, k), and ``exists`` says which of some ids
    it has; without one the texts, and all ids, are scanned.
    The legs' rows, a few times top_k, are written once and not computed again.
    """
    if top_k > 0 and vectors is not None and embedding is not None:
        check_dimension(vectors, len(embedding))
    n = max(0, top_k)
    found = sparse({"q": query}, OVERFETCH * n) if sparse else bm25(docs, {"q": query}, OVERFETCH * n)
    sparse_hits = stored(found.select("rank", "doc_id", "score"), "sparse-leg")
    ran = vectors is not None and embedding is not None
    lists = sparse_hits.select(F.lit("q").alias("query_id"), "rank", "doc_id")
    if ran:
        near = nearest(vectors, embedding, OVERFETCH * n).withColumn("one", F.lit("q"))
        dense = stored(near.withColumn("rank", F.row_number().over(Window.partitionBy("one").orderBy(F.desc("score"), "doc_id"))).select("doc_id", "score", "rank"), "dense-leg")
        lists = lists.unionByName(dense.select(F.lit("q").alias("query_id"), "rank", "doc_id"))
    fused = rrf(lists).orderBy(F.desc("rrf"), "doc_id").select("doc_id", "rrf")
    kept = fused.limit(OVERFETCH * 2 * n)  # never more than both legs hold
    first = fused.limit(BACKFILL * n)
    asked = kept.select("doc_id")  # at most 8 * top_k ids
    there = exists(asked) if exists else docs.join(F.broadcast(asked), "doc_id", "left_semi").select("doc_id").distinct()
    hits = kept.join(F.broadcast(there), "doc_id").join(sparse_hits.select("doc_id", F.col("score").alias("bm25")), "doc_id", "left")
    if ran:
        backfill = scores_for(vectors, embedding, first).unionByName(dense.select("doc_id", "score")).distinct()
        hits = hits.join(backfill.withColumnRenamed("score", "dense"), "doc_id", "left")
    else:
        hits = hits.withColumn("dense", F.lit(None).cast("double"))
    top = hits.orderBy(F.desc("rrf"), "doc_id").limit(n)
    return top.select(F.row_number().over(Window.partitionBy(F.lit("q")).orderBy(F.desc("rrf"), "doc_id")).alias("rank"), "doc_id", "rrf", "dense", "bm25")


def grounded(hits: DataFrame) -> DataFrame:
    """(query_id, grounded): by cosine if any hit has one, else by any sparse score; never by rank."""
    dense = F.bool_or(F.coalesce(F.col("dense") >= GROUNDED_COSINE, F.lit(False)))
    sparse = F.bool_or(F.coalesce(F.col("bm25") > 0, F.lit(False)))
    return hits.groupBy("query_id").agg(F.coalesce(F.when(F.bool_or(F.col("dense").isNotNull()), dense).otherwise(sparse), F.lit(False)).alias("grounded"))


def corpus_hash(docs: DataFrame) -> DataFrame:
    """One hash of all documents that does not depend on their order.

    The hash of a tree: documents fall in 65,536 buckets by the hash of their id,
    and a bucket's hash is that of its sorted lines, so that no task holds more
    than a bucket; buckets are joined to 256 and those to one.
    """
    own = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)
    line = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2(F.col("text").cast("binary"), 256), F.lit("\n"))
    level = docs.select(F.substring(own, 1, 4).alias("b"), line.alias("line"), F.lit(1).cast("long").alias("n"))
    for width in (2, 0, -1):
        held = level.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "").cast("binary"), 256).alias("h"), F.sum("n").alias("n"))
        if width >= 0:
            level = held.select(F.substring("b", 1, width).alias("b"), F.concat("b", F.lit(":"), "h", F.lit("\n")).alias("line"), "n")
    return held.select(F.col("h").alias("corpus_hash"), F.col("n").alias("documents"))


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Old rows, those of a new key replaced; of new rows with one key the one with the last ``seq`` holds."""
    order = Window.partitionBy(key).orderBy(F.desc("seq"))
    last = new.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "seq")
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def hash_embed(words: Column, width: int = 8) -> Column:
    """A deterministic vector of a token array: counts of its words by bucket, for tests without a model."""
    buckets = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(width)))
    # the buckets are bound as a variable, so that words are hashed once and not once a bucket
    counted = lambda held: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(held, lambda b: b == i)).cast("float"))
    return F.get(F.transform(F.array(buckets), counted), F.lit(0))
