"""Exact nearest vectors by pivots: most of the vectors are ruled out by the triangle inequality and never scored.

Angles between vectors are a metric. Each vector belongs to the pivot at the
least angle, and lies in a block with others of its pivot at about the same angle
(a shell). If a query is at angle t to a pivot and a shell reaches from low to
high, no vector of the shell is nearer to the query than the gap between t and
[low, high]; so the cosine of that gap bounds the shell's scores. For each query
the shells around it that hold k vectors are scored first; only pivots and then
shells whose bound reaches the k-th best score are scored after that. Nothing
else can be among the k best, so the result is that of a full scan.

Pivots are the means of a few rounds of clustering on a sample of ``SAMPLE``
vectors at most, chosen by the hash of their ids; they decide how much is ruled
out and never what is found. All vectors are indexed. A pivot with a third of
all vectors has as many blocks as others together, in as many tasks. Queries are
a table; a block meets them in groups of about ``GROUP``, by one matrix product.

Cases: vectors and queries of norm zero, of another width or null score 0 with
everything, as does a query of such; ties go by id; fewer than k vectors give as
many; repeated ids are rows of their own; no vectors or no queries give no rows.
Scores are rounded to 12 digits, so that equal vectors tie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import keyed
from lodestone.session import forget, ship, stored

#: Vectors that pivots are made from, pivots, vectors of a block, and queries that meet a block at once.
SAMPLE, MOST_PIVOTS, BLOCK, GROUP = 8_192, 1_024, 256, 256
#: Heads of blocks that are broadcast at most, at some 50 bytes each.
MOST_HEADS = 200_000
#: What angles may be wrong by, as arc cosines near 1 lose half of the digits.
_SLACK = 1e-7
_ROUNDS = 6


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _angles(units: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centers.T, -1, 1))


def centers_of(sample: np.ndarray, n: int) -> np.ndarray:
    """Unit vectors that are the means of n clusters of a sample, or the sample itself where it is smaller."""
    units = _unit(sample)
    centers = units[np.linspace(0, len(units) - 1, min(n, len(units))).astype(int)]
    for _ in range(_ROUNDS):
        near = (units @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, units)
        norm = np.sqrt((sums * sums).sum(1))
        centers = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], centers)
    return centers


def _rows_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have vectors of this width and a norm, and these as a matrix."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == width) if width else np.zeros(0, np.int64)
    m = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width) if len(rows) else np.zeros((0, max(width, 1)))
    good = np.isfinite(m).all(1) & ((m * m).sum(1) > 0)
    return rows[good], m[good]


def build(vectors: DataFrame, path: str, pivots: int | None = None, block: int = BLOCK) -> None:
    """Write pivots and blocks of rows (doc_id, embedding) below ``path``, in place of what is there."""
    spark = ship(vectors.sparkSession)
    held = stored(vectors.select("doc_id", F.col("embedding").cast("array<double>").alias("v")), "pivot-vectors")
    widest = held.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).where("w > 0").orderBy(F.desc("n"), "w").first()
    width, n = (widest.w, widest.n) if widest else (0, 0)
    drawn = held.where(F.size("v") == width).orderBy(F.xxhash64("doc_id", "v")).limit(SAMPLE).select("v")
    sample = np.array([r.v for r in drawn.collect() if None not in r.v], float).reshape(-1, max(width, 1)) if width else np.zeros((0, 1))
    sample = sample[np.isfinite(sample).all(1) & ((sample * sample).sum(1) > 0)]
    centers = centers_of(sample, pivots or min(MOST_PIVOTS, int(n**0.5) + 1)) if len(sample) else np.zeros((0, max(width, 1)))

    def assign(batches):
        for b in batches:
            rows, m = _rows_of(b.column(1), width)
            pivot, angle = np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
            if len(rows) and len(centers):
                a = _angles(_unit(m), centers)
                pivot[rows], angle[rows] = a.argmin(1), a.min(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pivot), pa.array(angle)], names=["doc_id", "v", "pivot", "angle"])

    id_type = held.schema["doc_id"].dataType
    row = T.StructType([held.schema["doc_id"], held.schema["v"], T.StructField("pivot", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    parts = keyed.parts_for(spark, n * max(width, 1) * 8)
    placed = held.mapInArrow(assign, row).repartitionByRange(parts, "pivot", "angle", "doc_id").sortWithinPartitions("pivot", "angle", "doc_id")

    def gather(batches):
        k = TaskContext.get().partitionId() << 32
        now: list = []

        def out():
            nonlocal k
            pivot, angle, ids, vs = zip(*now)
            made = pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int64()), pa.array([pivot[0]], pa.int32()), pa.array([angle[0]], pa.float64()), pa.array([angle[-1]], pa.float64()), pa.array([len(now)], pa.int32()), pa.array([ids], pa.list_(kind)),
                 pa.array([[] if pivot[0] < 0 else np.concatenate(vs)], pa.list_(pa.float64()))],
                names=["block", "pivot", "low", "high", "n", "ids", "matrix"],
            )
            k += 1
            now.clear()
            return made

        kind = None
        for b in batches:
            kind = b.column(0).type
            for r in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(0).to_pylist(), b.column(1).to_pylist()):
                if now and (len(now) >= block or now[-1][0] != r[0]):
                    yield out()
                now.append(r)
        if now:
            yield out()

    blocks = T.StructType([T.StructField("block", T.LongType()), T.StructField("pivot", T.IntegerType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("matrix", T.ArrayType(T.DoubleType()))])
    placed.mapInArrow(gather, blocks).write.mode("overwrite").parquet(f"{path}/blocks")
    spark.createDataFrame([(width, [float(x) for x in centers.ravel()], len(centers))], "width int, centers array<double>, pivots int").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")
    forget(held)


@dataclass
class Nearest:
    """A search while it runs: which (query, block) pairs were scored, and how many vectors there are."""

    spark: SparkSession
    path: str
    k: int
    queries: DataFrame
    first: DataFrame | None = None
    rest: DataFrame | None = None

    def __post_init__(self):
        row = self.spark.read.parquet(f"{self.path}/pivots").first()
        self.width, self.centers = row.width, np.array(row.centers, float).reshape(row.pivots, max(row.width, 1))
        self.blocks = self.spark.read.parquet(f"{self.path}/blocks")
        self.heads = self.blocks.select("block", "pivot", "low", "high", "n").where("pivot >= 0")
        self.queries = stored(self.queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")), "queries")

    def angles(self) -> DataFrame:
        """(query_id, pivot, t): the angle of each query that has a direction to each pivot."""
        width, centers = self.width, self.centers

        def run(batches):
            for b in batches:
                rows, m = _rows_of(b.column(1), width)
                if len(rows) and len(centers):
                    for at in range(0, len(rows), 512):
                        some = rows[at : at + 512]
                        a = _angles(_unit(m[at : at + 512]), centers)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(some, len(centers)))), pa.array(np.tile(np.arange(len(centers), dtype=np.int32), len(some))), pa.array(a.ravel())], names=["query_id", "pivot", "t"])

        return self.queries.mapInArrow(run, T.StructType([self.queries.schema["query_id"], T.StructField("pivot", T.IntegerType()), T.StructField("t", T.DoubleType())]))

    def scored(self, pairs: DataFrame) -> DataFrame:
        """(query_id, doc_id, score): the k best of each pair (query_id, block)."""
        k, width = self.k, self.width
        groups = max(1, -(-self.queries.count() // GROUP))
        asked = pairs.join(self.queries, "query_id").groupBy("block", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("g")).agg(F.collect_list(F.struct("query_id", "q")).alias("asked"))
        both = asked.select("block", F.col("asked.query_id").alias("names"), F.flatten("asked.q").alias("qs")).join(self.blocks.select("block", "ids", "matrix"), "block").select("names", "qs", "ids", "matrix")

        def run(batches):
            for b in batches:
                for names, qs, ids, m in zip(*b.columns):
                    m, q = (_unit(x.values.to_numpy(zero_copy_only=False).reshape(-1, width)) for x in (m, qs))
                    scores = np.round(m @ q.T, 12)  # equal vectors have equal scores in whatever block
                    least = np.array(ids.values.to_pylist(), object)
                    who, where, what = [], [], []
                    for j in range(scores.shape[1]):
                        s = scores[:, j]
                        top = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                        top = sorted(top.tolist(), key=lambda i: (-s[i], least[i]))[:k]  # noqa: B023
                        who += [j] * len(top)
                        where += top
                        what += s[top].tolist()
                    yield pa.RecordBatch.from_arrays([names.values.take(pa.array(who, pa.int64())), ids.values.take(pa.array(where, pa.int64())), pa.array(what, pa.float64())], names=["query_id", "doc_id", "score"])

        kinds = T.StructType([self.queries.schema["query_id"], T.StructField("doc_id", self.blocks.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType())])
        return both.mapInArrow(run, kinds)

    def unscored(self, angles: DataFrame) -> DataFrame:
        """Zeros: of each query with the least ids that have no direction, and of each query without one with the least ids of all."""
        ids = lambda blocks: F.broadcast(blocks.select(F.explode("ids").alias("doc_id")).orderBy("doc_id").limit(self.k))
        there, zero = angles.select("query_id").distinct(), F.lit(0.0).alias("score")
        # k rows at most are sent to all tasks
        some = self.queries.join(there, "query_id", "left_semi").select("query_id").crossJoin(ids(self.blocks.where("pivot < 0")))
        lost = self.queries.join(there, "query_id", "left_anti").select("query_id").crossJoin(ids(self.blocks))
        return some.unionByName(lost).select("query_id", "doc_id", zero)

    def run(self) -> DataFrame:
        angles = stored(self.angles(), "angles")
        heads = F.broadcast(self.heads) if self.heads.count() <= MOST_HEADS else self.heads
        whole = self.heads.groupBy("pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))  # a row a pivot
        gap = F.greatest(F.col("t") - F.col("high"), F.col("low") - F.col("t"), F.lit(0.0))
        bound = F.cos(F.greatest(gap - _SLACK, F.lit(0.0)))
        before = Window.partitionBy("query_id").orderBy("t", "pivot").rowsBetween(Window.unboundedPreceding, -1)
        near = angles.join(F.broadcast(whole), "pivot").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < self.k).select("query_id", "pivot", "t")
        shells = near.join(heads, "pivot").withColumn("gap", gap)
        inner = Window.partitionBy("query_id").orderBy("gap", "t", "block").rowsBetween(Window.unboundedPreceding, -1)
        self.first = stored(shells.withColumn("before", F.coalesce(F.sum("n").over(inner), F.lit(0))).where(F.col("before") < self.k).select("query_id", "block"), "first-shells")
        found = stored(self.scored(self.first).unionByName(self.unscored(angles)), "first-scores")
        floor = _best(found, self.k).where(F.col("rank") == self.k).select("query_id", F.col("score").alias("floor"))
        reach = angles.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)) - 1e-9)
        wide = reach.join(F.broadcast(whole), "pivot").where(bound >= F.col("floor")).select("query_id", "pivot", "t", "floor")
        open_shells = wide.join(heads, "pivot").where(bound >= F.col("floor")).select("query_id", "block")
        self.rest = stored(open_shells.join(self.first, ["query_id", "block"], "left_anti"), "open-shells")
        return _best(found.unionByName(self.scored(self.rest)), self.k)

    def share(self) -> float:
        """Of all (query, vector) pairs the part whose score was computed, after a run."""
        done = self.first.unionByName(self.rest).join(self.heads.select("block", "n"), "block").agg(F.sum("n")).first()[0] or 0
        return done / max(1, self.queries.count() * (self.blocks.agg(F.sum("n")).first()[0] or 1))


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.col("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    thin = scored.withColumn("r", F.row_number().over(Window.partitionBy("query_id", part).orderBy(*order))).where(F.col("r") <= k)
    return thin.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors of each query (query_id, embedding) by exact cosine: (query_id, rank, doc_id, score), ties by id."""
    return Nearest(ship(spark), path, max(0, k), queries).run()
