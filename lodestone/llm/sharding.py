"""Sharding by histogram sort, in DataFrame functions only.

Documents are ordered by a 64-bit hash of (doc_id, size, CRC), which spreads them
evenly and lets no equal text or source pile up; rows equal in all three are
told apart by a copy number that the hash takes in as well. Shard borders are
found without sorting: each round counts the exact bytes between candidate keys
over all partitions (one map-side-combined aggregation of at most a few hundred
numbers), keeps for each border the bracket that must hold it, and puts new
probes in it, until the bytes below a probe are within ``tolerance`` of the
border's target or a single row (or a single key) is left between them; a
bracket gets smaller by seven eighths or more each round, so that ends. Then the rows are exchanged once, by fine key ranges that nest
in the shards; their order in a range and the prefix sums of the ranges' counts
give the slots.

Cases: a null text has size 1; a null doc_id is a key like any other; repeated
rows get slots of their own, however many there are; rows with equal keys are in
the order of doc_id, size, CRC and copy; one text larger than a shard stays
whole, and so does its shard; only sizes and CRCs of very long texts are moved;
an empty table gives no rows; further columns are ignored by ``assign`` and kept
by ``shard_texts``, but for one named ``shard``, whose place the new one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodestone.session import stored

SHARDS = 16
TOLERANCE = 0.001
PROBES = 16
#: Equal rows beyond this number are numbered in blocks of it, spread over tasks.
COPIES = 4_096
#: Rows of about this number share a key range, which is sorted in one task.
RANGE_ROWS = 200_000
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, CRC and key of every row, repeated rows with copy numbers in their keys."""
    text = F.col("text").cast("string")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    counted = narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    few = counted.where(F.col("copies") <= COPIES).withColumn("first", F.lit(1).cast("long")).withColumn("last", F.col("copies"))
    blocks = counted.where(F.col("copies") > COPIES).withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), F.lit(COPIES).cast("long"))))
    many = blocks.withColumn("last", F.least("copies", F.col("first") + (COPIES - 1))).repartition("doc_id", "size", "text_crc32", "first")
    one = few.unionByName(many).withColumn("copy", F.explode(F.sequence("first", "last")))
    return one.select("doc_id", "size", "text_crc32", "copy", F.xxhash64("doc_id", "size", "text_crc32", "copy").alias("key"))


def _below(rows: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """The exact bytes and the number of rows with a key below each probe; probes ascend."""
    slot = _slot(F.col("key"), probes)
    got = {r[0]: (r[1], r[2]) for r in rows.groupBy(slot.alias("slot")).agg(F.sum("size"), F.count(F.lit(1))).collect()}
    out, total, n = [], 0, 0
    for i in range(len(probes)):
        size, count = got.get(i, (0, 0))
        total, n = total + size, n + count
        out.append((total, n))
    return out


def _slot(key: Column, borders: list[int]) -> Column:
    """How many of the ascending borders are at or below a key."""
    ends = F.array(*[F.lit(b).cast("long") for b in borders])
    # array_position of the first border above the key, by bisection over a literal array
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, (len(borders)).bit_length()))), F.struct(F.lit(0).alias("a"), F.lit(len(borders)).alias("b")), lambda s, _: _half(s, ends, key), lambda s: s["a"])


def _half(s: Column, ends: Column, key: Column) -> Column:
    mid = ((s["a"] + s["b"]) / 2).cast("int")
    over = F.get(ends, mid) > key
    done = s["a"] >= s["b"]
    return F.struct(F.when(done | over, s["a"]).otherwise(mid + 1).alias("a"), F.when(~done & over, mid).otherwise(s["b"]).alias("b"))


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[int]:
    """The keys at which the shards begin, but for the first."""
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    targets = [total * i // shards for i in range(1, shards)]
    slack = max(1, int(total / shards * tolerance))
    low = [(_LOW, 0, 0)] * len(targets)
    high = [(_HIGH, total, n_rows)] * len(targets)
    found: list[int | None] = [None] * len(targets)
    while total:
        open_ = [i for i, f in enumerate(found) if f is None]
        if not open_:
            break
        probes: set[int] = set()
        for i in open_:
            (a, x, _), (b, y, _) = low[i], high[i]
            # keys are hashes, so the border is near the interpolated place: half the probes go around it
            near = a + (b - a) * (targets[i] - x) // max(1, y - x)
            width = max(1, (b - a) // (PROBES * PROBES))
            probes |= {min(b, max(a, near + width * k)) for k in range(-PROBES // 4, PROBES // 4 + 1)}
            probes |= {a + (b - a) * k // (PROBES // 2) for k in range(1, PROBES // 2)}
        ordered = sorted(probes)
        counts = _below(rows, ordered)
        for i in open_:
            for key, (n, k) in zip(ordered, counts):
                if n <= targets[i] and key > low[i][0]:
                    low[i] = (key, n, k)
                if n >= targets[i] and key < high[i][0]:
                    high[i] = (key, n, k)
            best = min((low[i], high[i]), key=lambda e: abs(e[1] - targets[i]))
            # one row, or rows of one key, between the two cannot be split, so the nearer end is the border
            if abs(best[1] - targets[i]) <= slack or high[i][2] - low[i][2] <= 1 or high[i][0] - low[i][0] <= 1:
                found[i] = best[0]
    return sorted(_HIGH if f is None else f for f in found)


def assign(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """One row a document: its size, CRC, shard and gapless slot in the shard."""
    rows = stored(keyed(docs), "shard-keys")
    borders = splitters(rows, shards, tolerance)
    n = rows.count()
    # key ranges: the shards, each cut evenly in key space; hashes fill them evenly
    fine = max(1, min(4096, -(-n // (RANGE_ROWS * shards))))
    edges = [_LOW, *borders, _HIGH]
    ranges = sorted({a + (b - a) * k // fine for a, b in zip(edges, edges[1:]) for k in range(fine)} - {_LOW})
    placed = rows.withColumn("range", _slot(F.col("key"), ranges)).withColumn("shard", _slot(F.col("key"), borders))
    counts = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as ranges: at most 4096 a shard
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("range").orderBy("key", "doc_id", "size", "text_crc32", "copy")
    out = placed.withColumn("n", F.row_number().over(order)).join(F.broadcast(before), "range")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_texts(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The documents with all their columns and a column ``shard``, exchanged once by it: partition i holds shard i.

    Equal rows are dealt over the keys of their copies by a hash of their place
    in the input, so a row repeated very often is spread as the borders count it.
    """
    rows = stored(keyed(docs), "shard-keys")
    borders = splitters(rows, shards, tolerance)
    text = F.col("text").cast("string")
    own = [F.col("doc_id").cast("long").alias("i"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("z"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("c")]
    names = [c for c in docs.columns if c.lower() != "shard"]
    keyed_ = docs.select(*own, F.monotonically_increasing_id().alias("at"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    twice = rows.groupBy(F.col("doc_id").alias("i2"), F.col("size").alias("z2"), F.col("text_crc32").alias("c2")).agg(F.max("copy").alias("copies")).where("copies > 1")
    same = F.col("i").eqNullSafe(F.col("i2")) & (F.col("z") == F.col("z2")) & (F.col("c") == F.col("c2"))
    dealt = keyed_.join(twice, same, "left").withColumn("copy", F.when(F.col("copies") > 1, F.pmod(F.xxhash64("at"), "copies") + 1).otherwise(F.lit(1)).cast("long"))
    placed = dealt.select(_slot(F.xxhash64("i", "z", "c", "copy"), borders).cast("int").alias("shard"), "row")
    return placed.repartitionById(shards, F.col("shard")).select("row.*", "shard")
