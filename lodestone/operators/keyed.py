"""Tables laid out by key: parts that hold ranges of it, sorted, and a small table of where each part begins and ends.

A few rows are looked up by their ids: the fences say which parts can hold them,
only those parts are listed and read, and within a part the sorted row groups and
pages are skipped by their least and greatest id. Many ids are joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a part, about.
PART_BYTES = 64 << 20
#: Ids that are looked up by fences; more of them are joined with the whole table.
MOST_IDS = 1_000
PART = "_part"


def parts_for(spark: SparkSession, size: int, part_bytes: int = PART_BYTES) -> int:
    """How many parts bytes take: they follow the data, and there is one for each shuffle partition at least."""
    return max(-(-size // part_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))


def measured(df: DataFrame) -> int:
    """The bytes of a table's strings and lists, about; a pass over a table that is written."""
    sizes = [F.octet_length(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType) else F.size(F.col(f"`{f.name}`")) * 8 if isinstance(f.dataType, T.ArrayType) else F.lit(8) for f in df.schema.fields]
    total = df.agg(F.sum(sum((F.coalesce(s, F.lit(0)).cast("long") for s in sizes), F.lit(0)))).first()[0]
    return int(total or 0)


def write(df: DataFrame, path: str, parts: int, key: str = "doc_id", also: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Write rows by ranges of their key; ``also`` may add columns to the sorted partitions. The rows as they are read back."""
    spark = df.sparkSession
    placed = also(df.repartitionByRange(parts, key).sortWithinPartitions(key)).withColumn(PART, F.spark_partition_id())
    placed.write.mode("overwrite").partitionBy(PART).parquet(f"{path}/rows")
    # rows may be none, and then no file says what they are
    spark.createDataFrame([], placed.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
    rows = read(spark, path)
    fences = rows.groupBy(PART).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n"))
    fences.write.mode("overwrite").parquet(f"{path}/fences")
    return rows


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows, the part they are in as a last column."""
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")


def lookup(spark: SparkSession, path: str, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of some ids (a column of the key's name); unknown ids have none."""
    wanted = ids.select(key).distinct()
    few = wanted.limit(MOST_IDS + 1).collect()
    rows = read(spark, path)
    if len(few) > MOST_IDS:
        return rows.join(wanted, key, "left_semi")
    values = [r[0] for r in few if r[0] is not None]
    inside = F.exists(F.array(*map(F.lit, values)), lambda x: (x >= F.col("low")) & (x <= F.col("high"))) if values else F.lit(False)
    parts = [r[0] for r in spark.read.parquet(f"{path}/fences").where(inside).select(PART).collect()]  # a part or two an id
    return rows.where(F.col(PART).isin(parts) & F.col(key).isin(values)) if parts else rows.where(F.lit(False))
