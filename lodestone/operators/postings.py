"""A sparse index of blocks with greatest impacts, and exact top-k search that skips blocks.

Documents are sorted by id and numbered in spans of ``SPAN_DOCS``. A block holds
what one token has in one field and span: documents, field lengths, counts and
places, and at its head how many documents these are and the greatest impact of
any, the part of the score that does not depend on the query. Blocks lie in
folders by a hash of their token, sorted by token and span in each; a frequent
token is spread over files by its spans, and tasks follow bytes. A dictionary has
every token's document frequency, so a search does not count it.

A search reads block heads only at first. For each query and span the heads
bound what a document of the span can score: of a term the weight times the
greatest impact, of a phrase the least of its tokens' (a phrase occurs no more
often than any of its tokens). The spans with the highest bounds are scored from
their blocks; the k-th best score found is a threshold that no span with a lower
bound can pass, so only the others are scored after it. Every document that can
be among the k best is scored in full, and ties go by id.

Cases: null texts are empty; a document without tokens is there and counts in the
statistics; a query without terms, or of unknown tokens, finds nothing; an
empty corpus gives an empty index.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, sqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.constants import BM25_B, BM25_K1
from lodestone.functions.text import query_terms, tokens
from lodestone.operators import keyed
from lodestone.operators.retrieval import parse_query
from lodestone.memory import bounded, returned
from lodestone.session import forget, ship, stored

#: Documents of a span.
SPAN_DOCS = 1_024
#: Spans of the highest bounds that are scored first, for each query.
SEEDS = 8
#: Tokens of documents that a task holds while it makes their blocks, but for one document's own.
MOST_HELD = 1_000_000
#: Distinct tokens of all queries up to which files are chosen by token; terms up to which they are broadcast.
MOST_TOKENS, MOST_BROADCAST = 5_000, 200_000
TERMS = "query_id string, term int, at int, width int, tok string"
_HEAD = ("tok", "field", "span", "n", "impact")


def build_sparse(docs: DataFrame, path: str, fields: tuple[str, ...] = ("text", "title"), span_docs: int = SPAN_DOCS) -> None:
    """Write documents, blocks, the dictionary and the statistics below ``path``, in place of what is there."""
    spark = docs.sparkSession
    bits = span_docs.bit_length() - 1
    lengths = [F.size(tokens(F.coalesce(F.col(f), F.lit("")))).alias(f"_len_{f}") for f in fields]
    once = stored(docs.select("*", *lengths), "documents")  # however costly the documents are, they are made once
    parts = keyed.parts_for(spark, keyed.measured(once))
    spans = lambda d: d.withColumn("_span", F.shiftright(F.monotonically_increasing_id(), bits))
    placed = keyed.write(once, f"{path}/documents", parts, also=spans)
    forget(once)
    buckets = min(1_024, 1 << ceil(sqrt(parts)).bit_length())
    slices = ceil(parts / buckets)
    counted = placed.select("_span", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_len_{f}").alias("len")) for f in fields])).alias("x"))
    stats = counted.groupBy("x.field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("x.len").alias("avg_len"), F.countDistinct("_span").alias("spans"))
    stats.withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")
    stats = spark.read.parquet(f"{path}/statistics")

    means = {r.field: r.avg_len for r in stats.select("field", "avg_len").collect()}  # a row a field
    said = placed.select("doc_id", F.col("_span").alias("span"), *[tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"t{i}") for i, f in enumerate(fields)])
    kind = T.StructType([T.StructField("tok", T.StringType()), T.StructField("field", T.StringType()), T.StructField("span", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("impact", T.DoubleType()),
                         T.StructField("doc_id", T.ArrayType(docs.schema["doc_id"].dataType)), T.StructField("packed", T.ArrayType(T.IntegerType()))])
    bounded(ship(spark))
    made = said.mapInArrow(lambda batches: returned(_inverted(batches, fields, means)), kind)
    dealt = made.withColumn("bucket", _bucket(F.col("tok"), buckets)).withColumn("slice", F.pmod(F.xxhash64("span"), F.lit(slices)))
    dealt = dealt.repartitionById(buckets * slices, (F.col("bucket") * slices + F.col("slice")).cast("int"))  # each its own task, where a hash would put some together
    # the numbers of a block travel as one array, as most tokens are rare and arrays have a head each
    n = F.col("n")
    part = lambda name, begin, size: F.slice("packed", begin + 1, size).alias(name)
    own = [part("len", F.lit(0), n), part("tf", n, n), part("begin", 2 * n, n), part("places", 3 * n, F.size("packed") - 3 * n)]
    blocks = dealt.sortWithinPartitions("bucket", "tok", "field", "span").select("bucket", *[f.name for f in kind if f.name != "packed"], *own)
    blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    words = spark.read.schema(blocks.schema).parquet(f"{path}/blocks").groupBy("bucket", "tok", "field").agg(F.sum("n").cast("long").alias("df"), F.count(F.lit(1)).alias("blocks"), F.max("impact").alias("impact"))
    words.repartition("bucket").sortWithinPartitions("bucket", "tok").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/dictionary")


def _inverted(batches, fields: tuple[str, ...], means: dict[str, float]):
    """Blocks of documents (doc_id, span, tokens of each field) that come by span, where they are read.

    What is held is a span's documents, or ``MOST_HELD`` of its tokens about; a
    span that has more, or that lies in two tasks, gets several blocks of a token,
    each with documents of its own.
    """
    held, size = [], 0
    for b in batches:
        spans = b.column(1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sum(pc.list_value_length(b.column(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(2, b.num_columns)))
        at = 0
        while at < b.num_rows:
            if held and (size >= MOST_HELD or held[0].column(1)[0].as_py() != spans[at]):
                yield from _blocks(held, fields, means)
                held, size = [], 0
            before = ends[at - 1] if at else 0
            same = at + int((spans[at:] == spans[at]).argmin() or len(spans) - at)
            end = min(same, max(at + 1, int(np.searchsorted(ends, before + MOST_HELD - size, "right"))))
            held.append(b.slice(at, end - at))
            size += int(ends[end - 1] - before)
            at = end
    if held:
        yield from _blocks(held, fields, means)


def _blocks(held: list[pa.RecordBatch], fields: tuple[str, ...], means: dict[str, float]):
    """The blocks of some documents of one span, a batch a field: a stable sort by token leaves documents and places in order.

    A block's lengths, counts, where each document's places begin, and all places are one after another in ``packed``.
    """
    rows = pa.Table.from_batches(held).combine_chunks()
    span, whole = rows.column(1)[0].as_py(), lambda c: rows.column(c).chunk(0)
    for k, field in enumerate(fields):
        t = whole(k + 2)
        lengths = pc.list_value_length(t).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not lengths.sum():
            continue
        coded = t.flatten().dictionary_encode()
        tok = coded.indices.to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(tok)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        order = np.argsort(tok, kind="stable")
        tok, doc, place = tok[order], doc[order], place[order]
        begins = lambda *keys: np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in keys], axis=0)]))
        pair = begins(tok, doc)  # where a token's places in a document begin
        tf, tok, doc = np.diff(np.append(pair, len(tok))), tok[pair], doc[pair]
        first = begins(tok)
        ints = lambda x: pa.array(x, pa.int32())
        n, said = np.diff(np.append(first, len(tok))), np.diff(np.append(pair[first], len(place)))
        ends = np.cumsum(3 * n + said)
        base = ends - 3 * n - said
        each = np.repeat(base, n) + np.arange(len(tok)) - np.repeat(first, n)
        packed = np.empty(ends[-1], np.int32)
        for i, x in enumerate((lengths[doc], tf, pair - np.repeat(pair[first], n))):
            packed[each + i * np.repeat(n, n)] = x
        packed[np.repeat(base + 3 * n, said) + np.arange(len(place)) - np.repeat(pair[first], said)] = place
        yield pa.RecordBatch.from_arrays([
            coded.dictionary.take(pa.array(tok[first])), pa.array([field] * len(first)), pa.array(np.full(len(first), span, np.int64)), ints(n),
            pa.array(np.maximum.reduceat(_impact(tf, lengths[doc], means[field]), first)), pa.ListArray.from_arrays(ints(np.append(first, len(tok))), whole(0).take(pa.array(doc))), pa.ListArray.from_arrays(ints(np.append(0, ends)), ints(packed)),
        ], names=["tok", "field", "span", "n", "impact", "doc_id", "packed"])


def _bucket(tok, buckets: int):
    return F.pmod(F.crc32(tok.cast("binary")), F.lit(buckets)).cast("int")


def _impact(tf, length, mean):
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean))


def open_sparse(spark: SparkSession, path: str) -> DataFrame:
    """The documents of an index, as they were put in."""
    return _own(keyed.read(spark, f"{path}/documents"))


def _own(rows: DataFrame) -> DataFrame:
    return rows.drop(keyed.PART, *[c for c in rows.columns if c == "_span" or c.startswith("_len_")])


def lookup(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The documents of some ids, from the parts that can hold them."""
    return _own(keyed.lookup(spark, f"{path}/documents", ids))


def existing(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Those of some ids that the index has."""
    return keyed.lookup(spark, f"{path}/documents", ids).select("doc_id").distinct()


def _tokens_of(spark: SparkSession, path: str, table: str, words: list[str] | None, buckets: int) -> DataFrame:
    """Rows of blocks or dictionary; of the given tokens only, if they are few enough to say."""
    rows = spark.read.parquet(f"{path}/{table}")
    if words is None:
        return rows
    return rows.where(F.col("bucket").isin(sorted({crc32(w.encode()) % buckets for w in words})) & F.col("tok").isin(words))


def postings(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """What the index has of some tokens: (doc_id, field, len, pos, tok)."""
    head = spark.read.parquet(f"{path}/statistics").first()
    if head is None:
        return keyed.read(spark, f"{path}/documents").select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("field", "string"), ("len", "int"), ("pos", "int"), ("tok", "string"))]).limit(0)
    rows = _tokens_of(spark, path, "blocks", words, head.buckets)
    return rows.select("tok", "field", F.explode(_placed()).alias("e")).select("e.doc_id", "field", "e.len", F.explode("e.places").alias("pos"), "tok")


def _placed() -> Column:
    """The documents of a block with their places, which the block holds one after another."""
    return F.transform("doc_id", lambda d, i: F.struct(d.alias("doc_id"), F.get("len", i).alias("len"), F.slice("places", F.get("begin", i) + 1, F.get("tf", i)).alias("places")))


def query_terms_of(spark: SparkSession, queries: dict[str, str] | DataFrame) -> DataFrame:
    """The terms of queries, a row a token: stated ones, or rows (query_id, text)."""
    if isinstance(queries, dict):
        return spark.createDataFrame([(q, t, i, len(p), w) for q, text in queries.items() for t, p in enumerate(parse_query(text)) for i, w in enumerate(p)], TERMS)
    said = queries.select(F.col("query_id").cast("string").alias("query_id"), F.posexplode(query_terms(F.coalesce(F.col("text"), F.lit("")))).alias("term", "p"))
    return said.select("query_id", "term", F.size("p").alias("width"), F.posexplode("p").alias("at", "tok")).select(*[c.split()[0] for c in TERMS.split(", ")])


@dataclass
class Search:
    """A search while it runs; ``bounds`` has each query's spans and what their documents can score at most."""

    spark: SparkSession
    path: str
    k: int
    terms: DataFrame
    weights: DataFrame
    words: list[str] | None
    buckets: int
    phrases: bool
    small: bool
    bounds: DataFrame | None = None
    seeds: DataFrame | None = None
    rest: DataFrame | None = None

    def near(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df

    def bounded(self) -> DataFrame:
        """(query_id, span, bound) from the heads of blocks."""
        heads = _tokens_of(self.spark, self.path, "blocks", self.words, self.buckets).select(*_HEAD)
        # a span may have several blocks of a token
        each = heads.join(self.near(self.terms), "tok").groupBy("query_id", "term", "width", "field", "span", "at").agg(F.max("impact").alias("impact"))
        term = each.groupBy("query_id", "term", "width", "field", "span").agg(F.min("impact").alias("impact"), F.count(F.lit(1)).alias("n")).where("n = width")
        # a little is added, as sums in another order may differ in the last digits
        return term.join(self.near(self.weights), ["query_id", "term", "field"]).groupBy("query_id", "span").agg((F.sum(F.col("weight") * F.col("impact")) * (1 + 1e-9)).alias("bound"))

    def scored(self, spans: DataFrame | None) -> DataFrame:
        """(query_id, doc_id, score) of all documents that match, in the spans given for each query, or in all."""
        every = _tokens_of(self.spark, self.path, "blocks", self.words, self.buckets)
        within = lambda df: df if spans is None else df.join(spans.select("query_id", "span"), ["query_id", "span"], "left_semi")
        blocks = within(every.join(self.near(self.terms.where("width = 1")), "tok"))
        one = blocks.select("query_id", "term", "field", F.explode(F.arrays_zip("doc_id", "len", "tf")).alias("e")).select("query_id", "term", "field", "e.*")
        if self.phrases:
            # a token's places, each less where the token stands in the phrase, are where the phrase may begin; those that all its tokens have count, overlaps included
            where = self.terms.where("width > 1").groupBy("query_id", "term", "width", "tok").agg(F.sort_array(F.collect_set("at")).alias("ats"))
            many = within(every.join(self.near(where), "tok")).select("query_id", "term", "width", "field", "ats", F.explode(_placed()).alias("e"))
            starts = _common(F.transform("ats", lambda a: F.transform("e.places", lambda p: p - a)))
            many = many.select("query_id", "term", "width", "field", "e.doc_id", "e.len", F.size("ats").alias("n"), starts.alias("starts")).where(F.size("starts") > 0)
            met = many.groupBy("query_id", "term", "width", "field", "doc_id", "len").agg(F.sum("n").alias("n"), F.collect_list("starts").alias("starts")).where("n = width")
            one = one.unionByName(met.select("query_id", "term", "field", "doc_id", "len", F.size(_common(F.col("starts"))).alias("tf")).where("tf > 0"))
        part = F.col("weight") * _impact(F.col("tf"), F.col("len"), F.col("avg_len"))
        return one.join(self.near(self.weights), ["query_id", "term", "field"]).groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))

    def run(self) -> DataFrame:
        if self.small_index():
            return best(self.scored(None), self.k)
        self.bounds = stored(self.bounded(), "bounds")
        self.seeds = stored(_highest(self.bounds, SEEDS + self.k // SPAN_DOCS), "seeds")
        first = stored(self.scored(self.seeds), "seed-scores")
        floor = best(first, self.k).where(F.col("rank") == self.k).select("query_id", F.col("score").alias("floor"))
        open_spans = self.bounds.join(self.near(floor), "query_id", "left").where(F.col("bound") >= F.coalesce("floor", F.lit(0.0)))
        self.rest = stored(open_spans.select("query_id", "span").join(self.seeds, ["query_id", "span"], "left_anti"), "open-spans")
        return best(first.unionByName(self.scored(self.rest)), self.k)

    def small_index(self) -> bool:
        """Whether there are no more spans than would be scored first anyway."""
        return (self.spark.read.parquet(f"{self.path}/statistics").agg(F.max("spans")).first()[0] or 0) <= SEEDS


def searching(spark: SparkSession, path: str, queries: dict[str, str] | DataFrame, k: int) -> Search | None:
    """A search that is ready to run; None if there is nothing to look for."""
    if k <= 0:
        return None
    stats = spark.read.parquet(f"{path}/statistics")
    terms = query_terms_of(spark, queries)
    if isinstance(queries, DataFrame):
        terms = stored(terms, "terms")
    found = terms.agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("width")).first()
    head = stats.first()
    if not found.n or head is None:
        return None
    distinct = terms.select("tok").distinct()
    few = [r.tok for r in distinct.limit(MOST_TOKENS + 1).collect()]
    words = few if len(few) <= MOST_TOKENS else None
    small = found.n <= MOST_BROADCAST
    known = _tokens_of(spark, path, "dictionary", words, head.buckets).select("tok", "field", "df")
    # the statistics are a row a field
    idf = terms.join(distinct.crossJoin(F.broadcast(stats)).join(known, ["tok", "field"], "left").fillna(0, ["df"]), "tok")
    weight = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = stored(idf.groupBy("query_id", "term", "field").agg(F.sum(weight).alias("weight"), F.max("avg_len").alias("avg_len")), "weights")
    return Search(spark, path, k, terms, weights, words, head.buckets, found.width > 1, small)


def search(spark: SparkSession, path: str, queries: dict[str, str] | DataFrame, k: int) -> DataFrame:
    """The k best documents of each query by BM25: (query_id, rank, doc_id, score). Queries are stated, or rows (query_id, text)."""
    work = searching(spark, path, queries, k)
    if work is None:
        kind = keyed.read(spark, f"{path}/documents").schema["doc_id"].dataType
        return spark.createDataFrame([], "query_id string, rank int, doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast(kind))
    return work.run()


def _common(lists) -> Column:
    """What all of some arrays have."""
    return F.aggregate(F.slice(lists, 2, F.size(lists)), F.get(lists, F.lit(0)), F.array_intersect)


def _highest(bounds: DataFrame, n: int) -> DataFrame:
    """The n spans of each query with the highest bounds; a query's spans are thinned in parts before they meet."""
    order = [F.desc("bound"), F.col("span")]
    near = bounds.withColumn("r", F.row_number().over(Window.partitionBy("query_id", F.pmod(F.xxhash64("span"), F.lit(64))).orderBy(*order))).where(F.col("r") <= n)
    return near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("r") <= n).select("query_id", "span")


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties by doc_id; a query's candidates are thinned in parts before they meet."""
    order = [F.desc("score"), F.col("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    near = scored.withColumn("r", F.row_number().over(Window.partitionBy("query_id", part).orderBy(*order))).where(F.col("r") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
