"""Retrieval over the driver's tables: documents as chunks, embeddings as their vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import query_terms, tokens
from lodestone.operators import index, pivots
from lodestone.operators import retrieval as R
from lodestone.operators.embedding import HashEmbedder, embed_documents
from lodestone.operators.evaluate import rendered
from lodestone.plans.registry import query
from lodestone.session import scratch, table

TERMS = "the thonre licensed keit"
PHRASES = "Licensed-under The_and de,la thonre"
OVERLAPS = "ha-ha ha_ha_ha the-the"
_INDEXES: dict[tuple[str, str], str] = {}
_PIVOTS: dict[tuple[str, str], str] = {}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(" ", "source", "lang").alias("title"))


def _index(spark: SparkSession, sf_dir: str) -> str:
    """The postings of a folder's documents, built once a session in the shared scratch space."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        path = scratch(spark, "index")
        index.build_sparse(_docs(spark, sf_dir), path)
        _INDEXES[key] = path
    return _INDEXES[key]


def _search(spark: SparkSession, sf_dir: str):
    return lambda queries, k: index.search(spark, _index(spark, sf_dir), queries, k)


def _exists(spark: SparkSession, sf_dir: str):
    return lambda ids: index.existing(spark, _index(spark, sf_dir), ids)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else []


def _bm25_sql(q: str, k: int, name: str = "bm") -> str:
    """The k best by definition: tokens unnested, phrases by windows of neighbours."""
    phrases = R.parse_query(q)
    rows = ", ".join(f"({i}, [{', '.join(repr(w) for w in p)}])" for i, p in enumerate(phrases))
    return f"""
{name}_d AS (SELECT doc_id, f, list_filter(regexp_split_to_array(lower(x), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws
  FROM (SELECT doc_id, 'text' AS f, coalesce(text, '') AS x FROM documents UNION ALL SELECT doc_id, 'title', concat_ws(' ', source, lang) FROM documents)),
{name}_s AS (SELECT f, count(*) AS n, avg(len(ws)) AS av FROM {name}_d GROUP BY f),
{name}_p AS (SELECT * FROM (VALUES {rows}) v(i, p)),
{name}_df AS (SELECT f, w, count(*) AS df FROM (SELECT DISTINCT doc_id, f, unnest(ws) AS w FROM {name}_d) WHERE w IN (SELECT unnest(p) FROM {name}_p) GROUP BY f, w),
{name}_w AS (SELECT i, f, sum(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))) AS weight FROM (SELECT i, unnest(p) AS w FROM {name}_p) CROSS JOIN {name}_s LEFT JOIN {name}_df USING (f, w) GROUP BY i, f),
{name}_t AS (SELECT doc_id, f, len(ws) AS dl, i, (SELECT count(*) FROM range(1, len(ws) - len(p) + 2) r(j) WHERE ws[j:j + len(p) - 1] = p) AS tf FROM {name}_d, {name}_p WHERE list_contains(ws, p[1])),
{name}_h AS (SELECT doc_id, sum(weight * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / av))) AS score FROM {name}_t JOIN {name}_s USING (f) JOIN {name}_w USING (i, f) WHERE tf > 0 GROUP BY doc_id),
{name} AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM {name}_h ORDER BY score DESC, doc_id LIMIT {k})"""


_ROUNDED = "SELECT rank, doc_id, round(score, 6) AS score FROM bm"


@query(f"WITH {_bm25_sql(TERMS, 20)} {_ROUNDED}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir)({"q": TERMS}, 20).select(F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql(PHRASES, 20)} {_ROUNDED}")
def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir)({"q": PHRASES}, 20).select(F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql(OVERLAPS, 20)} {_ROUNDED}")
def bm25_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase whose occurrences overlap, from the postings."""
    return _search(spark, sf_dir)({"q": OVERLAPS}, 20).select(F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH d AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS tok FROM documents)
SELECT tok, count(*)::BIGINT AS df FROM d GROUP BY tok""")
def term_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of the texts with its document frequency, as the index holds it."""
    return spark.read.parquet(f"{_index(spark, sf_dir)}/dictionary").where("field = 'text'").select("tok", "df")


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws(' ', source, lang) AS title FROM documents)
SELECT l.doc_id, d.title, length(d.text)::BIGINT AS n_chars FROM (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l JOIN d USING (doc_id)""")
def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of some ids, from the parts of the index that can hold them."""
    ids = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return index.lookup(spark, _index(spark, sf_dir), ids).select("doc_id", "title", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


_BATCH = {"a": TERMS, "b": PHRASES, "c": OVERLAPS}


@query("WITH " + ", ".join(_bm25_sql(q, 5, f"bm_{c}") for c, q in _BATCH.items()) + " " + " UNION ALL ".join(f"SELECT '{c}' AS query_id, rank, doc_id, round(score, 6) AS score FROM bm_{c}" for c in _BATCH))
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several queries as rows of a table, in one search."""
    rows = spark.createDataFrame(list(_BATCH.items()), "query_id string, text string")
    return index.search(spark, _index(spark, sf_dir), rows, 5).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql(OVERLAPS, 20)} {_ROUNDED}")
def bm25_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without an index: the texts are scanned."""
    return R.bm25(_docs(spark, sf_dir), {"q": OVERLAPS}, 20).select(F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


_NEAR = "SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings"


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({_NEAR}) ORDER BY score DESC, doc_id LIMIT 20")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nearest(_vectors(spark, sf_dir), _vector(spark, sf_dir), 20).select("doc_id", F.round("score", 6).alias("score"))


@query("""SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, s AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, v.vec_id) AS rank
FROM (SELECT q.vec_id, v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) x(qid, vid, s) JOIN embeddings q ON q.vec_id = qid JOIN embeddings v ON v.vec_id = vid) WHERE rank <= 5""")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    asked = v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding")  # the stated query set
    return pivots.search(spark, _pivots(spark, sf_dir), asked, 5).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


def _pivots(spark: SparkSession, sf_dir: str) -> str:
    """Blocks of a folder's vectors about pivots, built once a session in the shared scratch space."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PIVOTS:
        path = scratch(spark, "pivots")
        pivots.build(_vectors(spark, sf_dir), path)
        _PIVOTS[key] = path
    return _PIVOTS[key]


@query("SELECT count(*)::BIGINT AS vectors, sum(CASE WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 THEN 1 ELSE 0 END)::BIGINT AS directed FROM embeddings")
def pivot_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the blocks about pivots hold: all vectors, and those that have a direction."""
    held = spark.read.parquet(f"{_pivots(spark, sf_dir)}/blocks")
    return held.agg(F.sum("n").alias("vectors"), F.coalesce(F.sum(F.when(F.col("pivot") >= 0, F.col("n"))), F.lit(0)).alias("directed"))


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({_NEAR}) WHERE doc_id IN (SELECT doc_id FROM labels)")
def cosine_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scores_for(_vectors(spark, sf_dir), _vector(spark, sf_dir), table(spark, sf_dir, "labels")).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_bm25_sql(TERMS, 40)}, d AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id FROM ({_NEAR}) ORDER BY score DESC, doc_id LIMIT 40)
SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf FROM (SELECT rank, doc_id FROM bm UNION ALL SELECT rank, doc_id FROM d) GROUP BY doc_id""")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _search(spark, sf_dir)({"q": TERMS}, 40).select("query_id", "rank", "doc_id")
    asked = spark.createDataFrame([("q", _vector(spark, sf_dir))], "query_id string, embedding array<float>")
    b = R.knn(_vectors(spark, sf_dir), asked, 40).select("query_id", "rank", "doc_id")
    return R.rrf(a.unionByName(b)).select("doc_id", F.round("rrf", 9).alias("rrf"))


def _hybrid_sql(k: int, dense: bool) -> str:
    legs = "SELECT rank, doc_id FROM bm" + (" UNION ALL SELECT rank, doc_id FROM dn" if dense else "")
    value = "CASE WHEN dn.doc_id IS NOT NULL OR place <= %d THEN near.score END" % (2 * k) if dense else "NULL::DOUBLE"
    return f"""WITH {_bm25_sql(TERMS, 4 * k)}, near AS ({_NEAR}), dn AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id FROM near ORDER BY score DESC, doc_id LIMIT {4 * k}),
fu AS (SELECT doc_id, sum(1.0 / (60 + rank)) AS rrf FROM ({legs}) GROUP BY doc_id), pl AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, doc_id) AS place FROM fu),
hit AS (SELECT pl.doc_id, rrf, {value} AS dense, bm.score AS bm25 FROM pl JOIN documents USING (doc_id) LEFT JOIN bm USING (doc_id) LEFT JOIN near ON near.doc_id = pl.doc_id LEFT JOIN dn ON dn.doc_id = pl.doc_id ORDER BY rrf DESC, pl.doc_id LIMIT {k})"""


_HITS = "SELECT row_number() OVER (ORDER BY rrf DESC, doc_id) AS rank, doc_id, round(rrf, 9) AS rrf, round(dense, 6) AS dense, round(bm25, 6) AS bm25 FROM hit"


def _hits(df: DataFrame) -> DataFrame:
    return df.select(F.col("rank").cast("long").alias("rank"), "doc_id", F.round("rrf", 9).alias("rrf"), F.round("dense", 6).alias("dense"), F.round("bm25", 6).alias("bm25"))


@query(f"{_hybrid_sql(10, True)} {_HITS}")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(R.hybrid(_docs(spark, sf_dir), _vectors(spark, sf_dir), TERMS, _vector(spark, sf_dir), 10, _search(spark, sf_dir), _exists(spark, sf_dir)))


@query(f"{_hybrid_sql(10, False)} {_HITS}")
def hybrid_sparse_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(R.hybrid(_docs(spark, sf_dir), None, TERMS, None, 10, _search(spark, sf_dir), _exists(spark, sf_dir)))


@query("""SELECT l.quality::VARCHAR || l.toxic::VARCHAR AS query_id, coalesce(CASE WHEN bool_or(c IS NOT NULL) THEN bool_or(coalesce(c >= 0.62, false)) ELSE bool_or(coalesce(length(d.text) > 0, false)) END, false) AS grounded
FROM labels l LEFT JOIN (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS c FROM embeddings WHERE vec_id > 0) v USING (doc_id) LEFT JOIN documents d USING (doc_id) GROUP BY 1""")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = R.scores_for(_vectors(spark, sf_dir), _vector(spark, sf_dir), table(spark, sf_dir, "embeddings").where("vec_id > 0").select(F.col("vec_id").alias("doc_id")))
    rows = table(spark, sf_dir, "labels").select(F.concat(F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("query_id"), "doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("double").alias("bm25"))
    return R.grounded(rows.join(scores, "doc_id", "left").join(docs, "doc_id", "left").withColumnRenamed("score", "dense"))


@query("""WITH a AS (SELECT left(sha256(doc_id::VARCHAR), 4) AS b, doc_id::VARCHAR || ':' || sha256(text) || chr(10) AS l, 1 AS n FROM documents),
b AS (SELECT left(b, 2) AS b, b || ':' || sha256(string_agg(l, '' ORDER BY l)) || chr(10) AS l, sum(n) AS n FROM a GROUP BY a.b),
c AS (SELECT b || ':' || sha256(string_agg(l, '' ORDER BY l)) || chr(10) AS l, sum(n) AS n FROM b GROUP BY b.b)
SELECT sha256(string_agg(l, '' ORDER BY l)) AS corpus_hash, sum(n)::BIGINT AS documents FROM c""")
def corpus_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.corpus_hash(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, score FROM (SELECT vec_id AS doc_id, coalesce(printf('%.4f', CASE WHEN vec_id % 3 = 0 THEN NULL ELSE vec_id / 8.0 END), '-') AS score FROM embeddings)")
def hit_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("vec_id") % 3 == 0, None).otherwise(F.col("vec_id") / 8.0).alias("s"))
    return v.select("doc_id", rendered(F.col("s"), 4).alias("score"))


@query("SELECT count(*) AS vectors, min(len(embedding))::BIGINT AS dim, count(*) = 0 AS is_empty FROM embeddings")
def vector_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.size(_vectors(spark, sf_dir))


@query("SELECT vec_id AS doc_id, CASE WHEN vec_id % 4 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 50 = 0")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    twice = old.where("doc_id % 4 = 0").select("doc_id", F.explode(F.array(F.lit(0), F.lit(100))).alias("add"), "label").select("doc_id", (F.col("label") + F.col("add")).alias("label"), F.col("add").alias("seq"))
    fresh = old.where("doc_id % 50 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "label", F.lit(0).alias("seq"))
    return R.upsert(old, twice.unionByName(fresh))


@query("SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t FROM documents)")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query("""SELECT item_id, array_to_string(list_filter(list_transform(string_split_regex(translate(text, '+^`:{}"[]()!\\*~', '               '), '\\s+'),
lambda x: array_to_string(list_filter(regexp_split_to_array(lower(x), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), '_')), lambda t: t <> ''), ' ') AS terms FROM benchmark""")
def query_terms_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(query_terms(F.col("text")), lambda p: F.array_join(p, "_")), " ").alias("terms"))


_EMBEDDED = """SELECT doc_id, array_to_string(list_transform(range(0, 8), lambda b: len(list_filter(t, lambda w: ('0x' || left(md5(w), 4))::INT % 8 = b))), ',') AS embedding
FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t FROM documents)"""


def _written(embedding: str) -> Column:
    return F.array_join(F.transform(embedding, lambda x: x.cast("int").cast("string")), ",")


@query(_EMBEDDED)
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.hash_embed(tokens(F.col("text"))).alias("embedding")).withColumn("embedding", _written("embedding"))


@query(_EMBEDDED)
def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through an embedder that is asked in batches."""
    got = embed_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), lambda: HashEmbedder(8))
    return got.select("doc_id", _written("embedding").alias("embedding"))


@query("SELECT vec_id AS doc_id, CASE WHEN vec_id % 4 = 0 THEN 0 ELSE round(embedding[1]::DOUBLE, 6) END AS first FROM embeddings")
def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors put into a store on disk, some of them twice: the last one holds."""
    path = scratch(spark, "vectors")
    v = _vectors(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string"))
    index.init_vectors(spark, path, "m", 64)
    index.put_vectors(v.withColumn("seq", F.lit(0)), path)
    index.put_vectors(v.where("cast(doc_id as bigint) % 4 = 0").withColumn("embedding", F.array_repeat(F.lit(0.0).cast("float"), 64)).withColumn("seq", F.lit(1)), path)
    return index.open_vectors(spark, path, "m", 64).select(F.col("doc_id").cast("long").alias("doc_id"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("SELECT vec_id AS doc_id, CASE WHEN vec_id % 7 = 0 THEN 7 WHEN vec_id % 4 = 0 THEN 4 ELSE round(embedding[1]::DOUBLE, 6) END AS first FROM embeddings JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = vec_id")
def vector_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deltas over a base, merged where some ids are looked up."""
    path = scratch(spark, "vectors")
    v = _vectors(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string"))
    index.init_vectors(spark, path, "m", 64)
    index.put_vectors(v.withColumn("seq", F.lit(0)), path)
    for k in (4, 7):
        index.put_vectors(v.where(F.col("doc_id").cast("long") % k == 0).withColumn("embedding", F.array_repeat(F.lit(k).cast("float"), 64)).withColumn("seq", F.lit(0)), path)
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    return index.open_vectors(spark, path, "m", 64, ids).select(F.col("doc_id").cast("long").alias("doc_id"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("""WITH t AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t FROM documents)
SELECT 'text' AS field, count(*) AS n_docs, round(avg(len(t)), 6) AS avg_len, sum(len(t))::BIGINT AS postings FROM t""")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sparse index holds of the texts: documents, mean length and postings."""
    path = _index(spark, sf_dir)
    total = F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)
    held = spark.read.parquet(f"{path}/blocks").where("field = 'text'").groupBy("field").agg(F.sum(total).alias("postings"))
    return spark.read.parquet(f"{path}/statistics").join(held, "field").select("field", "n_docs", F.round("avg_len", 6).alias("avg_len"), "postings")
