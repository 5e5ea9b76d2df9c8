"""A training corpus from raw documents: five stages, each one of the operators in lodestone.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
``run`` writes each stage's rows as Parquet in the shared scratch space, reads
them for the next, and deletes what the stages before have written. All stages
but the last return the columns of documents, and further ones whatever their
names; the last returns doc_id, lang, source, n_tokens, ids and decoded.

Cases: an empty table stays empty through all stages; null and blank texts have
no words and are rejected by the quality rules; null languages and sources are
strata and leaves of their own; a null doc_id is the earliest. Of repeated rows
one keeps its lines (line dedup), of equal and near-equal texts one row stays
(n-gram join, the least doc_id, ties by the text's hash), so none are left for
mixing and encoding. Very long texts are handled whole by every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe_trie, line_dedup, mixing, ngram_join, quality_rules
from lodestone.session import mark, release, stored, table

#: Nothing is repeated here, and a tenth of the tokens is left out so that the weights can act.
RECIPE = mixing.Recipe(share=0.9, max_epochs=1)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with cutoffs from all labelled documents among them."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or line has, but for an edit for every 20 characters; short ones exactly."""
    return line_dedup.dedup(docs, equal_chars=1, per=20)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's prefix of its seeded epoch, by target weights."""
    return mixing.select(docs, RECIPE)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, and the text that these decode to."""
    out = bpe_trie.round_trip(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing to target weights", mix),
    ("BPE encoding", tokens),
]

#: Byte-pair encoding has no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    begun = mark(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, begun, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
