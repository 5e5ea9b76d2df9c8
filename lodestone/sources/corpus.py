"""Corpus sources: manifests, source trees, archives, and what changed since they were fetched."""

from __future__ import annotations

import io
import os
import tomllib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.clients.transport import Transport, get_bytes, outcome, urlopen
from lodestone.functions.html import html_to_text
from lodestone.sources.archives import archive_files, members  # noqa: F401
from lodestone.sources.manifest import write_atomically

MANIFEST = "id string, url string, title string, license string, retrieved string, sha256 string, class_tags array<string>, kind string, include_paths array<string>"
KINDS = ("page", "archive", "local")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The sources that a TOML manifest lists; kind is page and paths are empty unless said."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    rows = []
    for s in tomllib.loads(text).get("source", []):
        if s.get("kind", "page") not in KINDS:
            raise ValueError(f"source {s.get('id')}: kind {s['kind']}")
        rows.append((s["id"], s["url"], s["title"], s.get("license", ""), s.get("retrieved", ""), s.get("sha256", ""), s.get("class_tags", []), s.get("kind", "page"), s.get("include_paths", [])))
    return spark.createDataFrame(rows, MANIFEST)


def source_tree(spark: SparkSession, root: str, suffix: str = "rs") -> DataFrame:
    """(path, text) of the files below a folder, without build output and dot entries; a missing root is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(root)
    base = root.rstrip("/")
    below = F.substring_index("path", base.rsplit(":", 1)[-1].rstrip("/") + "/", -1)
    kept = files.select(below.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")).where(~F.rlike("path", F.lit(r"(^|/)(\.[^/]*|target)(/|$)")))
    return kept.orderBy("path")


def markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """All Markdown files of a folder as one text, each below its path as a heading."""
    files = source_tree(spark, root, "md")
    return files.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda f: F.concat(F.lit("# "), f["path"], F.lit("\n\n"), f["text"])), "\n\n").alias("text"))


# The wording of a change in size, which is part of the result.
def size_change(old: Column, new: Column) -> Column:
    """What happened to a source's size, in words."""
    return (
        F.when(old == 0, F.concat(new.cast("string"), F.lit(" bytes, nothing cached before")))
        .when(new > old, F.concat(F.lit("grew "), (new - old).cast("string"), F.lit(" bytes")))
        .when(new == old, "same size, different content")
        .otherwise(F.concat(F.lit("SHRANK "), (old - new).cast("string"), F.lit(" bytes — check the fetch before accepting it")))
    )


def classify_changes(fetched: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """Each fetched text against the recorded hash: fetched (none recorded), unchanged or changed."""
    now = fetched.select(key, F.sha2(F.col("text").cast("binary"), 256).alias("new_sha256"), F.octet_length("text").alias("new_bytes"))
    before = recorded.select(key, F.nullif(F.col("sha256"), F.lit("")).alias("old_sha256"), F.coalesce("bytes", F.lit(0)).alias("old_bytes"))
    both = now.join(before, key, "left").withColumn("old_bytes", F.coalesce("old_bytes", F.lit(0)))
    what = F.when(F.col("old_sha256").isNull(), "fetched").when(F.col("old_sha256") == F.col("new_sha256"), "unchanged").otherwise("changed")
    return both.withColumn("outcome", what).withColumn("size_change", size_change(F.col("old_bytes"), F.col("new_bytes")))


def fetched_text(kind: str, url: str, includes: list[str], get: Callable[[str], bytes]) -> str:
    """A source's normalised text: a page without its markup, an archive's or a folder's files each below its path."""
    if kind == "page":
        return html_to_text(get(url).decode("utf-8", "replace")) or ""
    if kind == "archive":
        parts = list(members(io.BytesIO(get(url)), includes=tuple(includes), name=url))
        if includes and not parts:
            raise ValueError(f"{url}: no file matches {', '.join(includes)}")
        return "\n\n".join(f"# {name}\n\n{text}" for name, text in sorted(parts))
    files = sorted(p for p in Path(url).rglob("*.md") if not any(x == "target" or x.startswith(".") for x in p.relative_to(url).parts))
    if not files:
        raise ValueError(f"{url}: no Markdown files")
    return "\n\n".join(f"# {p.relative_to(url)}\n\n{p.read_text(encoding='utf-8', errors='replace')}" for p in files)


def fetch(manifest: DataFrame, cache: str, transport: Transport = urlopen) -> DataFrame:
    """Fetch every source of a manifest, write its normalised text to the cache, and say what changed.

    (source_id, outcome, status, old_bytes, new_bytes, old_sha256, new_sha256,
    size_change): fetched, unchanged or changed, or failed with the kind of
    problem. The cache is written whatever the outcome. A manifest lists tens of
    sources, so fetching is the driver's work; all that follows is not.
    """
    spark = manifest.sparkSession
    os.makedirs(cache, exist_ok=True)
    rows, before = [], []
    for s in manifest.collect():
        path = os.path.join(cache, f"{s.id}.txt")
        old = os.path.getsize(path) if os.path.exists(path) else 0
        text, status = outcome(lambda: fetched_text(s.kind, s.url, s.include_paths, lambda url: get_bytes(url, transport=transport)))  # noqa: B023
        before.append((s.id, s.sha256, old))
        rows.append((s.id, text, status))
        if text is not None:
            write_atomically(path, text)
    now = spark.createDataFrame(rows, "source_id string, text string, status string")
    changes = classify_changes(now.where("text is not null"), spark.createDataFrame(before, "source_id string, sha256 string, bytes long"), "source_id")
    out = now.select("source_id", "status").join(changes, "source_id", "left")
    return out.withColumn("outcome", F.coalesce("outcome", F.lit("failed"))).select("source_id", "outcome", "status", "old_bytes", "new_bytes", "old_sha256", "new_sha256", "size_change")


def cached(manifest: DataFrame, cache: str) -> DataFrame:
    """(source_id, url, title, class_tags, text) of the sources whose text is in the cache; others are left out."""
    spark = manifest.sparkSession
    held = spark.read.text(f"{cache}/*.txt", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("source_id"), F.col("value").alias("text"))
    return manifest.select(F.col("id").alias("source_id"), "url", "title", "class_tags").join(held, "source_id")


def require_nonempty(corpus: DataFrame) -> DataFrame:
    """The corpus, or an error if it has no documents."""
    if corpus.isEmpty():
        raise ValueError("the corpus has no documents")
    return corpus
