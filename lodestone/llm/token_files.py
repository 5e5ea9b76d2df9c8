"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

The documents are put in ascending order of doc_id by a range exchange. Each
partition writes its ids one after another, little-endian and unsigned, in a
file of its own (16 bits an id where the vocabulary allows it, else 32), with
its documents' ids and lengths beside it. One row a partition comes back to the
driver; the prefix sums over these rows are the partitions' bases. A second pass
writes the offsets file of each partition: the base plus the running sum of its
lengths, as unsigned 64-bit integers, one more than it has documents. Reading
maps the files into memory and cuts the ids at the offsets.

A file is written under the attempt's own name, and only files named in the
manifest count, so tasks may be run again or twice.

Cases: a null text is empty and has only the end id; rows with equal doc_id,
repeated ones too, stand in the order of their text's hash and length, and
copies of one row in that of the rows as they came, so that no partition has to
take them all; a null doc_id comes first; a very long text's ids
are held once, as the file has them; an empty table gives an empty manifest and
no rows; further columns are ignored, whatever their names.

Object stores are reached by the names that Spark has for them (``s3a`` and the
like). On a store that is no local or mounted folder a file cannot be mapped;
there ranges of it are read, a few documents at a time.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.vocab import WORD_END, Pieces, as_chars, place, plain
from lodestone.llm.memory import bounded, returned
from lodestone.session import arrow_store, scratch, ship

END_ID = 1
_ENCODERS: dict[tuple, "WordEncoder"] = {}
_NULL = -(1 << 63)


class WordEncoder:
    """Encodes with one vocabulary of the word-end kind, as its library does."""

    def __init__(self, path: str, dtype: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.dtype = np.dtype(dtype)
        model = self.lib.model
        self.pieces = Pieces(lambda piece: np.array([t.id for t in model.tokenize(as_chars(piece))], self.dtype).tobytes())

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, as the bytes of the file format."""
        if not text:
            return b""
        if not plain(text):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        out = b"".join(map(self.pieces.__getitem__, WORD_END.findall(text.lower())))
        self.pieces.trim()
        return out


def encoder(path: str, dtype: str) -> WordEncoder:
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = WordEncoder(path, dtype)
    return _ENCODERS[path, dtype]


def _width(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


class _Ranges:
    """The numbers of a file that cannot be mapped; a slice reads its range."""

    def __init__(self, file, dtype: str):
        self.file, self.dtype = file, np.dtype(dtype)

    def __len__(self) -> int:
        return self.file.size() // self.dtype.itemsize

    def __getitem__(self, s: slice) -> np.ndarray:
        begin, end, _ = s.indices(len(self))
        return np.frombuffer(self.file.read_at(max(0, end - begin) * self.dtype.itemsize, begin * self.dtype.itemsize), self.dtype)


def _map(uri: str, dtype: str, fs=None):
    """The numbers of a file: mapped into memory where it is local, else read by ranges."""
    known, path = arrow_store(uri)
    fs = fs or known
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    return _Ranges(fs.open_input_file(path), dtype)


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = END_ID, partitions: int | None = None) -> dict:
    """Write the files of all documents below ``folder`` and return the manifest.

    The manifest is also stored as manifest.json. It has a row for each
    partition, so its size follows the number of partitions, not of documents.
    """
    spark = bounded(ship(docs.sparkSession))
    path = path or place("word_bpe_49k.json")
    dtype = _width(path)
    ended = b"" if end_id is None else np.array([end_id], dtype).tobytes()
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, local = arrow_store(folder)
    fs.create_dir(local, recursive=True)

    def run(batches):
        enc = encoder(path, dtype)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
        fs, local = arrow_store(folder)
        n_docs = n_ids = 0
        with fs.open_output_stream(f"{local}/{name}.ids") as ids, fs.open_output_stream(f"{local}/{name}.docs") as heads:
            for b in batches:
                keys, sizes = [], []
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    got = enc.encode(text) + ended
                    ids.write(got)
                    keys.append(_NULL if key is None else key)
                    sizes.append(len(got) // enc.dtype.itemsize)
                heads.write(np.stack([np.array(keys, "<i8"), np.array(sizes, "<i8")], 1).tobytes())
                n_docs, n_ids = n_docs + len(keys), n_ids + sum(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["part", "name", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the row's number comes last, so that copies of one row, however many, are no one's share alone
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.length("text"), F.monotonically_increasing_id()]
    keyed = rows.select("*", *[k.alias(f"k{i}") for i, k in enumerate(order[1:])])
    keys = [order[0], "k0", "k1", "k2"]
    ordered = keyed.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    parts = sorted((r for r in ordered.mapInArrow(lambda batches: returned(run(batches)), "part long, name string, n_docs long, n_ids long").collect() if r.n_docs), key=lambda r: r.part)
    bases = np.concatenate([[0], np.cumsum([r.n_ids for r in parts], dtype=np.int64)])
    manifest = {"dtype": dtype, "end_id": end_id, "n_ids": int(bases[-1]), "parts": [{"name": r.name, "n_docs": r.n_docs, "n_ids": r.n_ids, "base": int(b)} for r, b in zip(parts, bases)]}

    def offsets(batches):
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, local = arrow_store(folder)
                sizes = _map(f"{folder}/{name}.docs", "<i8")[:].reshape(-1, 2)[:, 1]
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8") + np.uint64(base)
                tried = f"{local}/{name}.off-{uuid.uuid4().hex[:12]}"
                with fs.open_output_stream(tried) as f:
                    f.write(ends.tobytes())
                fs.move(tried, f"{local}/{name}.off")
                yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    if parts:
        _spread(spark, manifest).mapInArrow(lambda batches: returned(offsets(batches)), "name string").collect()
    with fs.open_output_stream(f"{local}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _spread(spark: SparkSession, manifest: dict) -> DataFrame:
    rows = [(p["name"], p["base"], p["n_docs"]) for p in manifest["parts"]]
    made = spark.createDataFrame(rows, "name string, base long, n_docs long")
    return made.repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)))


def read_token_files(spark: SparkSession, folder: str, manifest: dict | None = None) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens and the CRC of its ids."""
    bounded(ship(spark))
    if manifest is None:
        fs, local = arrow_store(folder)
        with fs.open_input_file(f"{local}/manifest.json") as f:
            manifest = json.loads(f.read())
    dtype = manifest["dtype"]

    def run(batches):
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, off, heads = _map(f"{folder}/{name}.ids", dtype), _map(f"{folder}/{name}.off", "<u8"), _map(f"{folder}/{name}.docs", "<i8")
                for at in range(0, len(heads) // 2, 20_000):
                    head = np.array(heads[2 * at : 2 * at + 40_000]).reshape(-1, 2)[:, 0]
                    starts = off[at : at + len(head) + 1].astype(np.int64)
                    cuts = starts - base
                    crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(cuts[:-1], cuts[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(head, pa.int64(), mask=head == _NULL), pa.array(starts[:-1]), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _spread(spark, manifest).mapInArrow(lambda batches: returned(run(batches)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, folder: str | None = None, path: str | None = None) -> DataFrame:
    """Write the documents' token files and return what is read back from them."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    return read_token_files(spark, folder, write_token_files(docs, folder, path))
