"""Operators 4, 5 and 7 against the tokenizers library itself."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import bpe_trie, token_count, token_files
from lodestone.llm.vocab import place

ODD = "ab1 \n'st,_é²½ªÿ\xa0\t!  inthe"


@pytest.fixture(scope="module")
def byte_lib():
    return Tokenizer.from_file(place("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_lib():
    return Tokenizer.from_file(place("word_bpe_49k.json"))


def odd_texts(n=400, size=60):
    rng = random.Random(3)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, size))) for _ in range(n)] + ["don't we'll I'M\n\n\n  x\t\ty  ", "İ½ 東京 😀", "<|endoftext|>", "a" * 3000]


def test_counts_match_library(docs, rows, byte_lib):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(docs).collect())
    want = []
    for i, t, *_ in rows:
        n = len(byte_lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i if i is not None else -1, len((t or "").encode()), n, n > 512))
    assert got == sorted(want)


def scripts(rng, n):
    """Words of many scripts, with emoji, curly quotes, combining marks and special strings."""
    kinds = ["東京都は日本の首都です。", "Привет, мир — «текст»", "مرحبا بالعالم", "नमस्ते दुनिया", "e\u0301te\u0301", "👩‍👩‍👧‍👦🏽 🎉", "“it’s” don't we'll", "İstanbul ½ x²", "<|endoftext|>", "\n\n\n  \t", "x" * 40, "1234567890", "'s's't", "...!!!???", "ไทยภาษา"]
    return "".join(rng.choice(kinds) + rng.choice(["", " ", "  ", "\n"]) for _ in range(n))


@pytest.mark.parametrize("chunk,overlap", [(64, 4), (200, 16), (1000, 8), (4096, 256)])
def test_spliced_chunks_match_library(chunk, overlap, byte_lib):
    c = token_count.counter(place("byte_bpe_50k.json"))
    rng = random.Random(5)
    texts = odd_texts(30, 3000) + ["word " * 2000, "x" * 4000, " " * 3000, "ab1 " * 900 + "z" * 900 + " end" * 50]
    texts += [scripts(rng, 300) for _ in range(20)] + ["東京" * 3000, "🎉" * 2000, "<|endoftext|>" * 400, "'s" * 3000, "\n" * 5000 + "a", "ab" * 5000, "é" * 5000]
    before = c.splices
    assert c.counts(texts, chunk, overlap) == [len(byte_lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert c.splices > before + 20


def test_a_word_of_ten_million_letters(byte_lib, monkeypatch):
    c = token_count.counter(place("byte_bpe_50k.json"))
    rng = random.Random(6)
    once = "".join(rng.choice("abcdefghij") for _ in range(10_000))
    sizes, encode = [], token_count.Counter.ids
    monkeypatch.setattr(token_count.Counter, "ids", lambda self, t: sizes.append(len(t)) or encode(self, t))
    for word in ("a" * 10_000_000, "東" * 1_000_000):
        c.counts([word])
        assert max(sizes) <= 8 * token_count.CHUNK
    monkeypatch.undo()
    short = once * 5
    assert c.counts([short, "a" * 300_000]) == [len(byte_lib.encode(t, add_special_tokens=False).ids) for t in (short, "a" * 300_000)]


def test_a_tenth_of_documents_is_spliced():
    import duckdb

    folder = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(folder):
        pytest.skip("no tables here")
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{folder}'").fetchall()]
    spliced = sum(len((t or "").encode()) > token_count.CHUNK for t in texts)
    assert spliced >= len(texts) / 10


def test_trie_matches_library(byte_lib):
    c = bpe_trie.codec(place("byte_bpe_50k.json"))
    texts = odd_texts()
    ids = c.encode_many(texts)
    assert ids == [byte_lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert [c.decode(x) for x in ids] == [byte_lib.decode(x, skip_special_tokens=False) for x in ids] == texts


def test_trie_shares_prefixes_in_order():
    c = bpe_trie.TrieCodec(place("byte_bpe_50k.json"))
    words = sorted(w.encode() for w in ("the", "them", "theme", "then", " the", "zebra", "thermal"))
    assert c.traverse(words) == [tuple(c.encode_many([w.decode()])[0]) for w in words]


def test_trie_digest(docs, rows, byte_lib):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_trie.encode_digest(docs).collect()}
    want = set()
    for i, t, *_ in rows:
        ids = byte_lib.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want


def test_encode_decode_round_trip_keeps_columns(wide):
    from pyspark.sql import functions as F

    wide = wide.withColumns({"a.b": F.lit(1), "row": F.lit(2), "read": F.lit(3)})
    out = bpe_trie.decode(bpe_trie.encode(wide))
    assert set(wide.columns) | {"ids", "decoded"} == set(out.columns)
    assert out.where("decoded <> coalesce(text, '')").count() == 0


def test_round_trip_is_encode_and_decode(wide):
    both = lambda df: sorted(str(r) for r in df.select(*sorted(df.columns)).collect())
    assert both(bpe_trie.round_trip(wide)) == both(bpe_trie.decode(bpe_trie.encode(wide)))


def test_token_files(docs, rows, word_lib, tmp_path):
    folder = f"file://{tmp_path}/t"
    manifest = token_files.write_token_files(docs, folder, partitions=3)
    got = token_files.read_token_files(docs.sparkSession, folder).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    start = 0
    assert [r.doc_id for r in got] == [r[0] for r in order]
    for r, (_, t, *_) in zip(got, order):
        ids = word_lib.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert manifest["n_ids"] == start


def test_empty_tables(empty):
    assert token_count.token_counts(empty).count() == 0
    assert bpe_trie.encode_digest(empty).count() == 0
    assert token_files.token_files(empty).count() == 0
    assert bpe_trie.encode(empty).count() == 0


def test_ranges_read_what_maps_do(docs, tmp_path):
    """A file of a store that is not local, by ranges."""
    import pyarrow.fs as pafs

    folder = f"file://{tmp_path}/t"
    manifest = token_files.write_token_files(docs, folder, partitions=2)
    other = pafs.SubTreeFileSystem("/", pafs.LocalFileSystem())
    for part in manifest["parts"]:
        mapped, read = (token_files._map(f"{folder}/{part['name']}.ids", manifest["dtype"], fs) for fs in (None, other))
        assert isinstance(read, token_files._Ranges) and len(mapped) == len(read) == part["n_ids"]
        assert (mapped[:] == read[:]).all() and (mapped[3:9] == read[3:9]).all()


def test_one_id_is_spread_over_partitions(spark, tmp_path):
    d = spark.range(400).selectExpr("cast(null as bigint) as doc_id", "concat('word ', id) as text")
    manifest = token_files.write_token_files(d, f"file://{tmp_path}/t", partitions=4)
    assert len(manifest["parts"]) > 1 and max(p["n_docs"] for p in manifest["parts"]) < 250
    assert token_files.read_token_files(spark, f"file://{tmp_path}/t").count() == 400


def test_copies_of_one_row_are_spread_over_partitions(spark, tmp_path):
    """A million equal rows: no partition takes more than its share, and all are there."""
    d = spark.range(0, 1_000_000, 1, 8).selectExpr("7L as doc_id", "'one word' as text")
    manifest = token_files.write_token_files(d, f"file://{tmp_path}/t", partitions=8)
    assert len(manifest["parts"]) == 8 and max(p["n_docs"] for p in manifest["parts"]) < 250_000
    assert sum(p["n_docs"] for p in manifest["parts"]) == 1_000_000
    got = token_files.read_token_files(spark, f"file://{tmp_path}/t")
    assert got.selectExpr("count(distinct start)", "count(distinct ids_crc32)").first()[:] == (1_000_000, 1)


def test_files_on_an_object_store(spark, docs, tmp_path, monkeypatch):
    """A folder as Spark names it on an object store is reached by Arrow's name for the store."""
    import pyarrow.fs as pafs

    from lodestone import session

    held = pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem())
    asked = []

    def from_uri(uri):
        asked.append(uri)
        return held, uri.split("/", 3)[3]

    monkeypatch.setattr(pafs, "FileSystem", type("Known", (), {"from_uri": staticmethod(from_uri)}))
    fs, path = session.arrow_store("s3a://bucket/a/b")
    assert asked == ["s3://bucket/a/b"] and path == "a/b"
    with fs.open_output_stream("x.ids") as f:
        f.write(np.arange(9, dtype="<u2").tobytes())
    assert token_files._map("s3a://bucket/x.ids", "<u2")[2:5].tolist() == [2, 3, 4]


def test_columns_with_clashing_names(wide):
    from pyspark.sql import functions as F

    clash = wide.withColumns({c: F.lit(5) for c in ("n_tokens", "decoded", "spans", "start", "n_bytes")})
    for f in (token_count.token_counts, bpe_trie.encode_digest, token_files.token_files):
        assert f(clash).count() == wide.count()
