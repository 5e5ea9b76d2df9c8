"""Indexes on disk, manifests, review units and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators import index as I
from lodestone.operators.retrieval import DimensionMismatch, bm25, hash_embed
from lodestone.plans.sample_programs import LOCKER, SIEVE
from lodestone.sources import manifest


def test_index_build_is_idempotent(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = spark.createDataFrame([("a", "the vault", "t"), ("b", "a pot", "t")], "doc_id string, text string, title string")
    embed = lambda d: d.select("doc_id", hash_embed(tokens(F.col("text")), 4).alias("embedding"))
    for _ in range(2):
        assert I.build(docs, path, embed, "m", 4)
    assert [r.doc_id for r in bm25(I.open_sparse(spark, path), {"q": "vault"}, 3).collect()] == ["a"]
    assert {(r.doc_id, r.tok) for r in I.postings(spark, path, ["vault", "pot", "nope"]).collect()} == {("a", "vault"), ("b", "pot")}
    assert I.open_vectors(spark, path, "m", 4).count() == 2
    with pytest.raises(DimensionMismatch):
        I.open_vectors(spark, path, "m", 5)
    with pytest.raises(DimensionMismatch):
        I.put_vectors(spark.createDataFrame([("c", [1.0], 0)], "doc_id string, embedding array<float>, seq int"), path)
    I.init_vectors(spark, path, "m", 4)
    assert I.open_vectors(spark, path, "m", 4).count() == 2
    I.init_vectors(spark, path, "other", 4)
    assert I.open_vectors(spark, path, "other", 4).count() == 0


def test_dead_embedder_leaves_the_sparse_index(spark, tmp_path):
    def dead(_):
        raise ConnectionError

    path = f"file://{tmp_path}/index"
    docs = spark.createDataFrame([("a", "the vault", "t")], "doc_id string, text string, title string")
    assert I.build(docs, path, dead, "m", 4) is False and I.open_vectors(spark, path, "m", 4) is None
    assert I.open_sparse(spark, path).count() == 1


def test_manifest_hashes():
    text = '# top\n[[source]]\nid = "a" # first\nsha256 = "old"\nretrieved = "2020-01-01"\n\n[[source]]\nsha256 = ""\nid = "b"\n'
    new = manifest.with_hashes(text, {"a": ("n1", "2021-02-03"), "b": ("n2", "2021-02-03")})
    assert new == '# top\n[[source]]\nid = "a" # first\nsha256 = "n1"\nretrieved = "2021-02-03"\n\n[[source]]\nsha256 = "n2"\nid = "b"\n'
    assert manifest.with_hashes(text, {}) == text


def test_units(spark):
    from lodestone.lang.ir import program
    from lodestone.lang.units import units

    files = spark.createDataFrame([("s", "s.rs", SIEVE)], "program string, path string, text string")
    got = {u.handler: u for u in units(program(files), files).collect()}
    assert got["fill"].query.startswith("Solana Anchor instruction fill with 4 accounts. Account types: Account of Pot, Account of TokenAccount, Program of Token, Signer. Present constraints: mut. Operations: cross-program invocation, state mutation, unchecked addition.")
    assert "Absent on unchecked accounts: owner, address, seeds, signer." in got["drain"].query and "imperative checks present" in got["drain"].query
    assert got["lost"].query == "Solana Anchor instruction lost with 0 accounts." and "pub struct Fill" in got["fill"].source and "pub struct Pot" in got["fill"].source


def test_command_line(spark, tmp_path, capsys):
    from lodestone.__main__ import main

    (tmp_path / "locker/src").mkdir(parents=True)
    (tmp_path / "locker/src/lib.rs").write_text(LOCKER)
    (tmp_path / "sieve").mkdir()
    (tmp_path / "sieve/lib.rs").write_text(SIEVE)
    root = f"file:{tmp_path}"
    assert main(["analyze", f"{root}/sieve", "--format", "sarif"]) == 0
    assert len(json.loads(capsys.readouterr().out)["runs"][0]["results"]) == 7
    assert main(["analyze", f"{root}/locker"]) == 0 and "Static track (0)" in capsys.readouterr().out
    assert main(["ir", f"{root}/locker"]) == 0 and len(json.loads(capsys.readouterr().out)["handlers"]) == 3
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache/s.txt").write_text("# Vaults\n" + "a vault holds coins " * 30)
    (tmp_path / "m.toml").write_text('[[source]]\nid = "s"\nurl = "u"\ntitle = "T"\n')
    where = ["--manifest", f"{root}/m.toml", "--cache", f"{root}/cache", "--index", f"{root}/index"]
    assert main(["corpus", "index", *where]) == 0 and main(["corpus", "query", "vault", *where]) == 0
    assert "grounded: True" in capsys.readouterr().out
