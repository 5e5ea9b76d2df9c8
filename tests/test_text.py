"""Text functions, HTML, chunks and corpus sources."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.html import html_to_text, html_to_text_native
from lodestone.operators.chunking import chunk_sources
from lodestone.sources import corpus
from tests.walk import chunks, merged, pieces, sections


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("html,want", [
    ("<p>one</p><p>two</p>", "one\ntwo"),
    ("a<br>b<br/>c", "a\nb\nc"),
    ("<h2>\n  Title</h2>text", "\n## Title\ntext"),
    ("<h5>Five</h5><h6>Six</h6>", "\n#### Five\n\n#### Six"),
    ("a<!-- <p>no</p> -->b", "ab"),
    ("a<!-- open", "a"),
    ("x<script>var t='</p>';</script>y<STYLE>p{}</STYLE >z", "xyz"),
    ("x<script>never closed", "x"),
    ("3 < 4 and <5 and a<b>bold</b>", "3 < 4 and <5 and abold"),
    ('<a title="a > b">link</a>', "link"),
    ("<a title=\"open>text</a> more", "text more"),
    ("&amp;lt; &lt;b&gt; &quot;q&quot; &#39;s&#39; a&nbsp;b ¶", "&lt; <b> \"q\" 's' a b"),
    ("<p>a  </p><p></p><p></p><p></p>b", "a\n\nb"),
    ("<" + "a " * 400 + ">tail", "tail"),
    ("<a", "<a"),
    ("", ""),
])
def test_html(html, want):
    assert html_to_text(html) == want


def test_html_null_and_native(spark):
    assert html_to_text(None) is None
    page = "<html><head><style>p{}</style></head><body><h1>Hi &amp; bye</h1><ul><li>a</li><li>b</li></ul><!-- x --></body></html>"
    assert value(spark, html_to_text_native(F.lit(page))) == html_to_text(page)


@pytest.mark.parametrize("text,want", [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("a\r\n\r\n", 2)])
def test_lines(spark, text, want):
    assert value(spark, F.size(X.lines(F.lit(text)))) == want and value(spark, X.line_count(F.lit(text))) == want


@pytest.mark.parametrize("line,want", [("OS-VLT-ADV-00", True), ("[AB-1]", True), ("ABCDEF-1", False), ("A-1", False), ("AB-CD", False), ("AB-1x", False), ("AB-1é", False), ("AB-12 and on", True), ("ab-12", False)])
def test_finding_ids(spark, line, want):
    assert value(spark, X.is_finding_id(F.lit(line))) is want


def test_sections_and_paths():
    text = "lead\n# One\nfirst\n## Deep\nsecond\n# Two\nthird\n"
    assert [t for t, _ in sections(text)] == [None, "One", "One — Deep", "Two"]


def test_short_sections_gather_until_enough():
    long = "word " * 50
    got = list(merged(iter([("A", "x\n"), ("A — B", long), ("C", "y\n"), ("D", "z\n")])))
    assert [t for t, _ in got] == ["A — B", "C"] and got[1][1] == "y\nz\n"
    assert [t for t, _ in merged(iter([(None, "x"), ("H", "y")]))] == ["H"]
    assert [t for t, _ in merged(iter([("A", "x"), ("B", "y")]))] == ["A"]


def test_chunks_carry_path_tags_and_bytes():
    body = "# Check\n" + "é" * 900 + "\n" + "missing-signer here\n" * 40
    got = chunks("Book", ["base"], body)
    assert all(t == "Book — Check" for t, _, _ in got) and len(got) > 1
    assert all(len(p.encode()) <= 1500 or p.count("\n") == 1 for _, p, _ in got)
    assert any(tags == ["base", "missing-signer"] for _, _, tags in got)
    assert chunks("Book", [], "  \n ") == []


@pytest.mark.parametrize("text", ["", "a\n" * 2000, "x" * 4000, "ab\n" * 400 + "\n" * 30, "line\r\n" * 500, "é\n" * 1200])
def test_pieces_agree_with_sql(spark, text):
    assert value(spark, X.split_oversized(F.lit(text))) == pieces(text)


def test_chunk_sources(spark):
    rows = [("s1", "u", "T", "# A\n" + "word " * 60 + "\n# B\nshort", ["k"]), ("s2", "u", "T", "", []), ("s3", "u", "T", None, None)]
    got = chunk_sources(spark.createDataFrame(rows, "source_id string, url string, title string, text string, class_tags array<string>")).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == ["s1#0", "s1#1"] and got[0].title == "T — A"


def test_chunks_agree_with_a_walk(spark):
    """Random pages of headings, finding ids, blank and long lines: the expressions give what a walk over the lines gives."""
    import random

    rng = random.Random(11)
    kinds = ["# {}", "## {}", "### {}", "#### {}", "##### {}", "#{}", "OS-{}-1 text", "[AB-{}]", "AB-C{}", "", "  ", "{} " * 12, "é{} " * 60, "{}" * 900, "missing-signer {}", "# ", "## One — {}"]
    rows = []
    for k in range(160):
        lines_ = [rng.choice(kinds).replace("{}", rng.choice(["X", "Y9", "One", "two"])) for _ in range(rng.choice([0, 1, 2, 5, 12, 40]))]
        rows.append((f"s{k}", "u", rng.choice(["T", None, "One"]), rng.choice(["\n", "\r\n", "\n"]).join(lines_) + rng.choice(["", "\n", "\n\n  "]), rng.choice([None, [], ["z", "base"]])))
    got = {}
    for r in chunk_sources(spark.createDataFrame(rows, "source_id string, url string, title string, text string, class_tags array<string>").repartition(4)).collect():
        got.setdefault(r.source_id, []).append((r.chunk_ix, r.title, r.text, list(r.class_tags)))
        assert r.doc_id == f"{r.source_id}#{r.chunk_ix}"
    for name, _, title, text, tags in rows:
        want = [(i, *c) for i, c in enumerate(chunks(title or "", tags or [], text))]
        assert sorted(got.get(name, [])) == want, text


def test_a_page_of_many_lines_takes_time_in_proportion(spark):
    import time

    page = "\n".join(f"## H{i}\n" + "some words of a line\n" * 30 for i in range(1_500))
    began = time.time()
    n = chunk_sources(spark.createDataFrame([("s", "u", "T", page, [])], "source_id string, url string, title string, text string, class_tags array<string>")).count()
    assert n == 1_500 and time.time() - began < 60


@pytest.mark.parametrize("path,unsafe", [("/etc/x", True), ("a/../b", True), ("..", True), ("a/b..c", False), ("a/b", False)])
def test_paths(spark, path, unsafe):
    assert value(spark, X.is_unsafe_path(F.lit(path))) is unsafe


def test_includes(spark):
    inc = lambda p, *w: value(spark, X.is_included(F.lit(p), F.array(*[F.lit(x) for x in w]) if w else F.array().cast("array<string>")))
    assert inc("repo-1/content/a.md", "content/") and not inc("repo-1/src/a.md", "content/", "doc") and inc("any") and inc("repo-1/doc/x", "/doc")


@pytest.mark.parametrize("name,want", [("vault_authority", True), ("feepayer", True), ("admin_account", True), ("admin_token_account", False), ("owner_pubkey", True), ("mint", False), ("_", False), ("key", False)])
def test_authority_names(spark, name, want):
    assert value(spark, X.is_authority(F.lit(name))) is want


def test_mentions_and_slices(spark):
    assert value(spark, X.mentions(F.lit("my_vault.x vault.y"), "vault.")) is True
    assert value(spark, X.mentions(F.lit("my_vault.x"), "vault.")) is False
    assert value(spark, X.line_slice(F.lit("a\nb\nc"), 2, 3)) == "b\nc" and value(spark, X.line_slice(F.lit("a"), 0, 3)) == ""
    assert value(spark, X.strip_fences(F.lit("```json\n[1]\n  ```\nx"))) == "[1]\nx"


def test_changes(spark):
    now = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "longer")], "id string, text string")
    sha = now.where("id = 'b'").select(F.sha2(F.col("text").cast("binary"), 256)).first()[0]
    old = spark.createDataFrame([("a", "", 0), ("b", sha, 1), ("c", "00", 90)], "id string, sha256 string, bytes int")
    got = {r.id: (r.outcome, r.size_change) for r in corpus.classify_changes(now, old, "id").collect()}
    assert got["a"] == ("fetched", "1 bytes, nothing cached before") and got["b"][0] == "unchanged"
    assert got["c"] == ("changed", "SHRANK 84 bytes — check the fetch before accepting it")


def test_manifest_and_trees(spark, tmp_path):
    (tmp_path / "m.toml").write_text('[[source]]\nid = "s"\nurl = "u"\ntitle = "t"\nclass_tags = ["x"]\n')
    row = corpus.load_manifest(spark, f"file://{tmp_path}/m.toml").first()
    assert (row.kind, row.include_paths, row.class_tags) == ("page", [], ["x"])
    for p in ("src/b.rs", "src/a.rs", "target/c.rs", ".git/d.rs", "src/e.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(p)
    assert [r.path for r in corpus.source_tree(spark, f"file:{tmp_path}").collect()] == ["src/a.rs", "src/b.rs"]
    with pytest.raises(Exception):
        corpus.source_tree(spark, f"file:{tmp_path}/nowhere").collect()
    with pytest.raises(ValueError):
        corpus.require_nonempty(row and spark.createDataFrame([], "a int"))


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for name, data in (("repo-1/src/a.rs", b"fn"), ("repo-1/doc/b.md", b"# b"), ("repo-1/c.txt", b"c"), ("repo-1/../evil.rs", b"x"), ("repo-1/src/bad.rs", b"\xff\xfe")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    path = f"file:{tmp_path}/a.tar.gz"
    assert sorted(r.path for r in corpus.archive_files(spark, path).collect()) == ["repo-1/doc/b.md", "repo-1/src/a.rs"]
    assert sorted(r.path for r in corpus.archive_files(spark, path, includes=("src/",)).collect()) == ["repo-1/src/a.rs"]


def test_pages_reach_python_in_small_batches(spark, tmp_path):
    """However many pages a partition has, a worker holds a bounded batch of them."""
    from lodestone.memory import BATCH_BYTES, BATCH_ROWS
    from lodestone.plans.text_queries import chunk_pages

    spark.createDataFrame([(1, "u", "<h1>A</h1>b")], "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    held = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.unset(k)
        assert chunk_pages(spark, f"file://{tmp_path}").count() == 1
        assert {k: int(spark.conf.get(k)) for k in keys} == keys
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
