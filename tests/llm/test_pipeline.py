"""The corpus pipeline against its stages' brute force, and the registered queries."""

import collections

import duckdb
import pytest

import corpus_pipeline
from lodestone.llm import oracles, quality_rules
from tests.llm.test_duplicates import BLANK, brute_classes


@pytest.fixture(scope="module")
def folder(docs, labels, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{top}/documents.parquet")
    labels.write.parquet(f"{top}/labels.parquet")
    return f"file://{top}"


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing to target weights", "BPE encoding"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, was = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(was[j] + 1, row[-1] + 1, was[j - 1] + (x != y)))
    return row[-1]


def brute_stage_lines(rows):
    """Line dedup as the pipeline has it: exact repeats of any line with a word; from 20 characters on an edit for every 20."""
    places = sorted(((-1 if r[0] is None else r[0], n), x.strip(BLANK)) for r in rows for n, x in enumerate((r[1] or "").split("\n")) if x.strip(BLANK))
    first = {}
    for at, x in places:
        first.setdefault(x, at)
    long = [x for x in first if len(x) >= 20]

    def near(x, y):
        bound = max(1, max(len(x), len(y)) // 20)
        return abs(len(x) - len(y)) <= bound and edits(x, y) <= bound

    gone = {x for x in long for y in long if first[y] < first[x] and abs(len(x) - len(y)) <= max(1, max(len(x), len(y)) // 20) and near(x, y)}
    out, before = collections.Counter(), set()
    for r in rows:
        pieces = (r[1] or "").split("\n") if r[1] is not None else []
        again = (r[0], r[1]) in before
        before.add((r[0], r[1]))
        left = [x for n, x in enumerate(pieces) if not x.strip(BLANK) or (not again and x.strip(BLANK) not in gone and first[x.strip(BLANK)] == (-1 if r[0] is None else r[0], n))]
        text = "\n".join(left)
        if len(left) == len(pieces):
            out[r[0], r[1], r[4]] += 1
        elif text.strip(BLANK):
            out[r[0], text, len(text)] += 1
    return out


def test_stages_against_brute_force(spark, folder, docs, labels, tmp_path):
    from tokenizers import Tokenizer

    from lodestone.llm.vocab import place

    now = docs
    kept = collections.Counter(str(r.doc_id) for r in quality_rules.judge(docs, labels).where("kept").collect())
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [tuple(r) for r in now.collect()]
        out = stage(spark, now, folder)
        path = f"file://{tmp_path}/{i}"
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if i < 4:
            assert after.columns == docs.columns
        got = [tuple(r) for r in after.collect()]
        if name == "quality rules":
            assert collections.Counter(str(r[0]) for r in got) == kept and set(got) <= set(rows)
        elif name == "line dedup":
            assert collections.Counter((r[0], r[1], r[4]) for r in got) == brute_stage_lines(rows)
        elif name == "n-gram Jaccard join":
            classes = brute_classes(rows)
            assert sorted(str(r[0]) for r in got) == sorted({str(a) for a, b, _ in classes if a == b})
            assert set(got) <= set(rows)
        elif name == "mixing to target weights":
            held = now.toArrow()  # noqa: F841
            sql = f"WITH {oracles.mixing('held', corpus_pipeline.RECIPE)} SELECT doc_id FROM mixed WHERE full_epochs > 0 OR part_tokens > 0"
            assert sorted(r[0] for r in got) == sorted(i for (i,) in duckdb.sql(sql).fetchall()) and set(got) <= set(rows)
            assert 0 < len(got) < len(rows)
        else:
            lib = Tokenizer.from_file(place("byte_bpe_50k.json"))
            texts = {r[0]: r[1] for r in rows}
            for r in after.collect():
                assert r.ids == lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        now = after
    assert now.count() > 10


def test_last_stage_decodes_what_it_encoded(spark, docs, rows, folder):
    got = collections.Counter((r.doc_id, r.decoded) for r in corpus_pipeline.tokens(spark, docs, folder).collect())
    assert got == collections.Counter((i, t or "") for i, t, *_ in rows)


def test_stages_keep_columns_of_any_name(spark, wide, folder):
    from pyspark.sql import functions as F

    clash = wide.withColumns({c: F.lit(3) for c in ("left", "lines", "row_id", "least", "__d", "__lines", "judged", "level")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, folder)
        assert out.columns == clash.columns and out.where("__d <> 3 or lines <> 3 or level <> 3 or row_id <> 3").isEmpty()


def test_run_clears_what_it_wrote(spark, folder):
    from lodestone import session

    begun = session.mark(spark)
    out = corpus_pipeline.run(spark, folder)
    assert len(session._written(spark)) == begun + 1 and out.count() > 10


def test_empty_documents(spark, empty, labels, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
