"""Operators 1, 2 and 10 against brute force, and that their plans have no Python in them."""

import collections
import re
import zlib
from fractions import Fraction

import pytest

from lodestone.llm import mixing, quality_rules, sharding


def python_free(df):
    plan = df._jdf.queryExecution().toString()
    return not re.search("Python|Pandas|Arrow", plan)


def test_sharding(docs, rows, empty, wide):
    out = sharding.assign(docs)
    assert python_free(out)
    got = out.collect()
    size = lambda t: len((t or "").encode()) + 1
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(16))
    assert sharding.assign(empty).count() == 0
    assert sharding.assign(wide).count() == len(rows)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_sharding_against_brute_force(spark, docs):
    """Every row's shard and slot by sorting all keys in one place; borders by walking over all of them."""
    d = docs.unionByName(spark.range(3000).selectExpr("id + 1000 as doc_id", "repeat('x', cast(id * id % 301 as int)) as text", "'en' as lang", "'s' as source", "1L as n_chars"))
    keyed = sorted((r.key, r.doc_id if r.doc_id is not None else -1, r["size"], r.text_crc32, r.copy) for r in sharding.keyed(d).collect())
    total = sum(k[2] for k in keyed)
    borders = sharding.splitters(sharding.keyed(d))
    assert len(borders) == 15 and borders == sorted(borders)
    for i, border in enumerate(borders, 1):
        below = [k for k in keyed if k[0] < border]
        size, target = sum(k[2] for k in below), total * i // 16
        near = [size, size + (keyed[len(below)][2] if len(below) < len(keyed) else 0), size - (below[-1][2] if below else 0)]
        assert abs(size - target) <= max(1, total / 16 * sharding.TOLERANCE) or abs(size - target) == min(abs(x - target) for x in near)
    want, slots = collections.Counter(), collections.Counter()
    for key, i, size, crc, _ in keyed:
        shard = sum(b <= key for b in borders)
        want[i, size, crc, shard, slots[shard]] += 1
        slots[shard] += 1
    got = collections.Counter((r.doc_id if r.doc_id is not None else -1, r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.assign(d).collect())
    assert got == want


def test_very_many_copies_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 100)
    d = spark.range(2050).selectExpr("cast(null as bigint) as doc_id", "'' as text")
    assert sorted(r.copy for r in sharding.keyed(d).collect()) == list(range(1, 2051))
    assert [r.n for r in sharding.shard_texts(d, 4).groupBy("shard").count().selectExpr("count as n").collect()] and sharding.shard_texts(d, 4).count() == 2050
    assert max(r["count"] for r in sharding.shard_texts(d, 4).groupBy("shard").count().collect()) < 700


def test_borders_close_together_are_found(spark):
    """Two rows hold nearly all bytes, so most borders lie around single rows."""
    d = spark.range(40).selectExpr("id as doc_id", "case when id in (3, 17) then repeat('y', 100000) else 'z' end as text")
    got = sharding.assign(d).collect()
    assert len(got) == 40 and all(0 <= r.shard < 16 for r in got)


def test_shards_are_near_equal(spark):
    d = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    sizes = [r["s"] for r in sharding.assign(d).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "s").collect()]
    assert len(sizes) == 16 and max(sizes) < 1.01 * sum(sizes) / 16
    same = spark.range(4000).selectExpr("cast(1 as bigint) as doc_id", "'same' as text")
    counts = [r["count"] for r in sharding.assign(same).groupBy("shard").count().collect()]
    assert len(counts) == 16 and max(counts) <= 1.05 * 4000 / 16


def test_shard_texts(docs, rows):
    from pyspark.sql import functions as F

    out = sharding.shard_texts(docs, 4)
    assert all(r.p == r.shard for r in out.select("shard", F.spark_partition_id().alias("p")).collect()) and out.rdd.getNumPartitions() == 4
    assert out.count() == len(rows) and set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "shard"}


def brute_fill(children, budget):
    """children: name -> (weight, cap). Shares by raising the water level step by step."""
    open_, given, left = dict(children), {}, Fraction(budget)
    while open_:
        w = sum(v[0] for v in open_.values())
        full = [n for n, (x, cap) in open_.items() if left * x / w >= cap]
        if not full:
            return given | {n: left * x / w for n, (x, _) in open_.items()}
        for n in full:
            given[n] = Fraction(open_[n][1])
        left -= sum(open_.pop(n)[1] for n in full)
    return given


@pytest.mark.parametrize("recipe", [mixing.Recipe(), mixing.Recipe(budget=900, max_epochs=1), mixing.Recipe(budget=10**9), mixing.Recipe(budget=3, max_epochs=2), mixing.Recipe(weights={"domain": {"web": 0, "other": 1}})])
def test_budgets_follow_the_tree(docs, recipe):
    rows = mixing.measured(docs)
    got = mixing.budgets(rows, recipe).collect()
    leaves = {(r.domain, r.lang, r.source): r for r in got}
    weight = lambda level, name: recipe.weights.get(level, {}).get(name, 1)

    def usable(path):
        return all(weight(lv, n) for lv, n in zip(mixing.LEVELS, path))

    cap = {p: r.tokens * recipe.max_epochs if usable(p) else 0 for p, r in leaves.items()}
    total = min(recipe.budget if recipe.budget is not None else sum(r.tokens for r in got), sum(cap.values()))
    assert sum(r.budget for r in got) == total
    exact = {(): Fraction(total)}
    for depth in range(3):
        level = {}
        for parent in {p[:depth] for p in leaves}:
            kids = {p[: depth + 1] for p in leaves if p[:depth] == parent}
            kids = {k: (weight(mixing.LEVELS[depth], k[-1]), sum(c for p, c in cap.items() if p[: depth + 1] == k)) for k in kids}
            share = brute_fill({k: v for k, v in kids.items() if v[0]}, exact.get(parent, Fraction(0)))
            level |= {k: share.get(k, Fraction(0)) for k in kids}
        exact |= level
    assert all(abs(r.budget - exact[p]) < 3 for p, r in leaves.items())
    assert all(r.budget <= cap[p] for p, r in leaves.items())


def test_prefixes_meet_budgets(docs, rows, wide, empty):
    recipe = mixing.Recipe(share=0.6, max_epochs=2)
    out = mixing.mixture(docs, recipe)
    assert python_free(out)
    got = out.collect()
    assert len(got) == len(rows)
    spent = collections.Counter()
    for r in got:
        assert 0 <= r.part_tokens <= r.n_tokens
        spent[r.domain, r.lang, r.source] += r.taken_tokens
    for b in mixing.budgets(mixing.measured(docs), recipe).collect():
        assert spent[b.domain, b.lang, b.source] == b.budget
    assert mixing.mixture(empty).count() == 0
    assert mixing.select(empty).count() == 0
    assert mixing.select(wide, recipe).columns == wide.columns
    one = mixing.select(docs, mixing.Recipe(share=0.6, max_epochs=1)).collect()
    assert 0 < len(one) < len(rows)


def brute_features(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {p for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w))


def test_quality_features(docs, rows, labels, empty, wide, spark):
    more = [(900, "a b c d e f g h " * 2, "en", "s", 1), (901, "\n\nx\nx\n x\n", "en", "s", 1), (902, "a b c d e f g h i a b c d e f g h " + "z " * 30, "en", "s", 1), (903, "\xa0 # | <>", "en", "s", 1)]
    d = docs.unionByName(spark.createDataFrame(more, docs.schema))
    out = quality_rules.judge(d, labels)
    assert python_free(out)
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    assert got == sorted((str(i), *brute_features(t)) for i, t, *_ in rows + more)
    assert quality_rules.judge(empty, labels).count() == 0
    assert quality_rules.keep(wide, labels).columns == wide.columns
    kept = {r.doc_id for r in quality_rules.judge(docs, labels.limit(0)).where("kept").collect()}
    assert kept == {i for i, t, *_ in rows if not brute_features(t)[-1]}


@pytest.mark.parametrize("n,k,p", [(100, 0, 0.03), (100, 3, 0.03), (5000, 120, 0.03), (200_000, 5800, 0.03), (10, 10, 0.5)])
def test_binomial_bound(spark, n, k, p):
    from math import exp, lgamma, log, log1p

    from pyspark.sql import functions as F

    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)]
    top = max(terms)
    want = top + log(sum(exp(t - top) for t in terms))
    got = spark.range(1).select(quality_rules.log_binomial_cdf(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
    assert got == pytest.approx(want, abs=1e-6)


def test_least_labels(spark):
    """Strata with one label too few get no cutoff, however clean; with enough they do."""
    assert quality_rules.least_labels(1) == 99 and quality_rules.least_labels(4) == 144
    need = quality_rules.least_labels(2)
    rows = [(i, " ".join(f"w{j}" for j in range(30)), "a" if i < need else "b") for i in range(2 * need - 1)]
    junk = [(1000 + i, " ".join(f"w{j}%%" for j in range(30)), s) for i, s in enumerate("ab")]
    d = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    good = spark.createDataFrame([(i, 1) for i, _, _ in rows], "doc_id long, quality int")
    assert {r.stratum for r in quality_rules.judge(d, good).where("not base_failed and not kept").collect()} == {"a"}


def test_false_rejection_is_limited(spark):
    """Noisy good documents in one stratum stop the cutoffs there; a clean stratum gets them."""
    rows = [(i, ("word " * 30 + ("% " * 12 if i % 2 else "")).strip(), "noisy" if i < 400 else "clean" if i % 2 == 0 else "junk") for i in range(1200)]
    rows = [(i, t, "noisy" if i < 400 else "clean") for i, t, _ in rows]
    d = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(30)) + (" %" * 12 if i % 2 else ""), s) for i, _, s in rows], "doc_id long, text string, lang string")
    good = spark.createDataFrame([(i, 1) for i, _, s in rows if s == "noisy" or i % 2 == 0], "doc_id long, quality int")
    got = quality_rules.judge(d, good).groupBy("stratum").pivot("kept").count().collect()
    by = {r["stratum"]: r.asDict() for r in got}
    assert by["noisy"].get("false") is None
    assert by["clean"]["false"] == 400 and by["clean"]["true"] == 400
