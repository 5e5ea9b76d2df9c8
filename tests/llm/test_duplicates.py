"""Operators 8 and 9 against brute force."""

import collections
import hashlib

import pytest

from lodestone.llm import line_dedup, ngram_join
from lodestone.llm.components import components


def shingles(t):
    w = [x for x in (t or "").replace("\x85", "x").replace("\xa0", "x").replace("\x1c", "x").split() if x]
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_classes(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    links = collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        least[k] = min(least.get(k, (1, 0)), (r[0] is not None, r[0] or 0)) if k in least else (r[0] is not None, r[0] or 0)
    return collections.Counter((r[0], least[find(i)][1] if least[find(i)][0] else None, links[i]) for i, r in enumerate(rows))


def test_near_duplicates(docs, rows, empty):
    got = collections.Counter(tuple(r) for r in ngram_join.near_duplicates(docs).select("doc_id", "class_id", "n_links").collect())
    assert got == brute_classes(rows)
    assert ngram_join.near_duplicates(empty).count() == 0


def test_large_group_in_blocks(spark):
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    got = collections.Counter(tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links").collect())
    assert got == brute_classes(rows)


def test_long_texts_hash_as_short_ones(monkeypatch):
    text = b" ".join(b"word%d" % (i * i % 977) for i in range(4000))
    whole = next(iter(ngram_join.shingle_sets([text])))
    monkeypatch.setattr(ngram_join, "_PIECE", 1000)
    assert (next(iter(ngram_join.shingle_sets([text]))) == whole).all()


def test_depth_is_shortened_to_the_recall():
    d = ngram_join.depth_for()
    assert 1 - (1 - 0.8**d) ** ngram_join.TREES >= ngram_join.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** ngram_join.TREES


def test_labels_are_tries():
    import numpy as np

    rng = np.random.default_rng(3)
    forest = ngram_join.Forest(ngram_join.TREES)
    a = np.unique(rng.integers(0, 1 << 62, 400, dtype=np.uint64))
    labels = np.stack([forest.labels(a), forest.labels(a[:-30]), forest.labels(rng.integers(0, 1 << 62, 400, dtype=np.uint64))])
    same = [(ngram_join._nodes(labels, d)[0] == ngram_join._nodes(labels, d)[1]) for d in range(1, 9)]
    assert all((x <= y).all() for x, y in zip(same[1:], same)) and same[0].sum() > same[7].sum() > 0
    assert not any((ngram_join._nodes(labels, d)[0] == ngram_join._nodes(labels, d)[2]).any() for d in range(2, 9))


def test_sizes_of_intersections():
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(0, 300), False), rng.integers(0, 1 << 62, 20, dtype=np.uint64)])) for _ in range(40)]
    got = ngram_join.Owners(sets).common(5, 30)
    assert all(got[i, j] == len(np.intersect1d(sets[i + 5], sets[j])) for i in range(25) for j in range(40) if i + 5 != j)


def edited(rng, words, n):
    w = list(words)
    for p in rng.sample(range(len(w)), n):
        w[p] = f"x{rng.random()}"
    return " ".join(w)


def test_prefix_is_shortened_as_the_links_need_it(spark):
    """Pairs far above the threshold are surely found early; ones just above it call for the shortest prefix."""
    import random

    rng = random.Random(11)

    def depths(edits, n):
        rows = []
        for i in range(n):
            words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
            rows += [(2 * i, " ".join(words)), (2 * i + 1, edited(rng, words, edits))]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        signed = ngram_join.signatures(docs)
        from pyspark.sql import functions as F

        classes = ngram_join.stored(signed.groupBy("h1", "h2", "n").agg(F.min("d").alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ngram_join._halves(ngram_join.TREES)]), "t")
        found, at = ngram_join.search(docs, classes, recall=0.999)
        assert found.select("rep").distinct().count() == 2 * n
        return at

    far, close = depths(1, 150), depths(3, 150)
    floor = ngram_join.depth_for(recall=0.999)
    assert far[0] == close[0] == 8 and far[-1] > close[-1] >= floor


def test_recall_on_planted_pairs(spark):
    """Pairs of every similarity above the threshold, the links of brute force against those found."""
    import random

    rng = random.Random(12)
    rows = []
    for i in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(150, 260))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, edited(rng, words, rng.randint(1, 6)))]
    want = {i for i in range(0, 800, 2) if len(shingles(rows[i][1]) & shingles(rows[i + 1][1])) * 5 >= 4 * len(shingles(rows[i][1]) | shingles(rows[i + 1][1]))}
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links > 0 and doc_id % 2 = 0").collect()
    assert {r.doc_id for r in got} == want and 100 < len(want) < 400


def test_a_node_of_5000_near_copies_sends_rows_in_proportion(spark, monkeypatch):
    import random

    rng = random.Random(13)
    words = [f"w{i}" for i in range(150)]
    sent = {}
    for g in (1250, 5000):
        rows = [(i, edited(rng, words, 1)) for i in range(g)]
        tasks, keep = [], ngram_join.stored

        def spy(df, tag):
            out = keep(df, tag)
            if tag == "members":
                tasks.append(out.selectExpr("sum(blocks)").first()[0] or 0)
            return out

        monkeypatch.setattr(ngram_join, "stored", spy)
        got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("class_id").agg({"n_links": "sum", "doc_id": "count"}).collect()
        monkeypatch.setattr(ngram_join, "stored", keep)
        assert len(got) == 1 and got[0]["count(doc_id)"] == g and got[0]["sum(n_links)"] >= 0.9999 * g * (g - 1)
        sent[g] = sum(tasks)
    assert sent[5000] <= 4.4 * sent[1250] and sent[5000] <= 5000 * ngram_join.TREES * 5


def test_blocks_give_the_same_links(spark, monkeypatch):
    import random

    rng = random.Random(14)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, edited(rng, words, rng.randint(1, 3))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = brute_classes(rows)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 20)
    got = collections.Counter(tuple(r) for r in ngram_join.near_duplicates(docs).select("doc_id", "class_id", "n_links").collect())
    assert got == whole


def test_keep_one(docs, rows, empty, wide):
    left = ngram_join.keep_one(docs).collect()
    classes = {(a, b) for a, b, _ in brute_classes(rows)}
    assert sorted(str(r.doc_id) for r in left) == sorted({str(a) for a, b in classes if a == b})
    assert ngram_join.keep_one(empty).count() == 0
    from pyspark.sql import functions as F

    clash = wide.withColumns({c: F.lit(7) for c in ("__d", "__r", "r", "least", "rep", "h1", "links")})
    out = ngram_join.keep_one(clash)
    assert out.columns == clash.columns and out.where("__d = 7 and __r = 7 and r = 7 and d = 1").count() == out.count() == len(left)
    assert ngram_join.near_duplicates(clash).count() == len(rows)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (9, 5), (8, 5), (7, 5), (6, 5), (5, 5)}
    assert components(edges.limit(0)).count() == 0


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


BLANK = " \t\n\x0b\x0c\r"


def brute_lines(rows):
    seen = []
    for i, t, *_ in rows:
        for n, x in enumerate((t or "").split("\n") if t is not None else []):
            if len(x.strip(BLANK)) >= 20:
                seen.append(((-1 if i is None else i, n), x.strip(BLANK)))
    first = {}
    for at, x in sorted(seen):
        first.setdefault(x, at)
    gone = {x for x in first for y in first if first[y] < first[x] and within_one(x, y)}
    out, before = collections.Counter(), set()
    for i, t, *_ in rows:
        pieces = t.split("\n") if t is not None else []
        again = (i, t) in before  # of repeated rows one is the earlier
        before.add((i, t))
        left = [x for n, x in enumerate(pieces) if len(x.strip(BLANK)) < 20 or (not again and x.strip(BLANK) not in gone and first[x.strip(BLANK)] == (-1 if i is None else i, n))]
        out[i, len(pieces), len(pieces) - len(left), hashlib.md5("\n".join(left).encode()).hexdigest()] += 1
    return out


def test_line_dedup(docs, rows, empty, wide):
    got = collections.Counter(tuple(r) for r in line_dedup.dedup_digest(docs).select("doc_id", "n_lines", "n_dropped", "left_md5").collect())
    assert got == brute_lines(rows)
    assert line_dedup.dedup_digest(empty).count() == 0
    assert line_dedup.dedup(empty).count() == 0
    from pyspark.sql import functions as F

    clash = wide.withColumns({c: F.lit(7) for c in ("__d", "__r", "__lines", "__left", "__stay", "lines", "left", "earlier", "r")})
    out = line_dedup.dedup(clash)
    assert out.columns == clash.columns and out.where("__d = 7 and __lines = 7 and left = 7 and lines = 7 and d = 1").count() == out.count() == line_dedup.dedup(docs).count()


def test_one_of_repeated_rows_keeps_its_lines(spark):
    a, b = "a line that is long enough to count here", "another line that is long enough as well"
    rows = [(1, f"{a}\n{b}\nx")] * 3 + [(2, b), (None, a)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_dropped) for r in line_dedup.dedup_digest(d).collect())
    assert got == [("1", 1), ("1", 2), ("1", 2), ("2", 1), ("None", 0)]
    assert sorted(r.text for r in line_dedup.dedup(d).collect()) == sorted([a, f"{b}\nx", "x", "x"])


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    a, b, c = ("a first line that is long enough to count", "another line that has nothing to do with it", "and a third line that stands for itself")
    rows = [(1, f"{a}\n{b}"), (5, a), (5, c), (None, b), (None, c)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.text for r in line_dedup.dedup(d).collect())
    assert kept == sorted([b, c, a])  # those without an id are the earliest
    near = spark.createDataFrame([(3, a), (5, a), (5, c), (None, b), (None, b), (None, c)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in ngram_join.keep_one(near).collect()) == sorted([("3", a), ("None", b), ("None", c)])


def test_line_dedup_finds_every_edit(spark):
    import random

    rng = random.Random(6)
    rows = []
    for k in range(60):
        base = "".join(rng.choice("abcde é") for _ in range(rng.randint(22, 40)))
        rows.append((10 * k, base))
        for j in range(1, 6):
            x, p = base, rng.randrange(len(base) + 1)
            x = rng.choice([x[:p] + "z" + x[p:], x[:p] + x[p + 1 :], x[:p] + "z" + x[p + 1 :], x[:p] + "zz" + x[p:], x + "q"])
            rows.append((10 * k + j, x))
    got = collections.Counter(tuple(r) for r in line_dedup.dedup_digest(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped", "left_md5").collect())
    assert got == brute_lines(rows)


def test_variants_of_an_edit_share_a_key():
    every = dict(sub_p=True, sub_s=True, del_p=True, del_s=True, short=True)
    keys = lambda t: {(int(k), min(int(r), 1)) for k, r in zip(*line_dedup.variants(t, **every))}
    base = "a line of text with words in it"
    assert keys(base) & keys(base.replace("words", "wards"))
    assert keys(base) & keys(base.replace("words", "word"))
    assert not keys(base) & keys(base[::-1])


def test_components_of_a_long_path_with_ids_out_of_order(spark):
    import random

    ids = list(range(3000))
    random.Random(7).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids[:-1], ids[1:])) + [(5000, 5001)], "a long, b long")
    got = {tuple(r) for r in components(edges).collect()}
    assert got == {(i, 0) for i in range(3000)} | {(5000, 5000), (5001, 5000)}


def test_keep_one_leaves_one_of_near_copies_that_share_an_id(spark):
    words = [f"w{i}" for i in range(150)]
    near = [" ".join([*words[:k], f"x{k}", *words[k + 1 :]]) for k in (5, 75, 130)]
    other = " ".join(f"v{i}" for i in range(60))
    for i in (None, 3):
        rows = [*[(i, t) for t in near], (i, other), (i, other), (7, near[0])]
        left = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((str(r.doc_id), r.text == other) for r in left) == [(str(i), False), (str(i), True)]


def test_short_lines_are_dropped_as_exact_repeats_only(spark):
    rows = [(1, "Of, edti oner.\na\n\nOf, edti ones."), (2, "  Of, edti oner.\nb\n\na"), (3, "a longer line that is left alone\nOf, edti oner.")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: r.text for r in line_dedup.dedup(d, equal_chars=1).collect()}
    assert left == {1: rows[0][1], 2: "b\n", 3: "a longer line that is left alone"}
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_digest(d, equal_chars=10).collect()} == {1: 0, 2: 1, 3: 1}
    assert {r.n_dropped for r in line_dedup.dedup_digest(d).collect()} == {0}


def test_the_edit_bound_grows_with_the_line(spark):
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, was = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(was[j] + 1, row[-1] + 1, was[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(8)
    lines = []
    for _ in range(12):
        base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(rng.randint(7, 40))]
        lines.append(" ".join(base))
        for _ in range(5):
            w = list(base)
            w[rng.randrange(len(w))] = "".join(rng.choice("xyz") for _ in range(rng.randint(1, 12)))
            lines.append(" ".join(w))
    near = lambda a, b: distance(a, b) <= max(1, max(len(a), len(b)) // 20)
    want = {i for i in range(len(lines)) if any(near(lines[j], lines[i]) for j in range(i))}
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    dropped = lambda out: {r.doc_id for r in out.where("n_dropped > 0").collect()}
    assert dropped(line_dedup.dedup_digest(d, per=20)) == want and len(want) > 20
    assert len(dropped(line_dedup.dedup_digest(d))) < len(want)


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, was = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(was[j] + 1, row[-1] + 1, was[j - 1] + (x != y)))
    return row[-1]


def test_distances_by_diagonals():
    import random

    rng = random.Random(2)
    for _ in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 25)))
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            p = rng.randint(0, len(b))
            b[p : p + rng.randint(0, 1)] = rng.choice(["", "a", "d"])
        b = "".join(b)
        e = _edits(a, b)
        assert [line_dedup.within(a, b, q) for q in range(8)] == [e <= q for q in range(8)]


def test_signs_never_rule_out_near_lines(spark):
    """An edit changes the counts by class by two at most, beyond 255 of a class as well."""
    import random

    rng = random.Random(5)
    rows = []
    for k in range(300):
        a = "".join(rng.choice("abcdeé東 ") for _ in range(rng.choice([1, 20, 200, 4000])))
        b, edits = list(a), rng.randint(0, 6)
        for _ in range(edits):
            p = rng.randint(0, len(b))
            b[p : p + rng.randint(0, 1)] = rng.choice(["", "x", "東"])
        rows.append((edits, *line_dedup.signs(a), *line_dedup.signs("".join(b))))
    got = spark.createDataFrame(rows, "e int, g long, h long, g2 long, h2 long").select("e", line_dedup._apart(("g", "g2"), ("h", "h2")).alias("x")).collect()
    assert all(r.x <= 2 * r.e for r in got) and max(r.x for r in got) > 4
    assert line_dedup.signs("") == (0, 0)


def test_a_line_of_a_megabyte_has_near_copies_found_in_seconds(spark):
    import random
    import time

    rng = random.Random(4)
    words = [f"w{rng.randint(0, 9999)}" for _ in range(180_000)]
    base, other = " ".join(words), " ".join(rng.sample(words, len(words)))
    some = list(words)
    for k in range(0, len(words), 3_000):
        some[k] = "zz"
    rows = [(1, base), (2, " ".join(some)), (3, other), (4, base + " more"), (5, base[: len(base) // 2])]
    assert len(base) > 1_000_000
    began = time.time()
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_digest(spark.createDataFrame(rows, "doc_id long, text string"), per=20).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0}
    assert time.time() - began < 120


def test_classes_of_lengths_are_few_and_cover_the_bound(spark):
    from pyspark.sql import functions as F

    step, of = line_dedup._class(F.col("id"))
    held = {r.id: (r.step, r.of) for r in spark.range(20, 60_000).select("id", step.alias("step"), of.alias("of")).collect()}
    assert all(held[n] == (1, n) for n in range(20, line_dedup.EXACT_LENGTHS))
    for n in (100, 799, 800, 1_700, 50_000):
        spread = n // 19
        assert len({held[m] for m in range(n - spread, n + spread + 1)}) <= 2 * 43 + 2


def test_recall_of_near_lines_of_the_small_table(spark):
    """All near lines of a real table, by pairs that character counts do not rule out: none is missed and none is too many."""
    import os

    import numpy as np

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no table")
    docs = spark.read.parquet(path).select("doc_id", "text")
    first = {}
    for d, text in sorted((r.doc_id, r.text or "") for r in docs.collect()):
        for k, line in enumerate(text.split("\n")):
            if len(line.strip(BLANK)) >= 20:
                first.setdefault(line.strip(BLANK), (d, k))
    lines = sorted(first, key=len)
    n = np.array([len(x) for x in lines])
    counts = np.stack([np.bincount(np.frombuffer(x.encode("utf-32-le"), "<u4") % 512, minlength=512) for x in lines])
    want = set()
    for i, x in enumerate(lines):
        j = np.arange(i + 1, np.searchsorted(n, n[i] + n[i] // 19 + 1, "right"))
        bound = np.maximum(1, n[j] // 20)
        d = counts[j] - counts[i]
        for q in np.flatnonzero((n[j] - n[i] <= bound) & (np.maximum(np.maximum(d, 0).sum(1), np.maximum(-d, 0).sum(1)) <= bound)):
            y = lines[j[q]]
            if line_dedup.within(x, y, int(bound[q])):
                want.add(y if first[y] > first[x] else x)
    kept = {(r.d, r.l) for r in line_dedup.kept_places(docs, per=20).collect()}
    assert {x for x in lines if first[x] not in kept} == want and len(want) > 100


def test_a_common_passage_gives_each_pair_of_lines_once(spark):
    """Lines that share a passage and thus many keys: rows of the last step are pairs, not keys of pairs, and earliest lines by length are all asked."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    passage = " ".join(word() for _ in range(40))
    lines = [" ".join([*[word() for _ in range(rng.randint(3, 9))], passage]) for _ in range(120)]
    lines += [x[:-8] + "zzzz" + x[-4:] for x in lines[60:80]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    place = ["d", "r", "l"]
    texts = line_dedup._lines(docs, 38)
    signed = texts.mapInArrow(line_dedup._signed, "d long, r long, l int, " + ", ".join(f"{g} long" for g in line_dedup._SIGNS))
    n = F.length("t")
    used = texts.select(*place, n.alias("n"), F.explode(line_dedup._far_keys(n, F.col("t"), 20)).alias("k")).select(*place, "n", "k.*").join(signed, place)
    columns = (*place, "n", *line_dedup._SIGNS)
    pairs, once = line_dedup._by_class(used, used, 20, columns)
    every = collections.Counter((r.d, r.d2) for r in pairs.select("d", "d2").collect())
    got = collections.Counter((r.d, r.d2) for r in pairs.where(once).select("d", "d2").collect())
    assert set(got) == set(every) and max(got.values()) == 1 and max(every.values()) > 3
    # by hand: the earliest line of each key and length, where the bound of lengths holds
    keys, size = collections.defaultdict(set), {}
    for r in used.collect():
        keys[r.key].add((r.d, r.own))
        size[r.d] = r.n
    want = set()
    for held in keys.values():
        for d, own in held:
            first = {}
            for e, theirs in sorted(held):
                if theirs or own:
                    first.setdefault(size[e], e)
            want |= {(d, e) for m, e in first.items() if abs(m - size[d]) <= max(m, size[d]) // 20}
    assert want <= set(got)
    left = {r.d for r in line_dedup.kept_places(docs, per=20).collect()}
    assert left.isdisjoint(range(120, 140)) and len(left) > 100


def test_more_signs_rule_out_more_and_never_near_lines(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(7)
    rows, names = [], line_dedup._SIGNS
    for k in range(300):
        a = "".join(rng.choice("abcdefghijklmnopé東 ") for _ in range(rng.choice([1, 20, 200, 6000])))
        b, edits = list(a), rng.randint(0, 9)
        for _ in range(edits):
            p = rng.randint(0, len(b))
            b[p : p + rng.randint(0, 1)] = rng.choice(["", "x", "東"])
        b = "".join(b)
        rows.append((edits, len(a), len(b), *line_dedup.signs(a, len(names)), *line_dedup.signs(b, len(names))))
    schema = "e int, n int, n2 int, " + ", ".join(f"{g} long" for g in (*names, *[f"{g}2" for g in names]))
    apart = line_dedup._apart(*[(g, f"{g}2") for g in names]) + F.abs(F.col("n") - F.col("n2"))
    assert all(r.x <= 2 * r.e for r in spark.createDataFrame(rows, schema).select("e", apart.alias("x")).collect())
