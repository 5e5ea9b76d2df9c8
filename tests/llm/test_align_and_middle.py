"""Token alignment against direct definitions, and fill-in-middle against expressions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import align, fill_middle
from lodestone.llm.byte_tokens import byte_tokens
from lodestone.llm.vocab import place

HOSTILE = [None, "", " ", "\n", "\n\n", "a▁b", "<unk> <s> </s> <|endoftext|>", "😀東京 é", "<0x41>", "\x00", "x" * 3000, "a  b ", "﻿a", " lead", "tab\tand\r\n", "ﬁ ½ ①"]


def aligned(rows):
    """From the definition, with the libraries alone: per row its counts, groups and links, then corpus-wide numbers."""
    import sentencepiece
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(place("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=place("piece_bpe_32k.model"))
    raw_of = {c: b for b, c in __import__("lodestone.llm.vocab", fromlist=["x"]).byte_chars().items()}

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and sp.is_byte(i) else p.replace("▁", " ").encode()

    def ends(parts):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    per, total = [], Counter()
    for d, text in rows:
        got = (d, 0, 0, 0, "", [])
        if text:
            a, b = lib.encode(" " + text, add_special_tokens=False), sp.encode(text)
            ba, bb = [bytes(raw_of[c] for c in t) for t in a.tokens], [piece(i) for i in b]
            if b"".join(ba) == b"".join(bb) == (" " + text).encode():
                ea, eb = ends(ba), ends(bb)
                cuts, p, groups = sorted(set(ea) & set(eb)), 0, []
                for c in cuts:
                    groups.append(",".join(str(i) for i, e in zip(a.ids, ea) if p < e <= c) + "|" + ",".join(str(i) for i, e in zip(b, eb) if p < e <= c))
                    p = c
                at_b = dict(zip(eb, b))
                links = [(i, at_b[e]) for i, e in zip(a.ids, ea) if e in at_b]
                total.update(links)
                got = (d, len(a.ids), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links)
        per.append(got)
    best = {}
    for (_, b), n in total.items():
        best[b] = max(best.get(b, 0), n)
    return Counter((d, na, nb, g, len(ls), sum(total[x] == best[x[1]] for x in ls), sum(total[x] for x in ls), h) for d, na, nb, g, h, ls in per)


@pytest.mark.parametrize("most", [align.MOST_BROADCAST, 40, 0])
def test_alignment_against_definition(spark, docs, rows, most):
    """With all pairs broadcast, with the most frequent ones, and with none."""
    rows = [(r[0], r[1]) for r in rows] + [(500 + k, t) for k, t in enumerate(HOSTILE)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(rows[-len(HOSTILE) :], "doc_id long, text string"))
    got = align.align_digest(df, most=most)
    cols = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == aligned(rows)


def test_frequent_pairs_bounded(spark):
    counts = spark.createDataFrame([(i, 0, n, False) for i, n in enumerate([1] * 50 + [5] * 6 + [100] * 2)], "a int, b int, count long, is_best boolean")
    for most in (1, 2, 3, 8, 20, 58, 100):
        floor = align._floor(counts, most)
        assert counts.where(f"count >= {floor}").count() <= most
    assert align._floor(counts, 8) == 2 and align._floor(counts, 58) == 0


def test_rank_and_select():
    rng = np.random.default_rng(1)
    places = np.unique(rng.integers(0, 1000, 300))
    bits = align.Bits.of(places, 1003)
    assert bits.select().tolist() == places.tolist()
    ask = np.arange(1003)
    assert bits.rank(ask).tolist() == [int((places <= p).sum()) for p in ask]


def test_alignment_cases(spark, empty, wide):
    assert align.align_digest(empty).count() == 0
    assert align.align_digest(wide).count() == wide.count()
    r = align.align_digest(spark.createDataFrame([(None, "ab")], "doc_id long, text string")).first()
    assert r.doc_id is None and r.n_links == r.n_groups >= 1


UNITS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def middle(doc_id, text):
    text = text or ""
    u = UNITS.findall(text)
    h = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(u), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return doc_id, len(u), form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_fill_middle_against_expressions(spark, docs, rows):
    rng = random.Random(6)
    letters = ["a", "é", "東", "😀", " ", "\n", "\t", "<", "P", "S", "M", ">", "<P", "\x0b", "\x85", "\xa0", "\x1c", "<S>"]
    more = [(1000 + k, "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 9, 40, 700])))) for k in range(400)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = Counter(tuple(r) for r in fill_middle.transform_digest(df).collect())
    assert got == Counter(middle(d, t) for d, t in [(r[0], r[1]) for r in rows] + more)
    assert {k[2] for k in got} == {"plain", "psm", "spm"}


def test_scan_lanes_agree_with_a_walk():
    """Whatever the length, so wherever lanes are cut, the scan counts what a walk from the begin counts."""
    assert fill_middle.settles() <= fill_middle.SETTLED
    rng = random.Random(5)
    to, counts = fill_middle.tables()
    for n in (0, 1, 2, 3, 1023, 1024, 1025, 5000):
        raw, _ = fill_middle.joined(["".join(rng.choice("aé東😀 <PSM>\n") for _ in range(n)).encode(), b"", b"<P> a"])
        state, want = 0, []
        for b in raw.tolist():
            want.append(counts[state * 256 + b])
            state = int(to[state * 256 + b])
        assert fill_middle.scan(raw).tolist() == want


def test_sentinels_that_pieces_could_make():
    """Pieces that end with the begin of a sentinel do not confuse the way back."""
    ids = list(range(400))
    texts = [b"<P < <S <M> "[: 3 + k % 5] + b" x <S y" for k in ids]
    out = list(fill_middle.transformed(ids, texts, fill_middle.Rates(transformed=100)))
    assert list(fill_middle.restored([o[4] for o in out], [o[1] for o in out])) == texts
    with pytest.raises(fill_middle.NotTransformed):
        list(fill_middle.restored([b"<P>a"], ["psm"]))


def test_fill_middle_cases(spark, empty, wide):
    assert fill_middle.transform_digest(empty).count() == 0
    out = fill_middle.restore(fill_middle.transform(wide))
    assert set(wide.columns) <= set(out.columns)
    assert out.where("restored <> coalesce(text, '')").count() == 0
    text = ("word " * 400_000).encode()
    (n, form, *_, raw), = fill_middle.transformed([3], [text], fill_middle.Rates(transformed=100))
    assert n == 400_001 and list(fill_middle.restored([raw], [form])) == [text]
