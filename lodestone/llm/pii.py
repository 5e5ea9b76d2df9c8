"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns find e-mail and IP addresses, card and phone numbers. The field
tags words by their shape (runs of capitals, small letters and digits), their
length and their neighbours. It is trained on a small labelled table of marked
lines (a parameter; ``pii_examples`` makes the default one) by gradient ascent
on the likelihood, with exact sums by the forward-backward recursion. Its words
are those with a digit or an at sign and the three words after a cue such as
"password", so secrets of letters alone are reached; other words are never
personal data here, and they cut the chain. Runs are decoded by Viterbi in
numpy, all runs of a length at once.

A tagged span has to be what its kind says (a card number passes Luhn, an
address has four parts up to 255, a phone number 7 to 15 digits), else it goes;
two numbers in a row are taken apart. Words of a tagged span that a pattern has
found are left to the pattern; pattern spans stay as found.

Cases: a null text is empty and has no spans; repeated rows give repeated rows;
spans with equal begins are in the order of kinds, then by end; texts are scanned
whole, in time proportional to their length; an empty table gives no rows;
columns beyond doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from functools import lru_cache
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import pii_examples
from lodestone.llm.memory import bounded, returned
from lodestone.session import ship

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("none", *KINDS)
_ORDER = {k: i for i, k in enumerate(KINDS)}

_HIT = re.compile("[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits begins, as a later begin in it would fail alike.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def patterns(text: str) -> list[tuple[int, int, str]]:
    """The spans of the fixed patterns, in order of begin and kind."""
    if not _HIT.search(text):
        return []
    out = [(a, b, "email") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _DIGITS.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append((*m.span(), "phone"))
    out.sort(key=lambda s: (s[0], _ORDER[s[2]]))
    return out


_HOT = re.compile("[0-9@]+")
_PIECE = re.compile(r"""[^\s"'=,;:|!?%#&*$<>{}\[\]/]+|\S""")
_EDGES = set(" \t\n\r\x0b\x0c\"'=,;:|!?%#&*$<>{}[]/\x85\xa0\u2003\u3000")
_CUE = re.compile(r"(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)|pwd|secret|tokens?|credentials?|(?:api|access|private|auth)[_-]key|key|bearer)(?![A-Za-z])[A-Za-z_-]*", re.I)
#: The words after a cue that the field looks at, on the same line.
AFTER_CUE = 3
_CUE_WORD = re.compile(r"(?:[A-Za-z_]*(?:pass(?:word|wd|phrase|code)|pwd|secret|tokens?|credentials?|key|bearer)[A-Za-z_-]*)", re.I)
_PHONE_CUE = re.compile(r"(?:phone|tel|fax|mobile|call|ring|cell)\.?", re.I)
_NEXT = re.compile(r"""[ \t"'=:]{1,6}([^\s"'=,;:|!?%#&*$<>{}\[\]/]+)""")
_GAP = re.compile(r"""[ "'=:]{1,4}\Z""")
_SHAPES = ((re.compile("[A-ZÀ-ÖØ-Þ]+"), "\x01"), (re.compile("[a-zß-öø-ÿ]+"), "a"), (re.compile("[0-9]+"), "9"))
_HEX = re.compile("(?:[0-9a-f]+|[0-9A-F]+)\\Z")


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as A, a and 9; at most sixteen characters of it."""
    for p, s in _SHAPES:
        word = p.sub(s, word)
    return word.replace("\x01", "A")[:16]


def _bucket(n: int) -> int:
    return 0 if n == 0 else n.bit_length() if n < 16 else 5 if n < 20 else 6 if n < 32 else 7


def _trimmed(text: str, begin: int, end: int, least: int) -> int:
    """The end of a word without full stops and a closing bracket of its sentence."""
    opened = "(" in text[begin:end]
    while end > least and (text[end - 1] == "." or text[end - 1] == ")" and not opened):
        end -= 1
    return end


def runs(text: str) -> list[list[tuple[int, int]]]:
    """The runs of neighbouring words that the field tags, as spans of their words."""
    words: list[tuple[int, int]] = []
    done = 0
    for m in _HOT.finditer(text):
        if m.start() < done:
            continue
        begin = m.start()
        while begin > done and text[begin - 1] not in _EDGES and not text[begin - 1].isspace():
            begin -= 1
        end = _trimmed(text, begin, _PIECE.match(text, begin).end(), m.end())
        words.append((begin, end))
        done = max(end, m.end())
    cued = []
    for m in _CUE.finditer(text):
        at = m.end()
        for _ in range(AFTER_CUE):
            n = _NEXT.match(text, at)
            if not n:
                break
            cued.append((n.start(1), _trimmed(text, n.start(1), n.end(1), n.start(1) + 1)))
            at = n.end(1)
    if cued:
        hot = set(words)
        starts = {a for a, _ in words}
        words = sorted(hot | {(a, b) for a, b in cued if a not in starts})
    out: list[list[tuple[int, int]]] = []
    for a, b in words:
        if out and a < out[-1][-1][1]:
            continue
        if out and _GAP.match(text[out[-1][-1][1] : a]):
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
    return out


def features(text: str, run: list[tuple[int, int]]) -> list[list[str]]:
    """The features of each word of a run."""
    words = [text[a:b] for a, b in run]
    shapes = [shape(w) for w in words]
    digits = [sum(c.isdigit() for c in w) for w in words]
    # the digits and the number of numbers side by side, at each word of theirs
    sides: list[tuple[int, int]] = []
    for number, group in groupby(range(len(words)), lambda i: digits[i] > 0 and digits[i] + 3 >= len(words[i])):
        group = list(group)
        sides += [(sum(digits[i] for i in group), len(group) - 1)] * len(group) if number else [(digits[i], 0) for i in group]
    out = []
    for i, w in enumerate(words):
        before = text[max(0, run[i][0] - 32) : run[i][0]]
        gap = before[len(before.rstrip(" \"'=:")) :]
        near = re.findall(r"[^\W\d][\w.-]*", before)[-3:]
        letters = sum(c.isalpha() for c in w)
        f = ["bias", f"shape:{shapes[i]}", f"size:{_bucket(len(w))}", f"digits:{_bucket(digits[i])}", f"run:{_bucket(sides[i][0])}", f"last:{shapes[i - 1] if i else '-'}", f"next:{shapes[i + 1] if i + 1 < len(words) else '-'}", f"words:{min(sides[i][1], 6)}"]
        if letters and not digits[i] and "@" not in w:
            f.append("letters")
            f.append("long letters" if len(w) >= 10 else "short letters")
        if len(w) >= 12 and digits[i] and letters and _HEX.match(w):
            f.append("hex")
        if len(w) >= 16 and digits[i] and letters and w.isupper() and w.isalnum():
            f.append("capital key")
        if len(w) >= 12 and digits[i] and letters and w.isalnum():
            f.append("mixed")
        if digits[i] and digits[i] == len(w):
            f.append(f"number:{min(digits[i], 20)}")
            if 13 <= len(w) <= 19:
                f.append("luhn" if luhn(w) else "no luhn")
        if 0 < w.find("@") < len(w) - 3:
            f.append("address" if "." in w[w.find("@") :] else "at")
        if w.count(".") == 3 and not letters:
            f.append("dots")
        size = "long" if len(w) >= 8 else "short"
        for back, x in enumerate(reversed(near), 1):
            if _CUE_WORD.fullmatch(x):
                f.append(f"cue:{back}:{size}")
                if "=" in gap or ":" in gap or '"' in gap:
                    f.append(f"set:{back}:{size}")
            if _PHONE_CUE.fullmatch(x):
                f.append(f"phone:{back}")
            if back == 1 and x in ("is", "was"):
                f.append(f"is:{size}")
        if "=" in gap or '"' in gap:
            f.append(f"given:{size}")
        out.append(f)
    return out


class Field:
    """A linear-chain conditional random field with weights for (feature, label) and for label pairs."""

    def __init__(self, names: dict[str, int], own: np.ndarray, step: np.ndarray):
        self.names, self.own, self.step = names, own, step

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), len(LABELS)))
        for i, f in enumerate(rows):
            out[i] = self.own[[self.names[x] for x in f if x in self.names]].sum(axis=0)
        return out

    def decode(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each chain; chains of a length are decoded together."""
        out: list[np.ndarray] = [np.empty(0, int)] * len(chains)
        by: dict[int, list[int]] = {}
        for i, c in enumerate(chains):
            by.setdefault(len(c), []).append(i)
        for n, which in by.items():
            e = np.stack([chains[i] for i in which])
            best, back = e[:, 0], []
            for t in range(1, n):
                over = best[:, :, None] + self.step
                back.append(over.argmax(axis=1))
                best = over.max(axis=1) + e[:, t]
            path = [best.argmax(axis=1)]
            for b in reversed(back):
                path.append(np.take_along_axis(b, path[-1][:, None], axis=1)[:, 0])
            for i, labels in zip(which, np.stack(path[::-1], axis=1)):
                out[i] = labels
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def parse(line: str) -> tuple[str, list[tuple[int, int, str]]]:
    """A line of the labelled table as its text and its marked spans."""
    text, spans = "", []
    for part in re.split(r"(<(?:email|ip|card|phone|secret)>.*?</[a-z]+>)", line):
        m = re.fullmatch(r"<([a-z]+)>(.*)</[a-z]+>", part)
        if m:
            spans.append((len(text), len(text) + len(m[2]), m[1]))
        text += m[2] if m else part
    return text, spans


def train(lines: list[str] | None = None, rounds: int = 120, rate: float = 0.2, decay: float = 0.02) -> Field:
    """Fit the field to a labelled table by gradient ascent with moments (Adam), from zero weights."""
    names: dict[str, int] = {}
    by: dict[int, list[tuple[list[list[int]], list[int]]]] = {}
    for line in pii_examples.lines() if lines is None else lines:
        text, spans = parse(line)
        for run in runs(text):
            f = [[names.setdefault(x, len(names)) for x in row] for row in features(text, run)]
            by.setdefault(len(run), []).append((f, [next((LABELS.index(k) for a, b, k in spans if a < e and s < b), 0) for s, e in run]))
    k, n = len(LABELS), len(names)
    groups = []
    for length, chains in by.items():
        most = max(len(row) for f, _ in chains for row in f)
        at = np.full((len(chains), length, most), n)  # the last row of weights stays zero
        for i, (f, _) in enumerate(chains):
            for t, row in enumerate(f):
                at[i, t, : len(row)] = row
        groups.append((at, np.array([y for _, y in chains])))
    w = [np.zeros((n + 1, k)), np.zeros((k, k))]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for r in range(1, rounds + 1):
        g = [-decay * x for x in w]
        for at, y in groups:
            e = w[0][at].sum(axis=2)
            length = e.shape[1]
            alpha, beta = [e[:, 0]], [np.zeros_like(e[:, 0])]
            for t in range(1, length):
                alpha.append(_logsum(alpha[-1][:, :, None] + w[1], 1) + e[:, t])
            for t in range(length - 1, 0, -1):
                beta.append(_logsum(w[1] + (e[:, t] + beta[-1])[:, None, :], 2))
            beta.reverse()
            z = _logsum(alpha[-1], 1)[:, None]
            rows = np.arange(len(y))
            for t in range(length):
                p = -np.exp(alpha[t] + beta[t] - z)
                p[rows, y[:, t]] += 1
                np.add.at(g[0], at[:, t].reshape(-1), np.repeat(p, at.shape[2], axis=0))
                if t:
                    g[1] -= np.exp(alpha[t - 1][:, :, None] + w[1] + (e[:, t] + beta[t])[:, None, :] - z[:, :, None]).sum(axis=0)
                    np.add.at(g[1], (y[:, t - 1], y[:, t]), 1)
        g[0][n] = 0
        for i in range(2):
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            v[i] = 0.99 * v[i] + 0.01 * g[i] ** 2
            w[i] = w[i] + rate * (m[i] / (1 - 0.9**r)) / (np.sqrt(v[i] / (1 - 0.99**r)) + 1e-8)
    return Field(names, w[0][:n], w[1])


def fit(labelled: DataFrame, column: str = "line", most: int = 5_000) -> Field:
    """A field fitted to a table of marked lines; of more than ``most`` lines those with the least hashes are taken."""
    rows = labelled.where(F.col(column).isNotNull()).select(F.col(column).alias("line"))
    return train([r.line for r in rows.orderBy(F.xxhash64("line"), "line").limit(most).collect()])


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field fitted to the default table, once in a process."""
    return train()


def _sound(kind: str, text: str) -> bool:
    """Whether a span is what its kind says."""
    digits = _DIGITS.sub("", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return bool(_IP.fullmatch(text)) and all(int(x) <= 255 for x in text.split(".") if len(x) <= 4) and all(len(x) <= 4 for x in text.split("."))
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "email":
        return 0 < text.find("@") < len(text) - 1
    return len(text) >= 4


def _pieces(text: str, kind: str, words: list[tuple[int, int]]):
    """The sound spans of neighbouring words of one label: the whole, or else parts from the left, the longest first."""
    at = 0
    while at < len(words):
        for end in range(min(len(words), at + 8), at, -1):
            a, b = words[at][0], words[end - 1][1]
            if _sound(kind, text[a:b]):
                yield a, b, kind
                break
        else:
            end = at + 1
        at = end


def find(texts: list[str | None], field: Field) -> list[tuple[list, list]]:
    """For each text its pattern spans, and all spans with those that the field adds."""
    base, where, chains = [], [], []
    for i, text in enumerate(texts):
        base.append(patterns(text) if text else [])
        for run in runs(text) if text else []:
            where.append((i, run))
            chains.append(field.scores(features(text, run)))
    every = [list(b) for b in base]
    bounds: dict[int, tuple[list[int], list[int]]] = {}  # where pattern spans begin, and how far those so far reach
    for (i, run), labels in zip(where, field.decode(chains)):
        if not labels.any():
            continue
        begins, ends = bounds.setdefault(i, ([a for a, _, _ in base[i]], list(accumulate((b for _, b, _ in base[i]), max))))
        free = []
        for a, b in run:
            before = bisect.bisect_left(begins, b)
            free.append(not before or ends[before - 1] <= a)
        at = 0
        while at < len(run):
            end = at + 1
            while end < len(run) and labels[end] == labels[at] and free[end] == free[at]:
                end += 1
            if labels[at] and free[at]:
                every[i] += _pieces(texts[i], LABELS[labels[at]], run[at:end])
            at = end
    for s in every:
        s.sort(key=lambda s: (s[0], _ORDER[s[2]], s[1]))
    return list(zip(base, every))


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row a document: counts of the pattern kinds, the hash of their spans, all spans and their number."""
    bounded(ship(docs.sparkSession))
    field = field or trained()
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                got = find(texts[at : at + 500], field)
                counts = [pa.array([sum(s[2] == k for s in base) for base, _ in got], pa.int64()) for k in KINDS[:4]]
                sha = pa.array([hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in got])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(got)), *counts, sha, pa.array([_written(e) for _, e in got], pa.string()), pa.array([len(e) for _, e in got], pa.int64())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: returned(run(batches)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
