"""Alignment of two tokenizers' tokens over the same bytes, by bitsets of token ends.

Each text, led by a space, is encoded by a byte-level vocabulary (A) and by a
piece vocabulary (B). A bit for each byte of the batch says whether a token ends
there, packed in bytes for A and for B; their AND holds the shared cuts. The rank
of a cut, the bits set at or before it, is counted by population counts of whole
bytes summed up and of the part of one byte; the ranks in A and in B say which
tokens lie between two neighbouring cuts (a group), and select, the places of set
bits, gives the cuts themselves. Links then expand from the cuts: the tokens of A
and of B that end there. As no token is empty, one of each ends at a cut.

How often an id pair is linked in the whole corpus is an aggregation over the
pairs, each document giving a pair once with its number. ``linked`` brings the
numbers back to the documents: at most ``MOST_BROADCAST`` of the most frequent
pairs by a broadcast, all others by a shuffle, in which no pair is hot, as the
frequent ones have gone the other way.

Cases: a null or an empty text, and one whose bytes do not come back from A or B,
has no tokens: zeros and an empty string. Special strings in a text are plain
text. Repeated rows count again, in the numbers of pairs as well; ties for a B
id's highest number are all best. A very long text is encoded whole and takes
memory in proportion to its length; an empty table gives no rows; columns beyond
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.byte_tokens import ByteTokens, byte_tokens
from lodestone.llm.memory import bounded, returned
from lodestone.llm.vocab import place, slices
from lodestone.session import ship, stored

#: Rows of pairs (16 bytes each) that are broadcast at most.
MOST_BROADCAST = 1_000_000
#: Bits of a pair that are B's id.
_B_BITS = 20
_HELD: dict[str, "PieceTokens"] = {}
_BYTE = re.compile("<0x([0-9A-F]{2})>")


class PieceTokens:
    """A piece vocabulary with the bytes of every token; it leads a text with a space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._own.id_to_piece(i) for i in range(self._own.get_piece_size())]
        self.bytes_of = [bytes([int(m[1], 16)]) if self._own.is_byte(i) and (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size = np.fromiter(map(len, self.bytes_of), np.int64, len(pieces))

    def ids(self, text: str) -> list[int]:
        return self._own.encode(text)

    def raw(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def piece_tokens(path: str) -> PieceTokens:
    """The worker's vocabulary, loaded once."""
    if path not in _HELD:
        _HELD[path] = PieceTokens(path)
    return _HELD[path]


class Bits:
    """A set of places as packed bits, with rank and select."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, n: int) -> Bits:
        held = np.zeros(n, np.uint8)
        held[places] = 1
        return cls(np.packbits(held, bitorder="little"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.packed & other.packed)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set at or before each place."""
        byte, bit = places >> 3, places & 7
        part = self.packed[byte] & ((2 << bit) - 1).astype(np.uint8)
        return self.before[byte] + np.bitwise_count(part)

    def select(self) -> np.ndarray:
        """The places of all set bits, in order."""
        return np.flatnonzero(np.unpackbits(self.packed, bitorder="little"))


@dataclass
class Aligned:
    """A batch of texts: tokens of both sides, one after the other, and the groups between shared cuts."""

    a: np.ndarray  # ids
    b: np.ndarray
    a_end: np.ndarray  # of each group: how many tokens of a side end with it or before
    b_end: np.ndarray
    n_a: np.ndarray  # of each text
    n_b: np.ndarray
    n_groups: np.ndarray


def align(texts: list[str | None], left: ByteTokens, right: PieceTokens) -> Aligned:
    """Tokens, groups and their numbers for a batch of texts."""
    all_a, all_b, n_a, n_b, n_bytes = [], [], [], [], []
    for text in texts:
        a, b, n = [], [], 0
        if text:
            whole = f" {text}"
            raw = whole.encode("utf-8", "surrogatepass")
            a, b, n = left.ids(whole), right.ids(text), len(raw)
            if left.raw(a) != raw or right.raw(b) != raw:
                a, b, n = [], [], 0
        all_a += a
        all_b += b
        n_a.append(len(a))
        n_b.append(len(b))
        n_bytes.append(n)
    a, b = np.array(all_a, np.int64), np.array(all_b, np.int64)
    total = sum(n_bytes)
    ends_a, ends_b = (Bits.of(np.cumsum(v.size[x]) - 1, total) for v, x in ((left, a), (right, b)))
    shared = ends_a & ends_b
    cuts = shared.select()
    text_ends = np.cumsum(n_bytes, dtype=np.int64)
    groups = np.concatenate([[0], np.searchsorted(cuts, text_ends)])
    return Aligned(a, b, ends_a.rank(cuts), ends_b.rank(cuts), np.array(n_a), np.array(n_b), np.diff(groups))


def _digits(n: int) -> np.ndarray:
    """The decimal digits of numbers below n, right-aligned with zero bytes before them, and room for a separator."""
    width = len(str(max(n - 1, 0)))
    numbers = np.arange(n)
    cells = np.zeros((n, width + 1), np.uint8)
    for k in range(width):
        power = 10 ** (width - 1 - k)
        cells[:, k] = np.where((numbers >= power) | (power == 1), numbers // power % 10 + ord("0"), 0)
    return cells


_DIGITS = _digits(1 << 17)


def groups_text(x: Aligned) -> list[bytes]:
    """Of each text its groups, ``a1,a2|b1;a3|b2``, ids in decimal; empty without tokens."""
    g = len(x.a_end)
    a_begin, b_begin = np.concatenate([[0], x.a_end[:-1]]), np.concatenate([[0], x.b_end[:-1]])
    per_a, per_b = x.a_end - a_begin, x.b_end - b_begin
    # where each token stands when a group's tokens of A come before its tokens of B
    at_a = np.arange(len(x.a)) + np.repeat(b_begin, per_a)
    at_b = np.arange(len(x.b)) + np.repeat(x.a_end, per_b)
    ids = np.empty(len(x.a) + len(x.b), np.int64)
    ids[at_a], ids[at_b] = x.a, x.b
    cells = _DIGITS[ids]
    cells[:, -1] = ord(",")
    if g:
        cells[at_a[x.a_end - 1], -1] = ord("|")
        cells[at_b[x.b_end - 1], -1] = ord(";")
    flat = cells.ravel()
    shown = flat != 0
    size = shown.reshape(cells.shape).sum(1, dtype=np.int64) if len(cells) else np.zeros(0, np.int64)
    raw = flat[shown].tobytes()
    at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(x.n_a + x.n_b)])].tolist()
    return [raw[p : q - 1] if q > p else b"" for p, q in zip(at, at[1:])]


def links(x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All distinct linked id pairs of each text with their numbers, in order of texts: text, a, b, number."""
    text = np.repeat(np.arange(len(x.n_groups)), x.n_groups)
    pair = (x.a[x.a_end - 1] << _B_BITS | x.b[x.b_end - 1]) if len(text) else np.zeros(0, np.int64)
    order = np.lexsort((pair, text))
    text, pair = text[order], pair[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(new)
    return text[at], pair[at] >> _B_BITS, pair[at] & ((1 << _B_BITS) - 1), np.diff(np.append(at, len(text)))


_ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 binary, a array<int>, b array<int>, times array<int>"


def alignments(docs: DataFrame, left: str | None = None, right: str | None = None) -> DataFrame:
    """One row a document: its numbers of tokens, groups and links, the hash of its groups, and its distinct linked pairs (a, b) with their numbers."""
    bounded(ship(docs.sparkSession))
    left, right = left or place("byte_bpe_50k.json"), right or place("piece_bpe_32k.model")
    names = [c.split()[0] for c in _ROW.split(", ")]

    def run(batches):
        x, y, row = byte_tokens(left), piece_tokens(right), TaskContext.get().partitionId() << 32
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in slices(texts, 1_000_000):
                got = align(texts[lo:hi], x, y)
                text, pa_, pb, times = links(got)
                offsets = pa.array(np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32))
                arrays = [pa.ListArray.from_arrays(offsets, pa.array(c, pa.int32())) for c in (pa_, pb, times)]
                digests = [hashlib.sha256(t).digest() if t else None for t in groups_text(got)]
                plain = [np.arange(row, row + hi - lo), None, got.n_a, got.n_b, got.n_groups, got.n_groups]
                plain = [pa.array(ids[lo:hi] if c is None else c, pa.int64()) for c in plain]
                row += hi - lo
                yield pa.RecordBatch.from_arrays([*plain, pa.array(digests, pa.binary()), *arrays], names=names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(lambda batches: returned(run(batches)), _ROW)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Of each linked id pair the number of its links in the whole corpus, and whether no pair of its B id has more."""
    pairs = aligned.select(F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select("p.a", "p.b", "p.times").groupBy("a", "b").agg(F.sum("times").alias("count"))
    pairs = stored(pairs, "pairs")
    best = pairs.groupBy("b").agg(F.max("count").alias("best"))
    # a row for each id of B's vocabulary at most
    return pairs.join(F.broadcast(best), "b").select("a", "b", "count", (F.col("count") == F.col("best")).alias("is_best"))


def linked(aligned: DataFrame, counts: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The rows of ``alignments``, as written, with n_best and count_sum."""
    links = aligned.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select("row", "p.a", "p.b", "p.times")
    total, floor = counts.count(), 0
    if total > most:
        # the least number that no more than ``most`` pairs reach: numbers are few where they are small, so their histogram is as well
        floor = _floor(counts, most)
    frequent = counts.where(F.col("count") >= floor)
    joined = links.join(F.broadcast(frequent), ["a", "b"], "left")
    sums = [F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    if floor:
        rare = counts.where(F.col("count") < floor)
        rest = joined.where(F.col("count").isNull()).select("row", "a", "b", "times").join(rare.hint("shuffle_merge"), ["a", "b"])
        joined = joined.where(F.col("count").isNotNull()).select("row", "a", "b", "times", "count", "is_best").unionByName(rest.select("row", "a", "b", "times", "count", "is_best"))
    return aligned.drop("a", "b", "times").join(joined.groupBy("row").agg(*sums), "row", "left")


def _floor(counts: DataFrame, most: int) -> int:
    """A number of links that at most this many pairs have, found by halving powers of two."""
    by_power = {r.power: r.n for r in counts.groupBy(F.floor(F.log2("count")).cast("int").alias("power")).agg(F.count("*").alias("n")).collect()}
    held = 0
    for power in sorted(by_power, reverse=True):  # at most 63 rows
        held += by_power[power]
        if held > most:
            return 2 ** (power + 1)
    return 0


def align_digest(docs: DataFrame, left: str | None = None, right: str | None = None, most: int = MOST_BROADCAST) -> DataFrame:
    """One row a document: tokens of both sides, groups, links, how many of these are best for their B id, and the sum of their pairs' numbers."""
    aligned = stored(alignments(docs, left, right), "aligned")
    rows = linked(aligned, stored(pair_counts(aligned), "pair-counts"), most)
    nothing = F.lit(0).cast("long")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", nothing).alias("n_best"), F.coalesce("count_sum", nothing).alias("count_sum"), F.coalesce(F.lower(F.hex("groups_sha256")), F.lit("")).alias("groups_sha256"))
