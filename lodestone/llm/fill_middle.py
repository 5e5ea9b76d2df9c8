"""Fill-in-middle transformation by one scan of a byte automaton.

A table of transitions over bytes reads all texts of a batch at once, texts
parted by a byte that UTF-8 does not have. Its eight states say whether white
space, a unit's body, the inside of a character, or the beginning of a sentinel
was read last; a second table says what a transition counts: a code point that
begins, a unit that begins, a sentinel that is complete. A second pass turns the
counted transitions into places: the k-th unit of a text begins at the k-th
counted place, and running sums of code points give lengths.

The scan runs in lanes: the bytes are cut into equal stretches that advance
together, one table lookup for all of them a step. A lane starts some bytes early
in any state, since three bytes decide the state whatever it was before (the
longest of a character's inside and of an unfinished sentinel); ``settles`` proves
that from the table.

The form of a document, and its two cuts, follow from the SHA-256 of the seed and
its id. ``restore`` rebuilds the text from the output and the form alone: the same
scan finds the sentinels in the output, which the text itself does not have.

Cases: a null text is empty, and an empty text or one with a sentinel is plain:
its output is the text; a null doc_id is written as ``null`` in the hashed
string; repeated rows and ties are transformed alike; a very long text takes
memory in proportion to its length (some 30 bytes a byte in a worker); an empty
table gives no rows; further columns are kept by ``transform`` and ``restore``,
whose own columns (form, output, n, prefix_chars, middle_chars; restored) take
the place of those of the same names, and ignored by ``transform_digest``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.memory import bounded, returned
from lodestone.session import ship

#: Prefix, suffix and middle sentinels.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: States: begin of a text, white space, body, after "<", after "<" and a letter, and one to three bytes of a character to come.
_BEGIN, _SPACE, _BODY, _OPEN, _NAMED, _ONE, _TWO, _THREE = range(8)
#: What a transition counts.
CHAR, UNIT, SENTINEL = 1, 2, 4
#: Parts texts; no byte of UTF-8.
_END = 0xFF
#: Bytes after which the state is the same whatever it was before.
SETTLED = 3
_SPACES = frozenset(b" \t\n\v\f\r")
_LANE = 1_024


def tables() -> tuple[np.ndarray, np.ndarray]:
    """The automaton: next states and what the transitions count, at state * 256 + byte."""
    to, counts = np.zeros((8, 256), np.uint8), np.zeros((8, 256), np.uint8)
    for state in range(8):
        for byte in range(256):
            inside = 0x80 <= byte < 0xC0
            space = byte in _SPACES
            if byte == _END:
                continue
            counts[state, byte] = 0 if inside else CHAR
            if state == _BEGIN or space and state != _SPACE:
                counts[state, byte] |= UNIT
            if inside:
                to[state, byte] = {_THREE: _TWO, _TWO: _ONE}.get(state, _BODY)
            elif space:
                to[state, byte] = _SPACE
            elif byte == ord("<"):
                to[state, byte] = _OPEN
            elif state == _OPEN and byte in b"PSM":
                to[state, byte] = _NAMED
            elif byte >= 0xC0:
                to[state, byte] = _ONE if byte < 0xE0 else _TWO if byte < 0xF0 else _THREE
            else:
                to[state, byte] = _BODY
                if state == _NAMED and byte == ord(">"):
                    counts[state, byte] |= SENTINEL
    return to.ravel(), counts.ravel()


_TO, _COUNTS = tables()
_FROM = _TO.astype(np.int32) << 8


def settles(to: np.ndarray = _TO) -> int:
    """The least number of bytes of well-formed text after which no two states differ; a proof from the table, by classes of bytes."""
    rows = to.reshape(8, 256)
    classes = np.unique(rows, axis=1).T.tolist()
    reached, n = {tuple(range(8))}, 0
    while any(len(set(r)) > 1 for r in reached) and n < 8:
        reached, n = {tuple(c[s] for s in r) for r in reached for c in classes}, n + 1
    return n


def scan(raw: np.ndarray) -> np.ndarray:
    """What each byte's transition counts, for texts that each end with the parting byte."""
    n = len(raw)
    lanes = max(1, n // _LANE)
    step = -(-n // lanes)
    held = np.full(SETTLED + lanes * step, _END, np.uint8)
    held[SETTLED : SETTLED + n] = raw
    # column i of a lane is the byte i places after its early start
    columns = np.lib.stride_tricks.as_strided(held, (SETTLED + step, lanes), (1, step))
    out = np.empty((step, lanes), np.uint8)
    state = np.zeros(lanes, np.int32)
    for i in range(SETTLED + step):
        at = state + columns[i]
        if i >= SETTLED:
            out[i - SETTLED] = _COUNTS[at]
        state = _FROM[at]
    return out.T.ravel()[:n]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts with the parting byte after each, and the places where they begin, with the end."""
    raw = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
    begin = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    return raw, begin


class Counted:
    """The counted transitions of a batch of texts, and the places that they stand for."""

    def __init__(self, texts: list[bytes]):
        raw, self.begin = joined(texts)
        seen = scan(raw)
        self.units = np.flatnonzero(seen & UNIT)
        self.sentinels = np.flatnonzero(seen & SENTINEL)
        self.chars = np.concatenate([[0], np.cumsum(seen & CHAR, dtype=np.int64)])
        self.first = np.searchsorted(self.units, self.begin)
        self.first_sentinel = np.searchsorted(self.sentinels, self.begin)

    def n_units(self, i: int) -> int:
        return int(self.first[i + 1] - self.first[i])

    def has_sentinel(self, i: int) -> bool:
        return bool(self.first_sentinel[i + 1] > self.first_sentinel[i])

    def cut(self, i: int, k: int) -> int:
        """The byte of text i at which its first k units end."""
        at = self.first[i] + k
        end = self.begin[i + 1] - 1
        return int((self.units[at] if at < self.first[i + 1] else end) - self.begin[i])

    def length(self, i: int, a: int, b: int) -> int:
        """Code points of text i between two bytes."""
        return int(self.chars[self.begin[i] + b] - self.chars[self.begin[i] + a])

    def sentinel_ends(self, i: int) -> list[int]:
        """The bytes of text i at which sentinels end."""
        return (self.sentinels[self.first_sentinel[i] : self.first_sentinel[i + 1]] + 1 - self.begin[i]).tolist()


@dataclass(frozen=True)
class Rates:
    """The seed, and of a hundred documents how many are transformed, and of a hundred of these how many with the suffix first."""

    seed: int = 42
    transformed: int = 50
    suffix_first: int = 80


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers that a document's id and the seed give."""
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[8 * k : 8 * k + 8], 16) for k in range(4))


def transformed(ids: list[int | None], texts: list[bytes], rates: Rates) -> Iterator[tuple[int, str, int | None, int | None, bytes]]:
    """Of each text its units, form, lengths of prefix and middle, and output."""
    seen = Counted(texts)
    for i, (doc_id, text) in enumerate(zip(ids, texts)):
        n = seen.n_units(i)
        h1, h2, h3, h4 = draws(doc_id, rates.seed)
        if not text or seen.has_sentinel(i) or h3 % 100 >= rates.transformed:
            yield n, "plain", None, None, text
            continue
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = seen.cut(i, first), seen.cut(i, second)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < rates.suffix_first:
            form, parts = "spm", (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
        else:
            form, parts = "psm", (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
        yield n, form, seen.length(i, 0, a), seen.length(i, a, b), b"".join(parts)


class NotTransformed(ValueError):
    """An output that does not have the sentinels of its form."""


def restored(outputs: list[bytes], forms: list[str | None]) -> Iterator[bytes]:
    """The texts that outputs were made of."""
    seen = Counted(outputs)
    for i, (out, form) in enumerate(zip(outputs, forms)):
        if form not in ("psm", "spm"):
            yield out
            continue
        ends = seen.sentinel_ends(i)
        order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
        if len(ends) != 3 or ends[0] != 3 or any(out[e - 3 : e] != s for e, s in zip(ends, order)):
            raise NotTransformed(f"not an output of form {form}")
        x, y, middle = out[ends[0] : ends[1] - 3], out[ends[1] : ends[2] - 3], out[ends[2] :]
        yield (x + middle + y) if form == "psm" else (y + middle + x)


def _bytes(texts: list[str | None]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def _packed(rows: DataFrame, own: tuple[str, ...], *read) -> DataFrame:
    """The columns but the operator's own as one struct, so that their names cannot matter, and what is read."""
    rest = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in own] or [F.lit(None).cast("boolean").alias("none")]
    return rows.select(F.struct(*rest).alias("row"), *read)


def _unpacked(out: DataFrame, rows: DataFrame, own: tuple[str, ...]) -> DataFrame:
    return out.select(*[F.col(f"row.`{c}`") for c in rows.columns if c.lower() not in own], *own)


def transform(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """The rows of docs with their form, output, number of units and lengths of prefix and middle."""
    bounded(ship(docs.sparkSession))
    own = ("form", "output", "n", "prefix_chars", "middle_chars")
    packed = _packed(docs, own, docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("read"))
    schema = T.StructType([packed.schema["row"], *[T.StructField(c, T.StringType() if c in ("form", "output") else T.LongType()) for c in own]])

    def run(batches):
        for b in batches:
            got = list(transformed(b.column(1).to_pylist(), _bytes(b.column(2).to_pylist()), rates))
            n, form, prefix, middle, out = zip(*got) if got else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(form, pa.string()), pa.array(out, pa.binary()).cast(pa.string()), *(pa.array(x, pa.int64()) for x in (n, prefix, middle))], names=["row", *own])

    return _unpacked(packed.mapInArrow(lambda batches: returned(run(batches)), schema), docs, own)


def restore(rows: DataFrame) -> DataFrame:
    """Rows with columns output and form, and the text that they stand for as ``restored``."""
    bounded(ship(rows.sparkSession))
    own = ("restored",)
    packed = _packed(rows, own, rows["output"].alias("output"), rows["form"].alias("form"))
    schema = T.StructType([packed.schema["row"], T.StructField("restored", T.StringType())])

    def run(batches):
        for b in batches:
            back = list(restored(_bytes(b.column(1).to_pylist()), b.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(back, pa.binary()).cast(pa.string())], names=["row", "restored"])

    return _unpacked(packed.mapInArrow(lambda batches: returned(run(batches)), schema), rows, own)


def transform_digest(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """One row a document: units, form, lengths, and the hashes of the output and of the text that is rebuilt from it."""
    rows = transform(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), rates).drop("text")
    return restore(rows).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
