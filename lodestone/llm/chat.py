"""Conversations as token ids with a loss mask that is aligned by offsets.

A conversation is rendered whole, turn after turn, and encoded once; its tokens'
byte lengths give their offsets. The turns whose texts are trained on are spans of
the rendered bytes, in order; a binary search of their ends among the tokens'
begins and ends finds each span's tokens, and these are the mask.

Template: ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>`` for every turn.
The three control strings are single tokens after the vocabulary's own, so no
token reaches over a span's end and the mask holds whole texts and nothing else.
A control string within a role or a text is not one: between ``<`` and ``|`` one
more backslash is put than stands there, and reading takes it away again, so that
every text comes back as it was.

Rows are dealt by ranges of (conv_id, turn, role, MD5 of the text, row number) and
sorted; a task goes over them once. A conversation of any number of turns is
spread over tasks: a task gives it in parts of about ``PART_BYTES``, cut between
turns, where encoding is cut anyway. So joining the ids of a conversation's parts
by ``part`` gives the encoding of the whole. ``whole`` says of a row that it is
all of its conversation. ``digest`` reads ids and mask back; it hashes whole
conversations where they are, and brings only the parts of the others together,
streaming: a task holds one part at a time, however long the conversation.

Cases: a null role or text is empty; a null conv_id is a conversation of its own,
the first one; null turns come first; turns of equal number are ordered by role
and the text's MD5, and repeated rows are repeated turns; a conversation without
a trained turn has an empty mask; a very long text is one part and takes memory
in proportion to its length; an empty table gives no rows; columns beyond
conv_id, turn, role and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.byte_tokens import ByteTokens, byte_tokens
from lodestone.llm.memory import bounded, returned
from lodestone.llm.vocab import place
from lodestone.session import ship

START, SEP, END = CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
#: Roles whose texts are trained on.
TRAINED = ("assistant",)
#: Rendered bytes from which a conversation goes on in a further part.
PART_BYTES = 1 << 20

_ESCAPE = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ESCAPED_BYTES = re.compile(rb"<\\(\\*)\|")


def escape(text: str) -> str:
    """A text in which no control string can stand."""
    return _ESCAPE.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _unescaped(raw: bytes) -> bytes:
    return _ESCAPED_BYTES.sub(rb"<\1|", raw)


def render(turns: list[tuple[str, str]], trained: tuple[str, ...] = TRAINED) -> tuple[str, list[tuple[int, int]]]:
    """The text of turns (role, text), and the byte spans in it of the texts that are trained on."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        begin = at + len(head.encode("utf-8", "surrogatepass"))
        end = begin + len(body.encode("utf-8", "surrogatepass"))
        if role in trained:
            spans.append((begin, end))
        parts += (head, body, END)
        at = end + len(END)
    return "".join(parts), spans


def loss_mask(sizes: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For tokens of these byte lengths, 1 where a token has a byte of a span; spans are in order and apart."""
    ends = np.cumsum(sizes)
    mark = np.zeros(len(sizes) + 1, np.int8)
    if spans:
        begin, end = np.array(spans, np.int64).T
        first = np.searchsorted(ends, begin, "right")
        last = np.maximum(first, np.searchsorted(ends - sizes, end, "left"))
        # an empty text has no token; two texts never share one, as control tokens part them
        np.add.at(mark, first, 1)
        np.add.at(mark, last, -1)
    return np.cumsum(mark[:-1], dtype=np.int8)


def encode(turns: list[tuple[str, str]], vocab: ByteTokens, trained: tuple[str, ...] = TRAINED) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids, mask and the number of characters of turns."""
    text, spans = render(turns, trained)
    ids = np.array(vocab.ids(text), np.int32)
    return ids, loss_mask(vocab.size[ids], spans), len(text)


class NotFormatted(ValueError):
    """Ids that are not what the template gives."""


def read_back(ids: np.ndarray, mask: np.ndarray, vocab: ByteTokens) -> tuple[list[tuple[bytes, bytes]], list[bytes], int]:
    """The turns that ids stand for, the texts under the mask, each unescaped, and the number of characters."""
    raw = vocab.raw(ids.tolist())
    at = np.concatenate([[0], np.cumsum(vocab.size[ids])])
    start, sep, end = (np.flatnonzero(ids == vocab.controls[c]) for c in CONTROLS)
    if not len(start) == len(sep) == len(end) or len(ids) and not (start[0] == 0 and (start[1:] == end[:-1] + 1).all() and end[-1] == len(ids) - 1 and (start < sep).all() and (sep < end).all()):
        raise NotFormatted("control tokens out of order")
    turns = [(_unescaped(raw[a:b]), _unescaped(raw[c:d])) for a, b, c, d in zip(at[start + 1].tolist(), at[sep].tolist(), at[sep + 1].tolist(), at[end].tolist())]
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    under = [_unescaped(raw[a:b]) for a, b in zip(at[np.flatnonzero(edge == 1)].tolist(), at[np.flatnonzero(edge == -1)].tolist())]
    return turns, under, _chars(raw)


def _chars(raw: bytes) -> int:
    """Code points of UTF-8."""
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def _parts(rows: Iterator[tuple], size: int) -> Iterator[tuple[int | None, bool, list[tuple[str, str]]]]:
    """Sorted rows (conv_id, role, text) as (conv_id, whole, turns); what may go on in another task or part is not whole."""
    now, held, n, first, cut = None, [], 0, True, False
    for conv, role, text in rows:
        if held and conv != now:
            yield now, not (first or cut), held
            held, n, first, cut = [], 0, False, False
        elif held and n >= size:
            yield now, False, held
            held, n, cut = [], 0, True
        now = conv
        held.append((role, text))
        n += len(role) + len(text)
    if held:
        yield now, False, held


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else [], kind))


def format(conversations: DataFrame, path: str | None = None, trained: tuple[str, ...] = TRAINED, part_bytes: int = PART_BYTES) -> DataFrame:
    """Token ids and loss mask: one row a conversation, or a part of one, with its turns and characters."""
    bounded(ship(conversations.sparkSession))
    path = path or place("byte_bpe_50k.json")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"), F.md5(text).alias("digest"), F.monotonically_increasing_id().alias("row"))
    keys = ("conv_id", "turn", "role", "digest", "row")
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "role", "text")

    def batch(held: list[tuple]) -> pa.RecordBatch:
        conv, part, whole, turns, chars, ids, mask = zip(*held)
        return pa.RecordBatch.from_arrays(
            [pa.array(conv, pa.int64()), pa.array(part, pa.int64()), pa.array(whole, pa.bool_()), pa.array(turns, pa.int64()), pa.array(chars, pa.int64()), _lists(list(ids), pa.int32()), _lists(list(mask), pa.int8())],
            names=["conv_id", "part", "whole", "n_turns", "n_chars", "ids", "loss_mask"],
        )

    def run(batches):
        vocab, base = byte_tokens(path, CONTROLS), TaskContext.get().partitionId() << 32
        held, n = [], 0
        sorted_rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3))))
        for k, (conv, whole, turns) in enumerate(_parts(sorted_rows, part_bytes)):
            ids, mask, chars = encode(turns, vocab, trained)
            held.append((conv, base + k, whole, len(turns), chars, ids, mask))
            n += len(ids)
            if n > 500_000:
                yield batch(held)
                held, n = [], 0
        if held:
            yield batch(held)

    return rows.mapInArrow(lambda batches: returned(run(batches)), "conv_id long, part long, whole boolean, n_turns long, n_chars long, ids array<int>, loss_mask array<tinyint>")


_PARTIAL = "conv_id long, part long, n_turns long, formatted_chars long, loss_chars long, turns_hash binary, loss_hash binary, turns_bytes binary, loss_bytes binary"


def digest(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """One row a conversation, read back from ids and mask: counts and hashes of its turns and of all text under the mask."""
    bounded(ship(formatted.sparkSession))
    path = path or place("byte_bpe_50k.json")

    def read(batches):
        vocab = byte_tokens(path, CONTROLS)
        for b in batches:
            out = []
            ids, mask = b.column(3), b.column(4)
            for k, (conv, part, whole) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)))):
                turns, under, chars = read_back(ids[k].values.to_numpy(zero_copy_only=False), mask[k].values.to_numpy(zero_copy_only=False), vocab)
                all_turns, loss = b"".join(x for role, text in turns for x in (role, b"\n", text, b"\n")), b"".join(under)
                hashes = (hashlib.sha256(all_turns).digest(), hashlib.sha256(loss).digest(), None, None) if whole else (None, None, all_turns, loss)
                out.append((conv, part, len(turns), chars, _chars(loss), *hashes))
            cols = zip(*out) if out else ((),) * 9
            kinds = [pa.int64()] * 5 + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[c.split()[0] for c in _PARTIAL.split(", ")])

    def join(batches):
        done, now = [], None

        def close():
            conv, turns, chars, loss_chars, h, g = now
            done.append((conv, turns, chars, loss_chars, h if isinstance(h, bytes) else h.digest(), g if isinstance(g, bytes) else g.digest()))

        def flush():
            conv, turns, chars, loss_chars, h, g = zip(*done)
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(conv, pa.int64()), pa.array(turns, pa.int64()), pa.array([x.hex() for x in h], pa.string()), pa.array(loss_chars, pa.int64()), pa.array([x.hex() for x in g], pa.string()), pa.array(chars, pa.int64())],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        for b in batches:
            for conv, _, turns, chars, loss_chars, h, g, raw, loss in zip(*(c.to_pylist() for c in b.columns)):
                if now is not None and (now[0] != conv or h is not None):
                    close()
                    now = None
                if h is not None:
                    now = [conv, turns, chars, loss_chars, h, g]
                    continue
                if now is None:
                    now = [conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()]
                now[1] += turns
                now[2] += chars
                now[3] += loss_chars
                now[4].update(raw)
                now[5].update(loss)
            if len(done) > 2_000:
                yield flush()
        if now is not None:
            close()
        if done:
            yield flush()

    parts = formatted.select("conv_id", "part", "whole", "ids", "loss_mask").mapInArrow(lambda batches: returned(read(batches)), _PARTIAL)
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(lambda batches: returned(join(batches)), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
