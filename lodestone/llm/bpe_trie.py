"""Byte-pair encoding by traversal of a prefix-sharing trie, and decoding.

For byte-pair merges, the encoding of a word's prefix is the encoding of a
shorter prefix followed by one last token, and just one token that ends there
fits: the one that the tokens before it do not merge into. So the state of a
trie node is the last token of its prefix, and a word's ids are read off by
walking back from its end, token by token.

The distinct pre-tokens of a slice of texts that are not yet known are put into
a trie, stored as its depth-first sequence: the sorted words, each with the
depth that it shares with the one before. The traversal keeps the states of the
path to the present node, steps back to the shared depth and goes on from
there; a prefix that many words share is encoded once.

Whether two tokens may stand side by side is decided from the merges alone: the
pair is taken apart in the reverse order of merging, and no merge across the
border may come before those that made the two.

Cases: a null text is empty (no tokens, the hash of nothing); repeated rows are
encoded again, and ties do not matter, as each row is encoded by itself; a very
long text takes memory in proportion to its length, a very long word as well, and
no time beyond its length; special strings in a text become the vocabulary's
special id and decode to themselves; an empty table gives no rows; further
columns are kept by ``encode``, ``decode`` and ``round_trip``, whose own column takes the place of
one of the same name (``ids``, ``decoded``), and ignored by ``encode_digest``.
"""

from __future__ import annotations

import hashlib
import json
import os
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.vocab import _PLAIN, BYTE_LEVEL, LONGEST, byte_chars, place, slices
from lodestone.llm.memory import bounded, returned
from lodestone.session import ship

_CODECS: dict[str, "TrieCodec"] = {}


class TrieCodec:
    """A byte-level vocabulary with its merges: encodes by trie, decodes by table."""

    def __init__(self, path: str, bound: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in byte_chars().items()}
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items() if all(c in byte_of for c in s)}
        self.bytes_of = raw | {i: s.encode() for s, i in self.special.items()}
        # tokens are numbered by rank here: single bytes first, then merges in their order
        self.ids: list[int] = [vocab[c] for b, c in sorted(byte_chars().items())]
        text = [bytes([b]) for b in range(256)]
        rank = {t: n for n, t in enumerate(text)}
        self.parts: list[tuple[int, int]] = [(n, n) for n in range(256)]
        self.merge: dict[int, int] = {}
        for pair in merges:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = rank[bytes(byte_of[c] for c in a)], rank[bytes(byte_of[c] for c in b)]
            whole = text[x] + text[y]
            if whole not in rank:
                rank[whole] = len(text)
                text.append(whole)
                self.parts.append((x, y))
                self.ids.append(vocab[a + b])
            self.merge.setdefault(x << 20 | y, rank[whole])
        self.size = [len(t) for t in text]
        self.longest = max(self.size)
        self.pair: dict[int, bool] = {}
        # tokens by their last bytes, longest match found last
        self.ends: dict = {}
        for n, t in enumerate(text):
            if n < 256 or self._reached(n):
                node = self.ends
                for b in reversed(t):
                    node = node.setdefault(b, {})
                node[-1] = n
        # a token and the byte that makes it another one
        self.grow = {rank[t[:-1]] << 8 | t[-1]: n for n, t in enumerate(text) if len(t) > 1 and t[:-1] in rank and self._reached(n)}
        self.seen: dict[bytes, tuple[int, ...]] = {}
        self.bound = bound
        self.long: list[str] = []
        # of each known pre-token: its ids, these as text, and what they decode to
        self.known: dict[str, tuple[tuple[int, ...], str, bytes]] = {}
        self.old: dict[str, tuple[tuple[int, ...], str, bytes]] = {}
        self._lib = None
        self.path = path

    def _ending(self, tail: bytes) -> tuple[int, ...]:
        """The tokens that end with these bytes, the longest first; -1 before them if a longer text may add some."""
        node, found = self.ends, []
        for b in reversed(tail):
            node = node.get(b)
            if node is None:
                return tuple(reversed(found))
            if -1 in node:
                found.append(node[-1])
        return (-1, *reversed(found)) if any(k != -1 for k in node) else tuple(reversed(found))

    def _reached(self, n: int) -> bool:
        """Whether the bytes of a token are encoded as that token."""
        x, y = self.parts[n]
        return self._fits(x, y, n)

    def _fits(self, a: int, b: int, limit: int = 1 << 30) -> bool:
        """Whether no merge across the border of a and b comes before the limit and their own merges."""
        merge, parts = self.merge, self.parts
        while True:
            across = merge.get(a << 20 | b)
            if across is not None and across < limit:
                return False
            # undo the later of the two merges; merges with a rank below it are still to be looked at
            if a > b:
                limit, (_, a) = a, parts[a]
                if a == limit:
                    limit, (b, _) = b + 1, parts[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, (b, _) = b + 1, parts[b]
                if b + 1 == limit:
                    limit, (_, a) = a, parts[a]
                    if a == limit:
                        return True

    def traverse(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of sorted distinct words, sharing the states of common prefixes."""
        size, ids, pair, fits, grow, seen = self.size, self.ids, self.pair, self._fits, self.grow, self.seen
        longest, out, before, last = self.longest, [], b"", [-1]
        for word in words:
            depth, most = 0, min(len(before), len(word))
            if before[:most] == word[:most]:
                depth = most
            else:
                while before[depth] == word[depth]:
                    depth += 1
            del last[depth + 1 :]
            n = last[depth]
            for i in range(depth, len(word)):
                # most often the last token grows by this byte, or else a shorter one ends here
                grown = grow.get(n << 8 | word[i]) if n >= 0 else word[i]
                if grown is not None:
                    s = last[i + 1 - size[grown]]
                    if s < 0:
                        n = grown
                        last.append(n)
                        continue
                    key = s << 20 | grown
                    good = pair.get(key)
                    if good is None:
                        pair[key] = good = fits(s, grown)
                    if good:
                        n = grown
                        last.append(n)
                        continue
                tail = word[i - 5 : i + 1] if i >= 5 else word[: i + 1]
                found = seen.get(tail)
                if found is None:
                    seen[tail] = found = self._ending(tail)
                if found[0] < 0:  # longer tokens may end here too
                    found = self._ending(word[max(0, i + 1 - longest) : i + 1])
                for n in found:
                    if n < 0:
                        continue
                    s = last[i + 1 - size[n]]
                    if s < 0:
                        break
                    key = s << 20 | n
                    good = pair.get(key)
                    if good is None:
                        pair[key] = good = fits(s, n)
                    if good:
                        break
                last.append(n)
            at, got = len(word), []
            while at:
                n = last[at]
                got.append(ids[n])
                at -= size[n]
            out.append(tuple(reversed(got)))
            before = word
        if len(pair) > 300_000:
            pair.clear()
        if len(seen) > 50_000:
            seen.clear()
        return out

    def table(self, pieces: list[list[str]]) -> dict[str, tuple[tuple[int, ...], str, bytes]]:
        """What is known of every pre-token of a slice; unknown ones go through one trie.

        Pre-tokens beyond ``LONGEST`` characters are forgotten with the next
        slice, so that the table's size is bounded.
        """
        for w in self.long:
            self.known.pop(w, None)
        self.long.clear()
        if len(self.known) > self.bound:
            self.old, self.known = self.known, {}
        want: set[str] = set()
        for words in pieces:
            want.update(words)
        missing = []
        for w in want.difference(self.known):
            got = self.old.get(w)
            if got is None:
                missing.append((w.encode("utf-8", "surrogatepass"), w))
            else:
                self.known[w] = got
        missing.sort()
        raw = self.bytes_of.__getitem__
        for (_, w), got in zip(missing, self.traverse([b for b, _ in missing])):
            self.known[w] = (got, ",".join(map(str, got)), b"".join(map(raw, got)))
            if len(w) > LONGEST:
                self.long.append(w)
        return self.known

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text; a text with characters beyond the plain ones is split by the library."""
        if _PLAIN.search(text) is None:
            return BYTE_LEVEL.findall(text)
        if self._lib is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._lib = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._lib.pre_tokenize_str(text)]

    def sections(self, text: str) -> list[str | int]:
        """The text cut at special strings, these as ids."""
        out: list[str | int] = [text]
        for s, i in self.special.items():
            if s in text:
                cut: list[str | int] = []
                for x in out:
                    if isinstance(x, str):
                        for k, y in enumerate(x.split(s)):
                            cut += ([i] if k else []) + ([y] if y else [])
                    else:
                        cut.append(x)
                out = cut
        return out

    def known_of(self, texts: list[str | None]):
        """For each text what is known of its pre-tokens, in order; special ids come as entries of their own."""
        for a, b in slices(texts, 500_000):
            rows = [[self.split(x) if isinstance(x, str) else x for x in self.sections(t)] if t else [] for t in texts[a:b]]
            get = self.table([x for r in rows for x in r if isinstance(x, list)]).__getitem__
            for r in rows:
                if len(r) == 1 and isinstance(r[0], list):
                    yield list(map(get, r[0]))
                else:
                    yield [e for x in r for e in ([((x,), str(x), self.bytes_of[x])] if isinstance(x, int) else map(get, x))]

    def encode_many(self, texts: list[str | None]) -> list[list[int]]:
        return [list(chain.from_iterable(e[0] for e in row)) for row in self.known_of(texts)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str) -> TrieCodec:
    """The worker's codec for a vocabulary file, built once."""
    if path not in _CODECS:
        _CODECS[path] = TrieCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of docs with an array column ``ids``."""
    bounded(ship(docs.sparkSession))
    path = path or place("byte_bpe_50k.json")
    docs = _packed(docs, "text", "string", ("ids",))
    schema = T.StructType([docs.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        c = codec(path)
        for b in batches:
            ids = c.encode_many(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["row", "ids"])

    return docs.mapInArrow(lambda batches: returned(run(batches)), schema).select("row.*", "ids")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of docs with ``ids`` and, made from these, ``decoded``: both in one worker, which has the vocabulary once."""
    bounded(ship(docs.sparkSession))
    path = path or place("byte_bpe_50k.json")
    docs = _packed(docs, "text", "string", ("ids", "decoded"))
    schema = T.StructType([docs.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches):
        c = codec(path)
        for b in batches:
            ids = c.encode_many(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(c.decode, ids), pa.string())], names=["row", "ids", "decoded"])

    return docs.mapInArrow(lambda batches: returned(run(batches)), schema).select("row.*", "ids", "decoded")


def _packed(rows: DataFrame, column: str, kind: str, own: tuple[str, ...]) -> DataFrame:
    """The columns but the operator's own as one struct, so that their names cannot matter, and the one that is read."""
    rest = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c.lower() not in own])
    return rows.select(rest.alias("row"), F.col(f"`{column}`").cast(kind).alias("read"))


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The rows with a string column ``decoded`` made from their ``ids``."""
    bounded(ship(rows.sparkSession))
    path = path or place("byte_bpe_50k.json")
    rows = _packed(rows, "ids", "array<int>", ("decoded",))
    schema = T.StructType([rows.schema["row"], T.StructField("decoded", T.StringType())])

    def run(batches):
        c = codec(path)
        for b in batches:
            text = [None if x is None else c.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["row", "decoded"])

    return rows.mapInArrow(lambda batches: returned(run(batches)), schema).select("row.*", "decoded")


def encode_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row a document: its count of tokens and the hashes of its ids and of their decoded text."""
    bounded(ship(docs.sparkSession))
    path = path or place("byte_bpe_50k.json")

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            counts, named, back = [], [], []
            for row in c.known_of(texts):
                ids, names, raw = zip(*row) if row else ((), (), ())
                counts.append(sum(map(len, ids)))
                named.append(hashlib.sha256(",".join(names).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join(raw).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(named, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: returned(run(batches)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
