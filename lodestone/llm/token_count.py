"""Token counts by overlap resynchronisation.

A text up to ``chunk`` bytes is encoded as it is. A longer one is cut into chunks
that overlap; each chunk is encoded by itself, its tokens' lengths giving their
offsets in the text, and two neighbours are spliced at a common boundary that is
proven stable: in both a token ends there and the same token follows.

Why that is enough: a sequence of tokens is the encoding of a pre-token just if
any two neighbours in it can stand side by side (merges would leave them apart).
All neighbours on the left of the splice come from the left chunk, all on the
right from the right one, and the pair at the splice stands in the left chunk as
well, as the same token follows there. Pre-tokens are runs of one kind of
character, so where a boundary lies within one, it ends at the same place for
both chunks. This holds for every script, and within words without any space.
The tokens after the splice up to the end of the left chunk, its last few left
out, are compared too. Where no boundary passes, the overlap is doubled, at last
to the whole left chunk; a next chunk always begins at a boundary of the last
one, so that even a word of millions of equal letters resynchronises. A chunk
never ends within a special string or a character.

A chunk's pre-tokens come from the library's own splitter, or from an expression
that is known to agree with it where all characters are Latin; each distinct
short one is encoded by the library's model once in a worker. Memory follows the
chunk: of a long text only its bytes and a few chunks' tokens are held.

The splice is proven for byte-level vocabularies with the usual splitter and
without a normaliser; texts for other vocabularies are encoded whole.

Cases: a null text is empty and has no tokens; repeated rows are counted again,
and ties do not matter, as each row is counted by itself; special strings in a
text count as the library's default has them; a very long text is counted chunk
by chunk; an empty table gives no rows; columns beyond doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.memory import bounded, returned
from lodestone.llm.vocab import BYTE_LEVEL, Pieces, as_chars, place, plain
from lodestone.session import ship

#: Bytes of a chunk, and of the overlap that is tried first.
CHUNK = 4_096
OVERLAP = 256
LIMIT = 512
#: Tokens at the end of a chunk that are not trusted, as the cut may have changed them.
_UNSURE = 4
_COUNTERS: dict[str, "Counter"] = {}


class Counter:
    """Counts tokens as one vocabulary's library does."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splitter = spec.get("pre_tokenizer") or {}
        self.level = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space") and not spec.get("normalizer") and spec["model"].get("type") == "BPE"
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.level = self.level and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
        self.longest = max((len(s.encode()) for s in self.special), default=0)
        vocab = spec["model"]["vocab"]
        self.size = np.zeros(self.lib.get_vocab_size(), np.int64)
        if self.level:
            for s, i in vocab.items():
                self.size[i] = len(s)  # a character of the vocabulary stands for a byte
            for t in spec["added_tokens"]:
                self.size[t["id"]] = len(t["content"].encode())
        model = self.lib.model
        self.pieces = Pieces(lambda piece: tuple(t.id for t in model.tokenize(as_chars(piece))))
        self.splices = 0

    def ids(self, text: str) -> list[int]:
        """The ids of a text that is encoded as one."""
        if not self.level or any(s in text for s in self.special):
            return self.lib.encode(text, add_special_tokens=False).ids
        if plain(text):
            words = BYTE_LEVEL.findall(text)
        else:
            words = [text[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(text)]
        return list(chain.from_iterable(map(self.pieces.__getitem__, words)))

    def _end(self, raw: bytes, end: int) -> int:
        """A place at or before this one that is not within a character or a special string."""
        if end >= len(raw):
            return len(raw)
        while raw[end] & 0xC0 == 0x80:
            end -= 1
        for s in self.special:
            b = s.encode()
            at = raw.find(b, max(0, end - len(b) + 1), end + len(b) - 1)
            if 0 <= at < end < at + len(b):
                end = at
        return end

    def _tokens(self, raw: bytes, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """A chunk's ids and the places where they begin in the text, with the end."""
        ids = np.array(self.ids(raw[begin:end].decode("utf-8", "surrogatepass")), np.int64)
        return ids, begin + np.concatenate([[0], np.cumsum(self.size[ids])])

    def spliced(self, raw: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """The count of a text, as UTF-8, by encoding overlapping chunks."""
        total = start = 0
        stop = self._end(raw, chunk) or min(len(raw), chunk + self.longest)
        ids, at = self._tokens(raw, start, stop)
        while stop < len(raw):
            width, found = overlap, None
            while found is None:
                # a boundary of the left chunk that is not within a character
                i = int(np.searchsorted(at, max(start, stop - width), "right")) - 1
                while i > 0 and raw[at[i]] & 0xC0 == 0x80:
                    i -= 1
                begin = int(at[i])
                end = self._end(raw, stop + chunk - min(chunk // 2, stop - begin))
                if end <= stop:
                    end = self._end(raw, stop + chunk + self.longest)
                ids2, at2 = self._tokens(raw, begin, end)
                found = self._boundary(raw, ids, at, ids2, at2)
                if found is None:
                    if begin == start:  # nothing in the whole left chunk is stable: take it and the next one as one
                        ids, at, stop = ids2, at2, end
                        break
                    width *= 2
            if found is None:
                continue
            i, j = found
            self.splices += 1
            total += i
            ids, at = ids2[j:], at2[j:]
            start, stop = int(at[0]), end
        return total + len(ids)

    @staticmethod
    def _boundary(raw: bytes, ids: np.ndarray, at: np.ndarray, ids2: np.ndarray, at2: np.ndarray) -> tuple[int, int] | None:
        """The first common boundary (its token in either chunk) from which the chunks agree to where the left one is sure."""
        sure = len(ids) - _UNSURE
        if sure <= 0:
            return None
        low = int(np.searchsorted(at, at2[0]))
        _, i, j = np.intersect1d(at[low:sure], at2[:-1], assume_unique=True, return_indices=True)
        i = i + low
        same = ids[i] == ids2[j]
        for k in np.flatnonzero(same & (at[i] > at2[0])).tolist():
            if raw[at[i[k]]] & 0xC0 == 0x80:  # within a character
                continue
            n = min(sure - i[k], len(ids2) - j[k])
            if (ids[i[k] : i[k] + n] == ids2[j[k] : j[k] + n]).all():
                return int(i[k]), int(j[k])
        return None

    def counts(self, texts: list[str | None], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        out = [0] * len(texts)
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.level or len(t) * 4 <= chunk:
                out[i] = len(self.ids(t))
            else:
                raw = t.encode("utf-8", "surrogatepass")
                out[i] = self.spliced(raw, chunk, overlap) if len(raw) > chunk else len(self.ids(t))
            self.pieces.trim()
        return out


def counter(path: str) -> Counter:
    """The worker's counter for a vocabulary file, loaded once."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row a document: its UTF-8 bytes, its tokens, and whether these are over the limit."""
    bounded(ship(docs.sparkSession))
    path = path or place("byte_bpe_50k.json")

    def run(batches):
        c = counter(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = c.counts(texts, chunk, overlap)
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(lambda batches: returned(run(batches)), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
