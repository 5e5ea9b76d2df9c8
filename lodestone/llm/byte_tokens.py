"""Ids of a byte-level vocabulary with the bytes of every token, and control strings as ids of their own."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import numpy as np

from lodestone.llm.vocab import byte_chars

_HELD: dict[tuple, "ByteTokens"] = {}


class NotByteLevel(ValueError):
    """A vocabulary file of another kind."""


class ByteTokens:
    """A byte-level vocabulary whose tokens' byte lengths add up to the text's.

    The vocabulary's own special strings are plain text here. Control strings
    given become single tokens, numbered after the vocabulary in their order; a
    text is cut at them before anything else, so no other token reaches over one.
    """

    def __init__(self, path: str, controls: tuple[str, ...] = ()):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splitter = spec.get("pre_tokenizer") or {}
        if splitter.get("type") != "ByteLevel" or not splitter.get("use_regex", True) or spec.get("normalizer") or spec["model"].get("type") != "BPE":
            raise NotByteLevel(path)
        byte_of = {c: b for b, c in byte_chars().items()}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        first = 1 + max(max(ranks.values()), *(t["id"] for t in spec["added_tokens"]), 0)
        self.controls = {s: first + k for k, s in enumerate(controls)}
        self.bytes_of: list[bytes] = [b""] * (first + len(controls))
        for raw, i in [*ranks.items(), *((s.encode(), i) for s, i in self.controls.items())]:
            self.bytes_of[i] = raw
        self.size = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self._own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.controls)
        self._at = re.compile("(" + "|".join(map(re.escape, controls)) + ")") if controls else None
        self._path, self._lib = path, None

    def ids(self, text: str) -> list[int]:
        """The ids of a text."""
        try:
            return self._own.encode(text, allowed_special="all") if self.controls else self._own.encode_ordinary(text)
        except ValueError:  # its splitter gives up on millions of spaces in a row; the other library's does not
            parts = self._at.split(text) if self._at else [text]
            return [i for p in parts for i in ([self.controls[p]] if p in self.controls else self._library().encode(p, add_special_tokens=False).ids)]

    def _library(self):
        if self._lib is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._lib = Tokenizer.from_file(self._path)
            self._lib.no_truncation()
            self._lib.no_padding()
            self._lib.encode_special_tokens = True
        return self._lib

    def raw(self, ids: Iterable[int]) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def byte_tokens(path: str, controls: tuple[str, ...] = ()) -> ByteTokens:
    """The worker's vocabulary, loaded once."""
    key = path, controls
    if key not in _HELD:
        _HELD[key] = ByteTokens(path, controls)
    return _HELD[key]
