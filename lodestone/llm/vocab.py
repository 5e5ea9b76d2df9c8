"""Places of vocabulary files, and pre-token tables shared by the tokenizing operators."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable


def place(name: str, folder: str | None = None) -> str:
    """The path of a vocabulary file: in the folder given, else where public_tokenizers has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \xa0"
#: Characters for which Python's tables and the libraries' tables are known to agree.
_PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-įı-ɏ]")
#: The byte-level pattern that splits before the merges, over plain characters.
BYTE_LEVEL = re.compile(f" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: The pattern of the vocabulary with word ends; its matches are kept, all else is dropped.
WORD_END = re.compile(f"[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_N}]|[^{_S}{_L}{_N}]+")


def plain(text: str) -> bool:
    """Whether the patterns above split this text exactly as the libraries do."""
    return _PLAIN.search(text) is None and "<|" not in text


def byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_CHARS = byte_chars()


def as_chars(piece: str) -> str:
    """A pre-token in the characters of a byte-level vocabulary."""
    return piece.encode().decode("latin-1").translate(_CHARS)


#: Pre-tokens beyond so many characters are not kept, so that a table's size is bounded.
LONGEST = 64


class Pieces(dict):
    """What a function gives for each distinct pre-token, kept for the worker's life within a bound.

    Beyond the bound the entries become the older generation, and what that held
    is forgotten unless it is asked for again meanwhile.
    """

    def __init__(self, make: Callable[[str], object], bound: int = 200_000):
        super().__init__()
        self.make, self.bound, self.old = make, bound, {}

    def __missing__(self, piece: str):
        if len(piece) > LONGEST:
            return self.make(piece)
        got = self.old.pop(piece, None)
        self[piece] = got = self.make(piece) if got is None else got
        return got

    def trim(self) -> None:
        """Called between texts."""
        if len(self) > self.bound:
            self.old = dict(self)
            self.clear()


def slices(texts: list[str | None], limit: int = 2_000_000) -> Iterable[tuple[int, int]]:
    """Runs of rows of about so many characters; a longer text is a run of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
