"""HTML to text with heading marks, by one pass of regular expressions over the tags.

``html_to_text`` is exact for broken HTML too; ``html_to_text_native`` is a chain
of SQL functions that gives the same on well-formed pages and stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.constants import BLOCK_TAGS, HEADING_LEVELS, TAG_SCAN
from lodestone.functions.text import decode_entities, tidy_blank_lines
from lodestone.memory import returned

_OPEN = re.compile("<(?=[A-Za-z/!])")
#: A tag whose quoted values may hold ">"; a quote in which another tag seems to begin was never closed.
_TAG = re.compile(r"""<(?:[^"'>]|"(?:[^"<]|<(?![A-Za-z/!]))*+"|'(?:[^'<]|<(?![A-Za-z/!]))*+')*+>""")
_ANGLE = re.compile("[<>]")
_RAW = re.compile("<(script|style)", re.I | re.A)
_NAME = re.compile("</*([A-Za-z0-9]*)")
_WHITE = re.compile(r"\s*")


def _tag_end(html: str, at: int) -> int | None:
    """Where the tag that begins here ends, if it does so within the scan bound."""
    m = _TAG.match(html, at, at + 1 + TAG_SCAN)
    return m.end() if m else None


def _recover(html: str, at: int) -> tuple[int | None, bool]:
    """Where to go on after a tag without an end: behind the next ">" or at the next "<"; whether it was closed."""
    m = _ANGLE.search(html, at + 1)
    if m is None:
        return None, False
    return (m.end(), True) if m.group() == ">" else (m.start(), False)


def html_to_text(html: str | None) -> str | None:
    """A page's text: scripts, styles, comments and tags out, headings marked, entities decoded."""
    if html is None:
        return None
    out: list[str] = []
    at, size, after_heading = 0, len(html), False

    def say(text: str) -> None:
        nonlocal after_heading
        if after_heading:
            text = text[_WHITE.match(text).end() :]
            if not text:
                return
            after_heading = False
        out.append(text)

    while at < size:
        m = _OPEN.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.start()
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        raw = _RAW.match(html, at)
        end = _tag_end(html, at)
        if raw:
            if end is None:
                end, closed = _recover(html, at)
                if end is None:
                    break
                if not closed:
                    at = end
                    continue
            close = re.compile(f"</{raw.group(1)}", re.I | re.A).search(html, end)
            stop = _tag_end(html, close.start()) if close else None
            at = size if stop is None else stop
            continue
        if end is None:
            end, _ = _recover(html, at)
            if end is None:
                out.append("<")
                end = at + 1
            at = end
            continue
        closing = html.startswith("</", at)
        name = _NAME.match(html, at).group(1).lower()
        if name in HEADING_LEVELS:
            out.append("\n" if closing else "\n" + "#" * HEADING_LEVELS[name] + " ")
            after_heading = after_heading or not closing
        elif name in BLOCK_TAGS and (closing or name == "br"):
            out.append("\n")
        at = end
    text = "".join(out).replace("¶", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = text.replace(a, b)
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return re.sub("\n{3,}", "\n\n", "\n".join(p.rstrip() for p in parts))


@F.pandas_udf(StringType())
def html_to_text_udf(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The same for a column; sessions that use it bound their batches (``memory.bounded``)."""
    yield from returned(p.map(html_to_text, na_action="ignore") for p in pages)


def html_to_text_native(html: Column) -> Column:
    """The same for well-formed pages, in SQL functions only."""
    blocks = "|".join(t for t in BLOCK_TAGS if t not in HEADING_LEVELS)
    x = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    x = F.regexp_replace(x, r"(?is)<(script|style)\b.*?</\1[^>]*>", "")
    for level in (1, 2, 3):
        x = F.regexp_replace(x, rf"(?i)<h{level}(\s[^>]*)?>\s*", "\n" + "#" * level + " ")
    x = F.regexp_replace(x, r"(?i)<h[456](\s[^>]*)?>\s*", "\n#### ")
    x = F.regexp_replace(x, rf"(?i)</(h[1-6]|{blocks})(\s[^>]*)?>|<br\s*/?>", "\n")
    x = F.regexp_replace(x, r"<[A-Za-z/!][^>]*>", "")
    x = tidy_blank_lines(decode_entities(x))
    return F.regexp_replace(x, r"\n\z", "")


def heading_levels(html: Column) -> Column:
    """The levels of a page's headings, in order; those below the fourth count as the fourth."""
    names = F.regexp_extract_all(html, F.lit(r"(?i)<(h[1-6])(?:\s[^>]*)?>"), F.lit(1))
    levels = F.create_map(*[F.lit(x) for kv in HEADING_LEVELS.items() for x in kv])
    return F.transform(names, lambda n: F.try_element_at(levels, F.lower(n)))
