"""Maps of edits: what cleaning takes out of a text, where that stood in the raw text, and the way back."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions import normalise

EDIT = "struct<kind:string,at:int,content:string,raw_start:int,raw_stop:int>"
#: Characters of texts that a task has in hand at a time, beside its longest one.
RUN = 4 << 20


@lru_cache(1)
def _removals() -> list[tuple[str, regex.Pattern]]:
    return [(kind, regex.compile(pattern)) for kind, pattern in normalise.REMOVALS]


@lru_cache(1)
def _page_end() -> regex.Pattern:
    """A whole page break: a signature that may come before the marker and a repeated rol that may follow it."""
    return regex.compile(f"(?i)(?:{normalise.SIGNATURE.replace('(?iu)', '')}\\s*)?{normalise.PAGE_MARKER}(?:\\s*{normalise.REPEATED_ROL})?")


class Pieces:
    """The stretches of the raw text that are left of it, in order."""

    def __init__(self, n: int):
        self.spans = [(0, n)] if n else []
        self._index()

    def _index(self) -> None:
        self.starts = [0, *accumulate(b - a for a, b in self.spans)]

    def raw(self, at: int) -> int:
        """Where the character at a place of what is left stands in the raw text."""
        k = bisect_right(self.starts, at) - 1
        a, _ = self.spans[k]
        return a + at - self.starts[k]

    def left(self, at: int) -> int:
        """How many characters that stood before a place of the raw text are left."""
        k = bisect_right(self.spans, (at, float("inf"))) - 1
        return 0 if k < 0 else self.starts[k] + min(at, self.spans[k][1]) - self.spans[k][0]

    def cut(self, ranges: list[tuple[int, int]]) -> None:
        """Takes out sorted ranges of what is left that don't overlap."""
        out, cuts = [], iter([*ranges, (float("inf"), float("inf"))])
        start, stop = next(cuts)
        for (a, b), at in zip(self.spans, self.starts, strict=False):
            end, now = at + b - a, at
            while now < end:
                if stop <= now:
                    start, stop = next(cuts)
                elif start <= now:
                    now = min(stop, end)
                else:
                    out.append((a + now - at, a + min(start, end) - at))
                    now = min(start, end)
        self.spans = out
        self._index()


def edited(text: str, removals=None) -> tuple[str, list[tuple], Pieces]:
    """What is left of a text, the edits in the order they were made, and where it stood.

    Each kind is looked for in what earlier ones left, so an edit may reach over what is gone
    already: ``at`` is a place of the text without all former edits, ``raw_start`` and ``raw_stop`` are of the raw one.
    """
    pieces, out = Pieces(len(text)), []
    for kind, pattern in removals or _removals():
        found = [m.span() for m in pattern.finditer(text) if m.end() > m.start()]
        if found:
            gone = accumulate((b - a for a, b in found), initial=0)
            out += ((kind, a - before, text[a:b], pieces.raw(a), pieces.raw(b - 1) + 1) for (a, b), before in zip(found, gone, strict=False))
            pieces.cut(found)
            text = "".join(text[a:b] for a, b in zip([0, *(b for _, b in found)], [*(a for a, _ in found), len(text)], strict=True))
    return text, out, pieces


def restored(text: str, edits: list[tuple]) -> str:
    """The raw text, from what is left of it and its edits: the last edit is undone first."""
    for _, at, content, *_ in reversed(edits):
        text = text[:at] + content + text[at:]
    return text


def annotated(text: str, edits: list[tuple]) -> str:
    """A raw text with marks around each edit, put in from the last to the first; of edits at one place the widest is outermost."""
    marks = [(stop, 0, -start, f"««/{kind}»»") for kind, _, _, start, stop in edits] + [(start, 1, -stop, f"««{kind}»»") for kind, _, _, start, stop in edits]
    for at, _, _, mark in sorted(marks, reverse=True):
        text = text[:at] + mark + text[at:]
    return text


def page_starts(text: str) -> list[int]:
    """Where pages begin in a raw text: at 0 and after each page break that something follows."""
    return [0, *(m.end() for m in _page_end().finditer(text) if m.end() < len(text))]


def mapped(docs: DataFrame, marks: bool = False) -> DataFrame:
    """(doc_id, clean, edits, pages, clean_pages) of whole texts, with ``marks`` also the annotated text.

    ``pages`` are places of the raw text, ``clean_pages`` how many characters of the clean one lie before them.  A null
    text counts as an empty one, which has one page and no edits; repeated rows stay.
    """
    schema = f"doc_id long, clean string, edits array<{EDIT}>, pages array<int>, clean_pages array<int>, marked string"

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                text = text or ""
                clean, edits, pieces = edited(text)
                pages = page_starts(text)
                rows.append((doc_id, clean, edits, pages, [pieces.left(p) for p in pages], annotated(text, edits) if marks else None))
                size += len(text)
                if size >= RUN:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    out = docs.select("doc_id", "text").mapInPandas(make, schema)
    return out if marks else out.drop("marked")


def page_of(offset: Column, pages: Column) -> Column:
    """The page, from 1, that a place is on: the number of pages that begin at it or before; null for a text of one page."""
    return F.when(F.size(pages) > 1, F.size(F.filter(pages, lambda p: p <= offset)))
