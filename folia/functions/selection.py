"""Selection of documents for an answer: phases in order, within a budget of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.functions.rules import DEADLINE_WORDS, ESSENTIAL, RESOLUTION_WORDS, TYPE_WORDS

# Budget in tokens of four characters, characters of a document, and recent resolutions.
BUDGET, LONGEST, RECENT = 500_000, 80_000, 5


def _low(doc: dict, *names: str) -> list[str]:
    return [str(doc[n]).lower() for n in names if isinstance(doc.get(n), str)]


def _tells(words: tuple[str, ...], texts: list[str]) -> bool:
    return any(w in t for w in words for t in texts)


def phases(docs: list[dict], priority: list[str] | None, essential: list[str], changed: list[str] = (), deadline: bool = False, recent: int = RECENT) -> Iterator[tuple[str, dict]]:
    """Candidates in order: documents that changes touch, in a question of deadlines all that set one, those of
    the origins asked for (None: all), the first unused of each essential kind, recent resolutions, all others.

    A phase sees what earlier ones took (``taken`` is set on a document), so the order of requests
    can't be made beforehand.  A document's origin is its type where it has none.
    """
    newest = sorted(docs, key=lambda x: -x["created_at"])
    origin = lambda x: next(iter(_low(x, "origin", "document_type")), "")
    yield from (("changed", x) for x in newest if origin(x) in changed)
    if deadline:
        yield from (("deadline", x) for x in newest if _tells(DEADLINE_WORDS, _low(x, "document_type", "procedure")))
    yield from (("priority", x) for x in docs if priority is None or origin(x) in priority)
    for kind in essential:
        words = TYPE_WORDS.get(kind, (kind,))
        first = next((x for x in docs if not x.get("taken") and _tells(words, _low(x, "document_type", "filename", "procedure", "reference"))), None)
        if first is not None:
            yield "essential", first
    if not deadline:
        left = [x for x in newest if not x.get("taken") and _tells(RESOLUTION_WORDS, _low(x, "document_type", "procedure"))]
        yield from (("recent", x) for x in left[:recent])
    yield from (("fill", x) for x in newest if not x.get("taken"))


def choose(docs: list[dict], priority: list[str] | None, essential: list[str], budget: int = BUDGET, changed: list[str] = (), deadline: bool = False) -> list[tuple[int, str, dict]]:
    """(place, phase, document) of those taken; one that doesn't fit is passed over, and may be asked for again."""
    out = []
    for phase, x in phases(docs, priority, essential, changed, deadline):
        tokens = -(-min(x["n"], LONGEST) // 4)
        if x.get("taken") or not x["n"] or tokens > budget:
            continue
        x["taken"] = True
        budget -= tokens
        out.append((len(out), phase, x))
    return out


def select(docs: DataFrame, priority: list[str] | None, procedure: str | None, budget: int = BUDGET, changed: list[str] = (), deadline: bool = False) -> DataFrame:
    """(case_id, ctx_pos, phase, doc_id): what is taken for each case, its procedure's essential documents among it.

    ``docs`` has case_id, doc_id, document_type, created_at (a number), text, and any of origin, filename, procedure
    and reference.  Only those and lengths are gathered, never texts, and of a case only documents that may fit.
    """
    known = [c for c in ("origin", "filename", "procedure", "reference") if c in docs.columns]
    n = F.length("text").cast("long")
    light = docs.select("case_id", "doc_id", "document_type", "created_at", *known, n.alias("n")).where((F.col("n") > 0) & (F.ceil(F.least("n", F.lit(LONGEST)) / 4) <= budget))
    essential = list(ESSENTIAL.get(procedure or "", ESSENTIAL["ordinario"]))

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values(["created_at", "doc_id"], ascending=[True, True])
        taken = choose(own.to_dict("records"), priority, essential, budget, changed, deadline)
        return pd.DataFrame([(x["case_id"], k, phase, x["doc_id"]) for k, phase, x in taken], columns=["case_id", "ctx_pos", "phase", "doc_id"])

    return light.groupBy("case_id").applyInPandas(pick, "case_id string, ctx_pos int, phase string, doc_id long")
