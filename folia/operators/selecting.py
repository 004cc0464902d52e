"""Selection of documents for an answer where a case may have any number of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions.rules import DEADLINE_WORDS, ESSENTIAL, RESOLUTION_WORDS, TYPE_WORDS
from folia.functions.selection import BUDGET, LONGEST, RECENT
from folia.operators.budget import CHUNK, greedy_from
from folia.operators.ranks import ranked
from folia.sources.folders import stored


def _tells(words: tuple[str, ...], *fields: str) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(f), F.lit(w)), F.lit(False)) for f in fields for w in words))


def select_spread(docs: DataFrame, priority: list[str] | None, procedure: str | None, budget: int = BUDGET, changed: list[str] = (), deadline: bool = False, chunk: int = CHUNK) -> DataFrame:
    """As ``selection.select`` takes and gives, a case spread over tasks: each phase is a greedy pass over its candidates with what former phases left of the budget.

    A document that didn't fit fits in no later phase, as budgets only fall, so a phase may ask for it again; only the
    essential and the recent ones depend on what is taken, and these are one document a kind, and five, of a case.
    """
    text = F.col("text")
    low = F.lower(F.coalesce("origin" if "origin" in docs.columns else F.lit(None).cast("string"), "document_type", F.lit("")))
    for c in ("filename", "procedure", "reference"):
        docs = docs if c in docs.columns else docs.withColumn(c, F.lit(None).cast("string"))
    n = F.length(text).cast("long")
    light = docs.select("case_id", "doc_id", "created_at", low.alias("origin"), F.ceil(F.least(n, F.lit(LONGEST)) / 4).cast("long").alias("tokens"), "document_type", "filename", "procedure", "reference")
    light = stored(light.where((F.col("tokens") > 0) & (F.col("tokens") <= budget)), "candidates")
    oldest, newest = [F.col("created_at"), F.col("doc_id")], [-F.col("created_at"), F.col("doc_id")]
    resolutions = _tells(RESOLUTION_WORDS, "document_type", "procedure")
    plan: list[tuple[str, list[Column], Column, int | None]] = []
    if changed:
        plan.append(("changed", newest, F.col("origin").isin(list(changed)), None))
    if deadline:
        plan.append(("deadline", newest, _tells(DEADLINE_WORDS, "document_type", "procedure"), None))
    plan.append(("priority", oldest, F.lit(True) if priority is None else F.col("origin").isin(list(priority)), None))
    for kind in ESSENTIAL.get(procedure or "", ESSENTIAL["ordinario"]):
        plan.append(("essential", oldest, _tells(TYPE_WORDS.get(kind, (kind,)), "document_type", "filename", "procedure", "reference"), 1))
    if not deadline:
        plan.append(("recent", newest, resolutions, RECENT))
    plan.append(("fill", newest, F.lit(True), None))
    budgets = light.select("case_id").distinct().withColumn("left", F.lit(budget).cast("long"))
    parts: list[DataFrame] = []
    for number, (phase, order, wanted, most) in enumerate(plan):
        asked = light.where(wanted)
        for part in parts:
            asked = asked.join(part.select("case_id", "doc_id"), ["case_id", "doc_id"], "left_anti")
        if most is not None:
            keyed = asked.select("*", order[0].alias("first"), order[1].alias("second"))
            asked = ranked(keyed, "turn", ["case_id"], ["first", "second"]).where(F.col("turn") <= most)
        taken, left = greedy_from(asked, budgets, "case_id", order, "tokens", ["case_id", "doc_id"], chunk)
        parts.append(stored(taken.select("*", F.lit(phase).alias("phase"), F.lit(number).alias("phase_no")), "phase"))
        budgets = stored(left, "budgets")
    whole = reduce(DataFrame.unionByName, [p.withColumnRenamed("ctx_pos", "own_pos") for p in parts])
    return ranked(whole, "ctx_pos", ["case_id"], ["phase_no", "own_pos"]).select("case_id", (F.col("ctx_pos") - 1).cast("int").alias("ctx_pos"), "phase", "doc_id")
