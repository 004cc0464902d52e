"""Greedy selection under a budget, of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions.folds import greedy_within
from folia.operators.ranks import ranked, running
from folia.sources.folders import stored

#: Rows of a group that one task folds at a time.
CHUNK = 10_000


def greedy(items: DataFrame, budget: int, group: str, order: list[str], size: str, chunk: int = CHUNK) -> DataFrame:
    """Rows of ``items`` (group, order, size) taken in ``order`` while they fit, with ctx_pos from 0; what doesn't fit is passed over.

    A null size fits nowhere; sizes are 0 or more.
    """
    budgets = items.select(group).distinct().withColumn("left", F.lit(budget).cast("long"))
    return greedy_from(items, budgets, group, [F.col(c) for c in order], size, [group, *order, size], chunk)[0]


def greedy_from(items: DataFrame, budgets: DataFrame, group: str, order: list[Column], size: str, keep: list[str], chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """``greedy`` with a budget for each group (group, left): the rows taken (``keep`` and ctx_pos), and what is left of the budgets.

    A row taken leaves less of its group's budget for all after it, so rows must be gone through in order; but all
    up to the first that doesn't fit are known from running sums, and after that only what is left of the budget passes
    on.  Groups are cut into chunks of neighbouring rows; in a round, every group folds its next chunk that has
    a row small enough, and chunks without one are never read.  A group without a budget gets nothing.
    """
    given = keep
    columns = [f"keep{k}" for k in range(len(keep))]  # so that no name clashes with one below
    items = items.where(F.col(size).isNotNull()).select(F.col(group).alias("own"), F.col(size).cast("long").alias("size"), *(F.col(c).alias(name) for c, name in zip(given, columns, strict=True)), *_keys(order))
    keys = [c for c in items.columns if c.startswith("by")]
    rows = ranked(items, "place", ["own"], keys).drop(*keys)
    total = budgets.select(F.col(group).alias("g"), F.col("left").cast("long").alias("left"))
    same = F.col("g").eqNullSafe(F.col("own"))
    summed = running(rows, "before", ["own"], ["place"], "size").join(total.withColumnRenamed("left", "most"), same).drop("g")
    summed = stored(summed.withColumn("chunk", F.floor((F.col("place") - 1) / chunk)), "greedy")
    # the first row that doesn't fit ends the prefix
    over = summed.groupBy(F.col("own").alias("g")).agg(F.min(F.when(F.col("before") + F.col("size") > F.col("most"), F.col("place"))).alias("stop"))
    marked = summed.join(over, same).drop("g")
    taken = [stored(marked.where("stop IS NULL OR place < stop").select("own", "size", *columns, "place"), "taken")]
    state = marked.where("place = stop").select(F.col("own").alias("g"), (F.col("most") - F.col("before")).alias("left"), F.col("stop").alias("since"))
    least = stored(summed.groupBy("own", "chunk").agg(F.min("size").alias("least")), "chunks")
    while True:
        # of each group the next chunk with a row that may fit
        state = stored(state, "state")
        first = F.floor(F.col("since") / chunk)  # the chunk of the next row
        ahead = least.join(state, same & (F.col("chunk") >= first) & (F.col("least") <= F.col("left"))).groupBy("g", "left", "since").agg(F.min("chunk").alias("now"))
        ahead = stored(ahead, "ahead")
        if ahead.isEmpty():
            break
        here = summed.join(ahead, same & (F.col("chunk") == F.col("now"))).where((F.col("place") > F.col("since")) & (F.col("size") <= F.col("left")))
        lists = here.groupBy("g", "left", "now").agg(F.array_sort(F.collect_list(F.struct("place", F.col("size").alias("n")))).alias("x"))
        picked = stored(lists.select("g", "left", "now", F.transform(greedy_within(F.col("x.n"), F.col("left")), lambda i: F.get(F.col("x"), i)).alias("y")), "picked")
        places = picked.select("g", F.explode("y").alias("y")).select("g", F.col("y.place").alias("at"))
        taken.append(stored(summed.join(places, same & (F.col("place") == F.col("at"))).select("own", "size", *columns, "place"), "taken"))
        used = picked.select(F.col("g").alias("h"), F.col("now").alias("then"), F.aggregate("y", F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("used"))
        state = ahead.join(used, F.col("g").eqNullSafe(F.col("h")), "left")
        state = state.select("g", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"), ((F.col("now") + 1) * chunk).alias("since"))
    whole = taken[0]
    for more in taken[1:]:
        whole = whole.unionByName(more)
    numbered = ranked(whole, "ctx_pos", ["own"], ["place"])
    spent = whole.groupBy(F.col("own").alias("o")).agg(F.sum("size").alias("spent"))
    after = total.join(spent, F.col("g").eqNullSafe(F.col("o")), "left").select(F.col("g").alias(group), (F.col("left") - F.coalesce("spent", F.lit(0))).alias("left"))
    return numbered.select(*(F.col(c).alias(name) for c, name in zip(columns, given, strict=True)), (F.col("ctx_pos") - 1).alias("ctx_pos")), after


def _keys(order: list[Column]) -> list[Column]:
    """The order's columns under names of their own; a null comes first, as whoever gives a falling order has turned the sign of its values."""
    return [c.alias(f"by{k}") for k, c in enumerate(order)]
