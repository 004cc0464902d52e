"""Order-dependent folds that no window frame expresses, as higher-order functions on a row's array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once a row, however often ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


def greedy_within(items: Column, budget: int | Column) -> Column:
    """Indices (from 0) taken in order from an array of sizes while they fit; what doesn't fit is skipped.

    Unlike a running sum, a later small item may still be taken after a large one was skipped.
    """
    start = F.struct((budget if isinstance(budget, Column) else F.lit(budget)).cast("long").alias("left"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("taken"))

    def step(state: Column, size: Column) -> Column:
        fits = size <= state["left"]
        return F.struct((state["left"] - F.when(fits, size).otherwise(0)).cast("long").alias("left"), (state["at"] + 1).alias("at"), F.when(fits, F.concat(state["taken"], F.array(state["at"]))).otherwise(state["taken"]).alias("taken"))

    return F.aggregate(items, start, step, lambda s: s["taken"])


def admitted(times: Column, limit: int, window: float) -> Column:
    """The admitted ones of a sorted array of seconds: at most ``limit`` in any ``window``; rejected ones don't count."""
    none = F.array().cast("array<double>")
    start = F.struct(none.alias("log"), none.alias("taken"))

    def step(state: Column, t: Column) -> Column:
        recent = F.filter(state["log"], lambda x: x > t - F.lit(window))
        free = F.size(recent) < limit
        return F.struct(F.when(free, F.concat(recent, F.array(t))).otherwise(recent).alias("log"), F.when(free, F.concat(state["taken"], F.array(t))).otherwise(state["taken"]).alias("taken"))

    return F.aggregate(times, start, step, lambda s: s["taken"])


def apart(markers: Column, close: int = 5, same_type: int = 20) -> Column:
    """Markers (at, type, confidence, ...) sorted by place, without those too close to the last one kept.

    Nearer than ``close`` characters, or than ``same_type`` for one of the same type, the more
    confident of the two stays; on a tie the earlier one.
    """

    def step(kept: Column, m: Column) -> Column:
        last = F.element_at(kept, -1)
        gap = m["at"] - last["at"]
        near = (gap < close) | ((m["type"] == last["type"]) & (gap < same_type))
        swapped = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(m))
        return F.when(F.size(kept) == 0, F.array(m)).when(near & (m["confidence"] > last["confidence"]), swapped).when(near, kept).otherwise(F.concat(kept, F.array(m)))

    return F.aggregate(markers, F.slice(markers, 1, 0), step)
