"""Row numbers of whole tables and groups without a task that holds them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.sources.folders import stored


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with none of ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ranked(rows: DataFrame, name: str, groups: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``name``, their number from 1 in their group by ``order``, nulls first.

    Sampled ranges of (groups, order) are stored and counted by group; a row's number is that in its range,
    which is of one task's size, after the group's rows in former ranges.  So neither a group of very
    many rows nor sparse ids gather in one task.  Rows that are equal in ``order`` are numbered in any order.
    """
    part, size, ahead, *same = fresh([*rows.columns, name], "part", "size", "ahead", *(f"same{k}" for k in range(len(groups))))
    dealt = stored(rows.repartitionByRange(*(F.col(c).asc_nulls_first() for c in (*groups, *order))).withColumn(part, F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*groups, part).agg(F.count("*").alias(size))  # a row for each group and range at most
    before = F.sum(size).over(Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*(F.col(g).alias(s) for g, s in zip(groups, same, strict=True)), F.col(part).alias(f"{part}_"), F.coalesce(before, F.lit(0)).alias(ahead))
    inside = F.row_number().over(Window.partitionBy(*groups, part).orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    match = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(s)) for g, s in zip(groups, same, strict=True)), F.col(part) == F.col(f"{part}_"))
    return dealt.withColumn(name, inside).join(starts, match).withColumn(name, (F.col(name) + F.col(ahead)).cast("long")).drop(part, f"{part}_", ahead, *same)


def numbered(rows: DataFrame, name: str, number: str, *before: str) -> DataFrame:
    """``rows`` with ``name``, their number from 1 in the order of ``before`` and then of ``number``, nulls first."""
    return ranked(rows, name, [], [*before, number])


def running(rows: DataFrame, name: str, groups: list[str], order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of the whole numbers ``value`` over former rows of their group by ``order``, nulls first and counting as 0.

    As in ``ranked``, ranges are stored and summed, so no task holds a group.  ``order`` must tell rows apart.  There are ``parts`` ranges, if
    given: for ranges the driver gets up to three hundred keys of each, however few rows they have.
    """
    return running_sums(rows, {name: F.col(value)}, groups, order, parts)


def running_sums(rows: DataFrame, values: dict[str, Column], groups: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``running`` for several ``values`` by their sums' names, with one sort."""
    part, *same = fresh([*rows.columns, *values], "part", *(f"same{k}" for k in range(len(groups))))
    ahead = dict(zip(values, fresh([*rows.columns, *values, part, *same], *(f"ahead{k}" for k in range(len(values)))), strict=True))
    worth = {name: F.coalesce(value, F.lit(0)).cast("long") for name, value in values.items()}
    dealt = stored(rows.repartitionByRange(*([parts] if parts else []), *(F.col(c).asc_nulls_first() for c in (*groups, *order))).withColumn(part, F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*groups, part).agg(*(F.sum(w).alias(ahead[name]) for name, w in worth.items()))
    up_to = lambda value, window: F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts_before, rows_before = Window.partitionBy(*groups).orderBy(part), Window.partitionBy(*groups, part).orderBy(*(F.col(c).asc_nulls_first() for c in order))
    starts = sums.select(*(F.col(g).alias(s) for g, s in zip(groups, same, strict=True)), F.col(part).alias(f"{part}_"), *(up_to(F.col(c), parts_before).alias(c) for c in ahead.values()))
    match = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(s)) for g, s in zip(groups, same, strict=True)), F.col(part) == F.col(f"{part}_"))
    inside = dealt.withColumns({name: up_to(w, rows_before) for name, w in worth.items()})
    return inside.join(starts, match).withColumns({name: F.col(name) + F.col(c) for name, c in ahead.items()}).drop(part, f"{part}_", *ahead.values(), *same)
