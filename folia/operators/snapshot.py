"""Nested snapshots of record sets, and the cell-level differences between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(value: Column) -> Column:
    """Null is empty, booleans are words, blanks are squeezed."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    text = F.when(text == "true", "sí").when(text == "false", "no").otherwise(text)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncation(old: Column, new: Column) -> Column:
    """Whether one of two values is a non-empty beginning of the other."""
    return (old != "") & (new != "") & (F.startswith(new, old) | F.startswith(old, new))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], category: str, order: str, tolerate_truncation: bool = False) -> DataFrame:
    """(category, type, entity_key, field, old_value, new_value): added, removed and changed entities.

    Of repeated keys the last one counts.  Added and removed entities give one row without a
    field; changed ones a row for each field that differs.  Empty values come out as null.
    """
    side = lambda df, p: last_wins(df, keys, order).select(*keys, F.lit(True).alias(f"{p}_there"), *(canonical(F.col(f)).alias(f"{p}_{f}") for f in fields))
    both = side(old, "o").join(side(new, "n"), keys, "full")
    key = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    none = F.lit(None).cast("string")
    row = lambda t, f, a, b: F.struct(F.lit(t).alias("type"), f.alias("field"), F.nullif(a, F.lit("")).alias("old_value"), F.nullif(b, F.lit("")).alias("new_value"))
    cells = []
    for f in fields:
        a, b = F.col(f"o_{f}"), F.col(f"n_{f}")
        differs = a != b
        if tolerate_truncation:
            differs &= ~truncation(a, b)
        cells.append(F.when(differs, row("changed", F.lit(f), a, b)))
    rows = F.when(F.col("o_there").isNull(), F.array(row("added", none, none, none))).when(F.col("n_there").isNull(), F.array(row("removed", none, none, none))).otherwise(F.array_compact(F.array(*cells)) if cells else F.array())
    return both.select(F.lit(category).alias("category"), key.alias("entity_key"), F.explode(rows).alias("c")).select("category", "c.type", "entity_key", "c.field", "c.old_value", "c.new_value")


def within_common(parents: DataFrame, other: DataFrame, keys: list[str], children: DataFrame) -> DataFrame:
    """Children whose parent both snapshots have: those of a new or lost parent aren't compared."""
    return children.join(parents.select(*keys).distinct(), keys, "left_semi").join(other.select(*keys).distinct(), keys, "left_semi")
