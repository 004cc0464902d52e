"""Writes on tables without MERGE: each gives the table's new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it doesn't have."""
    return new.select(*old.columns).unionByName(old.join(new, keys, "left_anti"))


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key ``old`` doesn't have (insert, on conflict do nothing)."""
    return new.join(old, keys, "left_anti")


def fill_in(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``old`` with those of ``columns`` overwritten for which ``new`` has a value that isn't empty."""
    renamed = new.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    put = {c: F.coalesce(F.when(F.col(f"_{c}").cast("string") != "", F.col(f"_{c}")), F.col(c)) for c in columns}
    return old.join(renamed, key, "left").withColumns(put).select(*old.columns)


def latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an order that has no ties."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def batches(df: DataFrame, within: list[str], order: list[str], size: int = 100) -> DataFrame:
    """``df`` with batch_no: its rows in lots of ``size`` within each group."""
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
    return df.withColumn("batch_no", F.floor((rank - 1) / size).cast("long"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have, a null counting as an empty one."""
    return df.groupBy(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys)).agg(F.count("*").alias("n")).where("n > 1")
