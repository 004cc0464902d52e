"""Readers of the tables, tenant scoping and text clean-up at extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment that stands for now, just after the last event.
NOW = "2024-01-31 00:00:00"
#: White space of texts: ASCII's and the no-break space.
SPACE = r"[ \t\n\r\f\x0B\x{A0}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A table of fewer files than there are cores, dealt out by ``keys``, as a small file is one task's; others stay as they are.

    For work that costs much more than moving the rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if len(df.inputFiles()) < cores else df


def scoped(df: DataFrame, owner, column: str = "user_id") -> DataFrame:
    """Rows of one tenant; every tenant-facing query goes through it."""
    return df.where(F.col(column) == F.lit(owner))


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters for those arguments that aren't None."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def moment(column: str) -> Column:
    """Seconds of a timestamp without time zone, as a double."""
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def extracted(text: Column) -> Column:
    """Extractor clean-up: NUL becomes a space, runs of white space one space, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\x00", " "), SPACE + "+", " "))


def cell(text: Column) -> Column:
    """Table cell clean-up: zero-width characters go, no-break spaces and runs become one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x{200B}-\x{200D}\x{FEFF}]", ""), SPACE + "+", " "))


def first_complete(*candidates: tuple[str, Column]) -> Column:
    """Name of the first extractor whose result isn't empty, else 'failed'."""
    return F.coalesce(*(F.when(F.length(F.trim(text)) > 0, F.lit(name)) for name, text in candidates), F.lit("failed"))
