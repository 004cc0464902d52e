"""A stored cache with time to live: prompts by model and rolling hash, served batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folia.sources.commits import commit, commits

# How long prompts and case contexts are kept, in seconds, the least tokens of a prompt that is, and characters of a token.
PROMPT_SECONDS, CASE_SECONDS, LEAST_TOKENS, CHARS = 30 * 60, 5 * 60, 1024, 4
#: What an entry is found by: the hash, of which two prompts of one hash displace each other, or the text's digest too, so that each has its own.
BY_HASH, BY_TEXT = ("model", "hash"), ("model", "hash", "digest")
ENTRY = "model string, hash string, digest string, case_id string, made timestamp, expires timestamp, value string, gone boolean"


@lru_cache(1)
def _powers(least: int) -> np.ndarray:
    out = np.full(least, 31, np.uint32)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint32)


def rolling(text: str) -> int:
    """h = 31 h + unit over the UTF-16 units of a text, as a signed number of 32 bits."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint32)
    if not len(units):
        return 0
    powers = _powers(1 << max(12, int(len(units) - 1).bit_length()))[: len(units)][::-1]
    h = int((units * powers).sum(dtype=np.uint32))
    return h - (1 << 32) if h >= 1 << 31 else h


def base36(n: int) -> str:
    digits, left = "", abs(n)
    while left or not digits:
        left, d = divmod(left, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return "-" + digits if n < 0 else digits


def prompt_hash(text: Column) -> Column:
    """``rolling`` in base 36 of each text, which is Java's hash of a string, so no text leaves the JVM; null of a null one."""
    number = F.java_method(F.lit("java.util.Objects"), F.lit("hashCode"), text).cast("int")
    return F.when(text.isNotNull(), F.java_method(F.lit("java.lang.Integer"), F.lit("toString"), number, F.lit(36)))


def worth_caching(prompt: Column) -> Column:
    """Whether a prompt has so many tokens that it is kept."""
    return F.coalesce(F.ceil(F.length(prompt) / CHARS) >= LEAST_TOKENS, F.lit(False))


def entries(spark: SparkSession, path: str, by: tuple[str, ...] = BY_HASH) -> DataFrame:
    """The newest entry of each model and hash (or of what ``by`` names) that hasn't been taken out."""
    done = commits(spark, path)
    if not done:
        return spark.createDataFrame([], ENTRY)
    base = max((n for n, token in done.items() if token.startswith("sweep")), default=0)
    rows = spark.read.schema(ENTRY + ", batch int").option("basePath", f"{path}/entries").parquet(*(f"{path}/entries/batch={n}" for n in done if n >= base))
    newest = rows.groupBy(*by).agg(F.max_by(F.struct(*rows.columns), "batch").alias("x")).select("x.*")
    return newest.where("NOT gone").drop("batch", "gone")


def _put(spark: SparkSession, path: str, rows: DataFrame, kind: str) -> None:
    number = max(commits(spark, path), default=-1) + 1
    rows.select(*(c.split()[0] for c in ENTRY.split(", "))).write.mode("overwrite").parquet(f"{path}/entries/batch={number}")
    commit(spark, path, number, f"{kind}.{number}")


def serve(requests: DataFrame, path: str, now: str, make: Callable[[DataFrame], DataFrame], key: str = "request_id", seconds: int = PROMPT_SECONDS, by: tuple[str, ...] = BY_HASH) -> DataFrame:
    """A batch of ``requests`` (``key``, model, prompt, case_id) at one moment: (``key``, status, value).

    ``hit``: a live entry of the model and hash has the same prompt.  ``miss`` and ``expired``: there is none, or one whose
    time is over at ``now``; ``make`` gives its new value, once for all requests of the batch, of which the smallest ``key`` makes it and
    the others are ``shared``.  ``short``: the prompt isn't worth caching, and has no value.  Two prompts of one
    hash take turns, the last one made stays; ``BY_TEXT`` keeps them both.
    """
    spark, at = requests.sparkSession, F.lit(now).cast("timestamp")
    asked = requests.select(key, "model", "prompt", F.col("case_id").cast("string").alias("case_id"), worth_caching(F.col("prompt")).alias("long"))
    long = asked.where("long").withColumns({"hash": prompt_hash(F.col("prompt")), "digest": F.sha2("prompt", 256)})
    known = entries(spark, path, by).select(*by, F.col("digest").alias("was"), "expires", F.col("value").alias("kept"))
    first = F.row_number().over(Window.partitionBy("model", "hash", "digest").orderBy(key)) == 1
    met = long.join(known, list(by), "left")
    same = F.coalesce(F.col("was") == F.col("digest"), F.lit(False))
    status = F.when(same & (F.col("expires") > at), "hit").when(~F.col("first"), "shared").when(same, "expired").otherwise("miss")
    rated = met.withColumn("first", first).withColumn("status", status)
    held = f"{path}/served/{len(commits(spark, path)):09d}"
    rated.drop("was", "expires", "first", "long").write.mode("overwrite").parquet(held)
    rated = spark.read.schema(rated.drop("was", "expires", "first", "long").schema).parquet(held)
    made = make(rated.where(F.col("status").isin("miss", "expired")).drop("kept"))
    new = made.select("model", "hash", "digest", "case_id", at.alias("made"), (at + F.make_dt_interval(secs=F.lit(seconds))).alias("expires"), "value", F.lit(False).alias("gone"))
    one = new.groupBy(*by).agg(F.max_by(F.struct(*new.columns), "digest").alias("x")).select("x.*")
    _put(spark, path, one, "serve")
    values = made.select("model", "digest", F.col("value").alias("fresh"))
    out = rated.join(values, ["model", "digest"], "left").select(key, "status", F.when(F.col("status") == "hit", F.col("kept")).otherwise(F.col("fresh")).alias("value"))
    return out.unionByName(asked.where("NOT long").select(key, F.lit("short").alias("status"), F.lit(None).cast("string").alias("value")))


def invalidate(spark: SparkSession, path: str, cases: DataFrame, by: tuple[str, ...] = BY_HASH) -> None:
    """Takes out the entries of ``cases`` (case_id), live or not."""
    wanted = cases.select(F.col("case_id").cast("string").alias("case_id")).distinct()
    _put(spark, path, entries(spark, path, by).join(wanted, "case_id", "left_semi").withColumn("gone", F.lit(True)), "invalidate")


def sweep(spark: SparkSession, path: str, now: str, by: tuple[str, ...] = BY_HASH) -> None:
    """Writes the entries that still live at ``now`` anew; older batches are read no more."""
    _put(spark, path, entries(spark, path, by).where(F.col("expires") > F.lit(now).cast("timestamp")).withColumn("gone", F.lit(False)), "sweep")
