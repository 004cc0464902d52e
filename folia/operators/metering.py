"""Usage metering: plan limits, counters with monthly resets, costs and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folia.operators.ranks import ranked

# Limits of the four plans by action (-1: none), whether they count over a lifetime, and soft ones.
PLANS = ("free", "basic", "pro", "ultra")
LIMITS = (
    ("free", "case", 1, True, False), ("free", "chat", 20, True, False), ("free", "full", 5, True, False), ("free", "deep", 2, True, False),
    ("basic", "case", 10, True, False), ("basic", "chat", 200, False, False), ("basic", "full", 15, False, False), ("basic", "deep", 5, False, False),
    ("pro", "case", 30, True, False), ("pro", "chat", 500, False, True), ("pro", "full", 50, False, False), ("pro", "deep", 12, False, False),
    ("ultra", "case", 100, True, False), ("ultra", "chat", 800, False, True), ("ultra", "full", 100, False, False), ("ultra", "deep", 25, False, False),
)
THROTTLE_SECONDS = 30
# Dollars for a million tokens in and out, by mode.
PRICES = (("fast", 0.50, 3.00), ("full", 3.0, 15.0), ("deep", 5.0, 25.0))


def limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIMITS, "plan string, action string, plan_limit int, lifetime boolean, soft boolean")


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "mode string, price_in double, price_out double")


def verdict(used: Column, limit: Column, soft: Column) -> Column:
    """allowed, denied, or throttled where a soft limit is passed."""
    return F.when((limit < 0) | (used < limit), "allowed").when(soft, "throttled").otherwise("denied")


def check(usage: DataFrame) -> DataFrame:
    """``usage`` (plan, action, lifetime_n, monthly_n, ...) with used, plan_limit, verdict and wait_seconds."""
    joined = usage.join(F.broadcast(limits(usage.sparkSession)), ["plan", "action"])  # a fixed table of 16 rows
    used = F.when(F.col("lifetime"), F.col("lifetime_n")).otherwise(F.col("monthly_n"))
    rated = joined.withColumns({"used": used, "verdict": verdict(used, F.col("plan_limit"), F.col("soft"))})
    return rated.withColumn("wait_seconds", F.when(F.col("verdict") == "throttled", THROTTLE_SECONDS).otherwise(0))


def _month_fold(months: Column) -> Column:
    """Of months in order (month, n, plan_limit, lifetime, soft), each with the lifetime counter before it and the attempts that are let in."""

    def step(state: Column, m: Column) -> Column:
        open_end = m["soft"] | (m["plan_limit"] < 0)
        room = F.greatest(m["plan_limit"] - F.when(m["lifetime"], state["total"]).otherwise(F.lit(0)), F.lit(0))
        taken = F.when(open_end, m["n"]).otherwise(F.least(m["n"], room)).cast("long")
        added = F.struct(m["month"].alias("month"), state["total"].alias("before"), taken.alias("taken"))
        return F.struct((state["total"] + taken).alias("total"), F.concat(state["out"], F.array(added)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<month:date,before:bigint,taken:bigint>>").alias("out"))
    return F.aggregate(months, start, step, lambda s: s["out"])


def counted(attempts: DataFrame, limit_rows: DataFrame | None = None, time: str = "ts", ident: str = "event_id") -> DataFrame:
    """Check-then-increment of each attempt: ``attempts`` with used, verdict, wait_seconds and both counters after it.

    ``attempts`` has user_id, action, plan, ``time`` and ``ident``; they come in the order of ``time`` and ``ident``.  Every
    user and action has a lifetime counter and a monthly one that is zero again from the first of each
    month (before the check).  The plan's limit is held against one of the two; a denied attempt leaves both as they are,
    one beyond a soft limit waits and counts.  A user's plan holds for a month: that of its last attempt there.

    Attempts are numbered within months in ranges, so a user with very many is in no task as a whole; the
    ordered fold runs over a user's months.  Attempts whose plan or action isn't known are denied and count nothing; those
    without a user, an action or a time are left out.
    """
    spark = attempts.sparkSession
    known = limit_rows if limit_rows is not None else limits(spark)
    rows = attempts.dropna(subset=["user_id", "action", time]).withColumn("month", F.trunc(time, "month"))
    group = ["user_id", "action", "month"]
    plans = rows.groupBy("user_id", "month").agg(F.max_by("plan", F.struct(time, ident)).alias("plan"))
    months = rows.groupBy(*group).agg(F.count("*").alias("n")).join(plans, ["user_id", "month"]).join(F.broadcast(known), ["plan", "action"], "left")
    months = months.fillna({"plan_limit": 0, "lifetime": False, "soft": False})
    folded = months.groupBy("user_id", "action").agg(F.array_sort(F.collect_list(F.struct("month", "n", "plan_limit", "lifetime", "soft"))).alias("m"))
    taken = folded.select("user_id", "action", F.explode(_month_fold(F.col("m"))).alias("x")).select("user_id", "action", "x.*")
    state = taken.join(months.drop("n"), group)
    numbered = ranked(rows.drop("plan"), "number", group, [time, ident]).join(state, group)
    inside = F.least(F.col("number") - 1, F.col("taken"))
    used = F.when(F.col("lifetime"), F.col("before") + inside).otherwise(inside)
    counts = (F.col("number") <= F.col("taken")).cast("long")
    out = numbered.withColumns({"used": used, "verdict": verdict(used, F.col("plan_limit"), F.col("soft"))})
    out = out.withColumns({
        "wait_seconds": F.when(F.col("verdict") == "throttled", THROTTLE_SECONDS).otherwise(0),
        "monthly_count": inside + counts, "lifetime_count": F.col("before") + inside + counts,
    })
    return out.drop("number", "before", "taken", "plan_limit", "lifetime", "soft", "month")


def counted_stream(attempts: DataFrame, time: str = "ts", ident: str = "event_id", limit_rows: tuple = LIMITS) -> DataFrame:
    """``counted`` on a stream: (user_id, action, ident, plan, used, verdict, wait_seconds, monthly_count, lifetime_count) of each attempt.

    State is two counters and a month for each action of a user; it stays for good, as lifetime counters do.  Users are the groups, as
    most of the work is a group's, however few attempts it has.  Here an attempt brings its own plan.  Attempts must come in order of time between batches; within one they are sorted.
    """
    known = {(p, a): rest for p, a, *rest in limit_rows}
    schema = f"user_id long, action string, {ident} long, plan string, used long, verdict string, wait_seconds int, monthly_count long, lifetime_count long"

    def advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counters = {a: tuple(x) for a, *x in zip(*state.get, strict=True)} if state.exists else {}
        rows = [row for f in frames for row in zip(*(f[c].tolist() for c in ("action", "plan", time, ident)), strict=True)]
        out = []
        for action, plan, at, number in sorted(rows, key=lambda r: (r[2] is pd.NaT, 0 if r[2] is pd.NaT else r[2], r[3])):
            total, monthly, month = counters.get(action, (0, 0, ""))
            limit, lifetime, soft = known.get((plan, action), (0, False, False))
            if f"{at:%Y-%m}" > month:
                monthly, month = 0, f"{at:%Y-%m}"
            used = total if lifetime else monthly
            said = "allowed" if limit < 0 or used < limit else "throttled" if soft else "denied"
            if said != "denied":
                total, monthly = total + 1, monthly + 1
            counters[action] = total, monthly, month
            out.append((key[0], action, number, plan, used, said, THROTTLE_SECONDS if said == "throttled" else 0, monthly, total))
        state.update((list(counters), *map(list, zip(*counters.values(), strict=True))))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    kept = "actions array<string>, totals array<long>, monthlies array<long>, months array<string>"
    return attempts.groupBy("user_id").applyInPandasWithState(advance, schema, kept, "append", GroupStateTimeout.NoTimeout)


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out
