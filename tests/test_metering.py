"""Counters with monthly resets against a sequential brute force, in batch and as a stream."""

import datetime as dt
import random

from folia.operators import metering

KINDS = "user_id long, action string, plan string, ts timestamp_ntz, event_id long"
LIMITS = (("free", "chat", 4, True, False), ("basic", "chat", 3, False, False), ("pro", "chat", 2, False, True), ("ultra", "chat", -1, False, False), ("free", "case", 1, True, False), ("basic", "case", 3, True, False), ("pro", "case", 5, True, False), ("ultra", "case", 9, True, False))


def attempts(by_month=True, n=900):
    rng, rows = random.Random(6), []
    for i in range(n):
        at = dt.datetime(2023, 11, 20) + dt.timedelta(minutes=rng.randrange(140 * 1440))
        user = rng.choice((1, 1, 1, 2, 3, 4, 5))
        rows.append((user, rng.choice(("chat", "case", "other")), metering.PLANS[(user + at.month * by_month) % 4], at, i))
    return rows


def sequential(rows, limits):
    known, state, out = {(p, a): x for p, a, *x in limits}, {}, {}
    for user, action, plan, at, number in sorted(rows, key=lambda r: (r[3], r[4])):
        total, monthly, month = state.get((user, action), (0, 0, None))
        if (at.year, at.month) != month:
            monthly, month = 0, (at.year, at.month)
        limit, lifetime, soft = known.get((plan, action), (0, False, False))
        used = total if lifetime else monthly
        verdict = "allowed" if limit < 0 or used < limit else "throttled" if soft else "denied"
        if verdict != "denied":
            total, monthly = total + 1, monthly + 1
        state[user, action] = total, monthly, month
        out[number] = (plan, used, verdict, 30 if verdict == "throttled" else 0, monthly, total)
    return out


def result(df):
    return {r["event_id"]: tuple(r[c] for c in ("plan", "used", "verdict", "wait_seconds", "monthly_count", "lifetime_count")) for r in df.collect()}


def test_counters_over_months(spark):
    rows = attempts()
    known = spark.createDataFrame(LIMITS, "plan string, action string, plan_limit int, lifetime boolean, soft boolean")
    want = sequential(rows, LIMITS)
    assert {v for _, _, v, *_ in want.values()} == {"allowed", "denied", "throttled"}
    assert result(metering.counted(spark.createDataFrame(rows, KINDS).repartition(5), known)) == want
    left_out = [(None, "chat", "free", rows[0][3], 5000), (1, None, "free", rows[0][3], 5001), (1, "chat", "free", None, 5002)]
    assert result(metering.counted(spark.createDataFrame(rows + left_out, KINDS), known)) == want
    assert metering.counted(spark.createDataFrame([], KINDS)).collect() == []


def test_fixed_limits_and_plan_of_the_last_attempt(spark):
    day = dt.datetime(2024, 2, 1)
    rows = [(1, "case", "ultra", day, 1), (1, "case", "free", day + dt.timedelta(hours=1), 2), (1, "case", None, day + dt.timedelta(days=40), 3), (2, "chat", "pro", day, 4)]
    got = result(metering.counted(spark.createDataFrame(rows, KINDS)))
    assert got == {1: ("free", 0, "allowed", 0, 1, 1), 2: ("free", 1, "denied", 0, 1, 1), 3: (None, 0, "denied", 0, 0, 1), 4: ("pro", 0, "allowed", 0, 1, 1)}
    assert all(lifetime for _, action, _, lifetime, _ in metering.LIMITS if action == "case")


def test_stream_over_batches(spark, tmp_path):
    rows = sorted(attempts(by_month=False, n=300), key=lambda r: (r[3], r[4]))
    folder = f"file://{tmp_path}"
    (tmp_path / "in").mkdir()
    reader = spark.readStream.schema(KINDS).parquet(f"{folder}/in")
    for part in (rows[:100], rows[100:110], rows[110:]):
        spark.createDataFrame(part, KINDS).write.mode("append").parquet(f"{folder}/in")
        out = metering.counted_stream(reader, limit_rows=LIMITS)
        out.writeStream.option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).format("parquet").start(f"{folder}/out").awaitTermination()
    assert result(spark.read.schema(out.schema).parquet(f"{folder}/out")) == sequential(rows, LIMITS)


def test_a_user_is_one_group_of_the_stream(spark, tmp_path):
    rows = [(1, a, "free", dt.datetime(2024, 1, 1 + k), 4 * k + j) for k in range(5) for j, a in enumerate(("chat", "case", None, "other"))]
    folder = f"file://{tmp_path}"
    (tmp_path / "in").mkdir()
    reader = spark.readStream.schema(KINDS).parquet(f"{folder}/in")
    for part in (rows[:7], rows[7:]):
        spark.createDataFrame(part, KINDS).write.mode("append").parquet(f"{folder}/in")
        out = metering.counted_stream(reader, limit_rows=LIMITS)
        run = out.writeStream.option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).format("parquet").start(f"{folder}/out")
        run.awaitTermination()
        assert [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]][-1] == 1
    assert result(spark.read.schema(out.schema).parquet(f"{folder}/out")) == sequential(rows, LIMITS)
