"""Stateful streams: the processing queue, work enqueued once, and the sliding rate limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Seconds to the next try by attempt, and tries of a document.
BACKOFF, MOST_ATTEMPTS = (10, 60, 300), 3


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def once(events: DataFrame, key: str, time: str = "ts", late: str = "40 days") -> DataFrame:
    """The first row of each key; state is kept for as long as rows may come late."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def limiter(requests: DataFrame, limit: int, window: float) -> DataFrame:
    """(user_id, requests, admitted) per user and batch: a sliding log in which rejected requests leave no trace.

    ``requests`` has (user_id, t) with t in seconds.  State is the log of one user's admitted times in
    the last window, at most ``limit`` of them.
    """

    def admit(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log, seen, taken = list(state.get[0]) if state.exists else [], 0, 0
        for t in sorted(x for frame in frames for x in frame["t"]):
            log = [x for x in log if x > t - window]
            seen += 1
            if len(log) < limit:
                log.append(t)
                taken += 1
        state.update((log,))
        yield pd.DataFrame({"user_id": [key[0]], "requests": [seen], "admitted": [taken]})

    return requests.groupBy("user_id").applyInPandasWithState(admit, "user_id long, requests long, admitted long", "log array<double>", "append", GroupStateTimeout.NoTimeout)


def machine(status: str, attempts: int, event: str) -> tuple[str, int]:
    """Next (status, attempts) of a document: queued, processing, completed or failed."""
    if event == "enqueue":
        return (status, attempts) if status in ("processing", "completed") else ("queued", attempts)
    if event == "start":
        return ("processing", attempts + 1) if status in ("queued", "failed") and attempts < MOST_ATTEMPTS else (status, attempts)
    if event == "done":
        return ("completed", attempts) if status == "processing" else (status, attempts)
    return ("failed", attempts) if event == "error" and status == "processing" else (status, attempts)


def retry_after(attempts: int) -> int:
    """Seconds from a failed attempt (counted from 1) to the next one."""
    return BACKOFF[min(attempts, len(BACKOFF) - 1)]


def queue(events: DataFrame) -> DataFrame:
    """(document_id, status, attempts, delay_s) after each batch; ``events`` has (document_id, t, event)."""

    def advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts = state.get if state.exists else ("queued", 0)
        rows = pd.concat(list(frames)).sort_values(["t", "event"])
        for event in rows["event"]:
            status, attempts = machine(status, attempts, event)
        state.update((status, attempts))
        delay = retry_after(attempts) if status == "failed" and attempts < MOST_ATTEMPTS else 0
        yield pd.DataFrame({"document_id": [key[0]], "status": [status], "attempts": [attempts], "delay_s": [delay]})

    return events.groupBy("document_id").applyInPandasWithState(advance, "document_id long, status string, attempts int, delay_s int", "status string, attempts int", "append", GroupStateTimeout.NoTimeout)


#: Microseconds that a finished document's state is kept for.
KEEP = 7 * 86_400_000_000
State = tuple[str, int, int]  # status, attempts, and when its timer fires, in microseconds, or 0
FRESH: State = ("queued", 0, 0)


def advanced(state: State, at: int, event: str, keep: int = KEEP) -> State:
    """The state after an event: a change to failed sets the timer of the next try, one to an end that of expiry, any other stops it."""
    status, attempts = machine(state[0], state[1], event)
    if (status, attempts) == state[:2]:
        return state
    if status == "failed" and attempts < MOST_ATTEMPTS:
        return status, attempts, at + 1_000_000 * retry_after(attempts)
    return status, attempts, at + keep if status in ("failed", "completed") else 0


def fired(state: State) -> tuple[State | None, str]:
    """The state after its timer, none where it expires, and what the timer was for."""
    status, attempts, _ = state
    return (("queued", attempts, 0), "retry") if status == "failed" and attempts < MOST_ATTEMPTS else (None, "expiry")


def timed_queue(events: DataFrame, delay: str = "0 seconds", keep: int = KEEP) -> DataFrame:
    """(document_id, at, cause, status, attempts) of each event and each timer of a stream of (document_id, at, event), ``at`` a timestamp.

    A failed document is queued again 10, 60 or 300 seconds later without an event, as the watermark (the latest
    time seen less ``delay``) passes; a completed one, or one that failed for the last time, expires ``keep`` microseconds
    after that and its state is removed.  Timers that are due before a document's next event fire first, so rows don't depend on
    how events fall into batches, as long as they aren't later than ``delay``.
    """
    watched = events.withWatermark("at", delay).withColumn("micros", F.unix_micros("at"))
    columns = ["document_id", "micros", "cause", "status", "attempts"]

    def advance(key, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state, out = (tuple(group.get) if group.exists else None), []

        def fire(state: State) -> State | None:
            after, cause = fired(state)
            out.append((key[0], state[2], cause, after[0] if after else "gone", state[1]))
            return after

        if not group.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(["micros", "event"])
            for at, event in zip(rows["micros"].tolist(), rows["event"].tolist(), strict=True):
                while state and 0 < state[2] <= at:
                    state = fire(state)
                state = advanced(state or FRESH, at, event, keep)
                out.append((key[0], at, event, *state[:2]))
        while state and 0 < state[2] // 1000 < group.getCurrentWatermarkMs():
            state = fire(state)
        if state is None:
            group.remove()
        else:
            group.update(state)
            if state[2]:
                group.setTimeoutTimestamp(max(state[2] // 1000, group.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=columns)

    rows = watched.groupBy("document_id").applyInPandasWithState(
        advance, "document_id long, micros long, cause string, status string, attempts int", "status string, attempts int, due long", "append", GroupStateTimeout.EventTimeTimeout
    )
    return rows.select("document_id", F.timestamp_micros("micros").alias("at"), "cause", "status", "attempts")


def written_out(rows: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into a table in ``folder``, and reads that table."""
    done = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/rows")
    done.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")


def with_leftover(tasks: DataFrame, deadline: float, size: str = "size", order: str = "task_id", group: str = "case_id") -> DataFrame:
    """``tasks`` with status: done while the running total of a group stays within the deadline, else pending."""
    from pyspark.sql import Window

    spent = F.sum(size).over(Window.partitionBy(group).orderBy(order))
    return tasks.withColumn("status", F.when(spent <= deadline, "done").otherwise("pending"))
