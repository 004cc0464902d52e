"""Batches that come again, break off or arrive by another stream: effects happen once."""

import datetime as dt

import pytest
from folia.sources.commits import commits
from folia.streaming import queue, sinks


def shown(spark, folder, schema, *columns):
    return sorted(tuple(r[c] for c in columns) for r in sinks.finished(spark, folder, schema).collect())


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    assert shown(spark, folder, "x int", "x") == []
    put = sinks.once(folder)
    a, b = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(3,)], "x int")
    put(a, 0)
    put(b, 1)
    put(b, 1)
    put(a, 0)
    sinks.once(folder, name="other")(a, 0)
    assert shown(spark, folder, "x int", "batch", "x") == [(0, 1), (0, 2), (1, 3), (2, 1), (2, 2)]


def test_a_batch_that_broke_off_is_written_anew(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    spark.createDataFrame([(9,)], "x int").write.parquet(f"{folder}/rows/batch=0")  # rows without a name
    assert shown(spark, folder, "x int", "x") == []

    def breaks(batch, number):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        sinks.once(folder, breaks)(spark.createDataFrame([(1,)], "x int"), 0)
    sinks.once(folder)(spark.createDataFrame([(1,)], "x int"), 0)
    assert shown(spark, folder, "x int", "x") == [(1,)] and list(commits(spark, folder)) == [0]


INSERTS = "ts timestamp, document_id long, case_id long, user_id long, storage_path string, filename string, document_type string, file_size long, source string, metadata string"


def test_documents_are_queued_once_with_their_metadata(spark, tmp_path):
    folder, day = f"file://{tmp_path}/q", dt.datetime(2024, 1, 1)
    row = lambda hours, doc, case, name, meta=None: (day + dt.timedelta(hours=hours), doc, case, 7, "p", name, "acta", 5, "sync", meta)
    put = sinks.enqueue(folder, spark.createDataFrame([(1, "C-1-2024"), (3, None)], "case_id long, rol string"), ("ts",))
    for df in ([row(2, 10, 1, "late"), row(1, 10, 1, "first", '{"a":1}'), row(1, 11, 2, "b")], [row(0, 10, 1, "again"), row(3, 12, 3, "c"), row(3, None, 1, "d")]):
        number = len(commits(spark, folder))
        for _ in range(2):
            put(spark.createDataFrame(df, INSERTS), number)
    got = {r["document_id"]: r["metadata"] for r in sinks.finished(spark, folder, sinks.QUEUED).collect()}
    assert {k: (m["filename"], m["rol"], m["doc_metadata"]) for k, m in got.items()} == {10: ("first", "C-1-2024", '{"a":1}'), 11: ("b", "sin_rol", "{}"), 12: ("c", "sin_rol", "{}")}
    assert sinks.finished(spark, folder, sinks.QUEUED).count() == 3


EVENTS = "document_id long, at timestamp, event string"


def run(spark, tmp_path, batches):
    """Rows by batch of a stream that gets the batches one by one."""
    (tmp_path / "in").mkdir(parents=True)
    reader, out, seen = spark.readStream.schema(EVENTS).parquet(f"file://{tmp_path}/in"), [], 0
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        got = queue.written_out(queue.timed_queue(reader), f"file://{tmp_path}/out").collect()
        out.append(sorted((r["document_id"], r["at"], r["cause"], r["status"], r["attempts"]) for r in got)[:])
    return out


def test_retries_fire_while_only_time_passes(spark, tmp_path):
    begin = dt.datetime(2024, 1, 1)
    at = lambda s: begin + dt.timedelta(seconds=s)
    clock = lambda s: [(99, at(s), "tick")]  # noqa: E731  another document's event lets time pass
    tries = [(1, at(0), "enqueue"), (1, at(1), "start"), (1, at(2), "error"), (2, at(1), "start"), (2, at(2), "done")]
    week = queue.KEEP // 1_000_000
    steps = run(spark, tmp_path, [tries, clock(50), clock(63), [(1, at(64), "start"), (1, at(65), "error")], clock(300), clock(366), [(1, at(370), "start"), (1, at(371), "error")], clock(5000), clock(week + 400)])
    own = [[r[1:] for r in rows if r[0] == 1] for rows in steps]
    assert [len(x) for x in own] == [3, 3, 4, 6, 6, 7, 9, 9, 10]
    assert (at(62), "retry", "queued", 1) in own[2] and (at(365), "retry", "queued", 2) in own[5]
    assert (at(371 + week), "expiry", "gone", 3) in own[8]  # the third failure was the last
    assert (2, at(2 + week), "expiry", "gone", 1) in steps[8] and not any(r[2] == "expiry" for r in steps[7])


def test_timers_do_not_depend_on_batches(spark, tmp_path):
    import random

    rng, begin = random.Random(8), dt.datetime(2024, 1, 1)
    events = sorted(((rng.randrange(6), begin + dt.timedelta(seconds=rng.randrange(4000)), rng.choice(("enqueue", "start", "start", "done", "error", "error"))) for _ in range(200)), key=lambda r: (r[1], r[2]))
    events.append((99, begin + dt.timedelta(days=30), "tick"))
    one = run(spark, tmp_path / "one", [events])[-1]
    many = run(spark, tmp_path / "many", [events[:50], events[50:51], events[51:130], events[130:]])[-1]
    assert one == many and {r[2] for r in one} >= {"retry", "expiry"}
