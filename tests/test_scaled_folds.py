"""Folds that are spread over tasks against plain loops: running sums, greedy budgets, the work list."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folia.functions import selection
from folia.operators import worklist
from folia.operators.budget import greedy
from folia.operators.ranks import ranked, running
from folia.operators.selecting import select_spread
from folia.sources.commits import commits


def rows_of(rng, n=400):
    return [(rng.choice(("hot", "hot", "hot", "a", "b", None)), rng.choice((None, *range(50))), i, rng.choice((0, 1, 3, 9, 40, 500))) for i in range(n)]


def test_ranks_and_running_sums(spark):
    rows = rows_of(random.Random(1))
    df = spark.createDataFrame(rows, "g string, k long, part long, size long").repartition(6)
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(r[0], []).append(r)
    want = {r[2]: (n, sum(x[3] for x in own[: n - 1])) for own in groups.values() for n, r in enumerate(own, 1)}
    out = running(ranked(df, "n", ["g"], ["k", "part"]), "before", ["g"], ["k", "part"], "size")
    assert {r["part"]: (r["n"], r["before"]) for r in out.collect()} == want
    assert ranked(df.limit(0), "n", ["g"], ["k"]).collect() == []


@pytest.mark.parametrize("chunk,budget", [(7, 0), (7, 60), (10_000, 60), (7, 5000)])
def test_greedy_in_chunks(spark, chunk, budget):
    rows = rows_of(random.Random(2), 250) + [("late", 1, 900, 10**6), ("late", 2, 901, 1), ("none", 1, 902, 10**6), ("null", 1, 903, None), ("null", 2, 904, 2)]
    want = {}
    for g in {r[0] for r in rows}:
        left, place = budget, 0
        for _, _, i, n in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            if n is not None and n <= left:
                left, want[i], place = left - n, place, place + 1
    out = greedy(spark.createDataFrame(rows, "g string, k long, part long, size long").repartition(5), budget, "g", ["k", "part"], "size", chunk)
    assert {r["part"]: r["ctx_pos"] for r in out.collect()} == want


KIND = "case_id long, task_id long, size long, skip_reason string"


def fate(task, attempts):
    return "unsupported_format" if task % 13 == 1 else "failed" if task % 7 == 1 or (task % 5 == 1 and attempts < 2) else "duplicate" if task % 11 == 1 else "done"


def work(df):
    t, a = F.col("task_id"), F.col("attempts")
    return df.withColumn("result", F.when(t % 13 == 1, "unsupported_format").when((t % 7 == 1) | ((t % 5 == 1) & (a < 2)), "failed").when(t % 11 == 1, "duplicate").otherwise("done"))


def sequential(tasks, budget):
    out, waiting, number = {}, [(*t, 0) for t in tasks], 0
    while waiting:
        spent, later = {}, []
        for case, task, size, reason, attempts in sorted(waiting, key=lambda t: t[:2]):
            if reason:
                out[task] = (attempts, reason, "skipped", number)
            elif spent.get(case, 0) > budget:
                later.append((case, task, size, reason, attempts))
            else:
                spent[case] = spent.get(case, 0) + size
                result = fate(task, attempts)
                if result == "failed" and attempts < 2:
                    later.append((case, task, size, None, attempts + 1))
                elif result in ("done", "duplicate"):
                    out[task] = (attempts, None, result, number)
                else:
                    out[task] = (attempts + (result == "failed"), "max_retries" if result == "failed" else result, "skipped", number)
        waiting, number = later, number + 1
    return out


def shown(df):
    rows = [(r["task_id"], (r["attempts"], r["skip_reason"], r["outcome"], r["batch"])) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def tasks_of(n=90):
    rng = random.Random(3)
    return [(rng.choice((1, 1, 2, 3)), i, rng.randrange(1, 40), "no_storage" if i % 29 == 0 else None) for i in range(n)]


def test_work_is_resumed_until_none_is_left(spark, tmp_path):
    tasks, path = tasks_of(), f"file://{tmp_path}/w"
    df = spark.createDataFrame(tasks, KIND)
    want = sequential(tasks, 200)
    assert {o for _, _, o, _ in want.values()} == {"done", "duplicate", "skipped"} and max(b for *_, b in want.values()) > 3
    schema = worklist._schema(df)
    for k in range(2):  # two batches, one of them twice, then the run breaks off
        worklist.batch(df if k == 0 else None, path, work, 200, f"run.{k}", schema, spark)
        worklist.batch(df if k == 0 else None, path, work, 200, f"run.{k}", schema, spark)
    assert list(commits(spark, path)) == [0, 1] and worklist.leftover(spark, path, schema).count() > 0
    assert shown(worklist.resume(df, path, work, 200)) == want
    assert shown(worklist.resume(df, path, work, 200)) == want  # nothing waits: nothing changes
    empty = worklist.resume(df.limit(0), f"file://{tmp_path}/e", work, 5)
    assert empty.collect() == []


def test_a_batch_reads_only_what_is_near(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(worklist, "AHEAD", 2)
    tasks, path = tasks_of(), f"file://{tmp_path}/w"
    df = spark.createDataFrame(tasks, KIND)
    want = sequential(tasks, 60)
    assert shown(worklist.resume(df, path, work, 60)) == want
    schema, numbers = worklist._schema(df), list(commits(spark, path))
    parted = worklist._far(spark, path, numbers)
    rows = [spark.read.parquet(f"{path}/all/batch={n}").count() for n in numbers]
    assert rows[1] < rows[0] / 3 and parted != [0] and worklist.leftover(spark, path, schema).count() == 0


@pytest.mark.parametrize("budget", [0, 30, 400])
def test_batches_of_windows_are_those_of_one_by_one(budget):
    rng = random.Random(budget)
    for _ in range(60):
        sizes, tries = [rng.choice((0, 1, 7, 40, 900)) for _ in range(rng.randrange(1, 60))], []
        tries = [rng.randrange(1, 4) for _ in sizes]
        want, waiting, number = {}, list(enumerate(tries)), 5
        while waiting:
            spent, later = 0, []
            for i, left in waiting:
                if spent <= budget:
                    want.setdefault(i, number)
                    left, spent = left - 1, spent + sizes[i]
                later += [(i, left)] if left else []
            waiting, number = later, number + 1
        got, state, i = [], (5, 0, 0, 0), 0
        while i < len(sizes):
            j = i + rng.randrange(1, 20)
            began, state = worklist._batches(np.array(sizes[i:j]), np.array(tries[i:j]), state, budget)
            got, i = got + list(began), j
        assert got == [want[i] for i in range(len(sizes))]


def test_a_long_list_takes_few_steps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(worklist, "STEP_ROWS", 60)
    rng = random.Random(4)
    tasks = [(rng.choice((0, 0, 0, 1)), i, rng.choice((0, 1, 30, 500)), "no_storage" if i % 29 == 0 else None) for i in range(150)]
    df = spark.createDataFrame([(case or None, i, size or None, reason) for case, i, size, reason in tasks], KIND)  # a group and sizes that are null
    want, calls = sequential(tasks, 10), []
    assert max(b for *_, b in want.values()) > 60
    broken = [7]

    def counted(rows):
        calls.append(1)
        if len(calls) in broken:
            raise RuntimeError("broken off")
        return work(rows)

    with pytest.raises(RuntimeError):
        worklist.resume(df, f"file://{tmp_path}/w", counted, 10)
    first = shown(worklist.left(spark, f"file://{tmp_path}/w", worklist._schema(df)))
    assert 6 < len(first) < 150 and first.items() <= want.items()
    assert shown(worklist.resume(df, f"file://{tmp_path}/w", counted, 10)) == want
    assert len(calls) < 30  # once a batch before

    calls, broken = [], [7]
    with pytest.raises(RuntimeError):
        worklist.resume(df, f"file://{tmp_path}/x", counted, 10)
    more = spark.createDataFrame([(1, 1000, 5, None), (None, 1001, 5, None)], KIND)
    worklist.batch(more, f"file://{tmp_path}/x", work, 10, "more", worklist._schema(df), spark)  # new tasks after a step
    first, both = shown(worklist.left(spark, f"file://{tmp_path}/x", worklist._schema(df))), shown(worklist.resume(df, f"file://{tmp_path}/x", counted, 10))
    assert first.items() <= both.items() and {t: v[:3] for t, v in both.items() if t < 1000} == {t: v[:3] for t, v in want.items()} and set(both) == {*want, 1000, 1001}
    assert worklist.leftover(spark, f"file://{tmp_path}/x", worklist._schema(df)).count() == 0


def test_tasks_of_one_key_all_leave_once(spark, tmp_path):
    tasks = [(1, i, 10, None) for i in (None, None, None, 1, 1, 5, 5, 5, 9)] * 2
    done = worklist.resume(spark.createDataFrame(tasks, KIND), f"file://{tmp_path}/w", lambda rows: work(rows.na.fill(3, ["task_id"])), 15)
    assert sorted(r["task_id"] for r in done.collect()) == sorted(i or 3 for _, i, *_ in tasks)


def test_a_list_of_any_length_is_run_to_its_end(spark, tmp_path, monkeypatch):
    n, skips = 1100, "CASE WHEN id = 7 THEN 'no_storage' END AS skip_reason"
    tasks = spark.range(n).selectExpr("1L AS case_id", "id AS task_id", "1L AS size", skips)  # at a budget of 0, a batch each
    done = shown(worklist.resume(tasks, f"file://{tmp_path}/w", lambda rows: rows.withColumn("result", F.when(F.col("task_id") != 9, "done")), 0))
    assert set(done) == set(range(n)) and done[9] == (3, "max_retries", "skipped", 10) and max(b for *_, b in done.values()) == n
    steps = iter([True] * 1500 + [False])
    monkeypatch.setattr(worklist, "_step", lambda *_, **__: next(steps))
    worklist.resume(tasks, f"file://{tmp_path}/w", work, 0)
    assert next(steps, None) is None
    with pytest.raises(ValueError):
        worklist.resume(tasks, f"file://{tmp_path}/w", work, -1)


def test_tasks_that_come_as_a_stream(spark, tmp_path):
    tasks, path = tasks_of(40), f"file://{tmp_path}/w"
    (tmp_path / "in").mkdir()
    put = worklist.sink(path, work, 10**6)
    stream = spark.readStream.schema(KIND).parquet(f"file://{tmp_path}/in")
    for part in (tasks[:20], tasks[20:]):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream.writeStream.foreachBatch(put).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    put(spark.createDataFrame(tasks, KIND), 1)  # a replay
    done = shown(worklist.resume(spark.createDataFrame([], KIND), path, work, 10**6))
    assert set(done) == set(range(40)) and {t: v[:3] for t, v in done.items()} == {t: v[:3] for t, v in sequential(tasks, 10**6).items()}


def test_selection_that_is_spread_over_tasks(spark):
    rng = random.Random(9)
    kinds = ("demanda", "resolución", "escrito", "mandamiento de ejecución", "anexo", "sentencia", "otro", None)
    rows = [(rng.choice(("hot", "hot", "a")), i, rng.choice(kinds), rng.randrange(60), "x" * rng.choice((0, 3, 40, 90, 400)), rng.choice((None, "anexo", "Escrito"))) for i in range(90)]
    docs = spark.createDataFrame(rows, "case_id string, doc_id long, document_type string, created_at long, text string, origin string").repartition(4)
    how = {"priority": ["anexo"], "procedure": "ejecutivo", "budget": 500, "changed": ["escrito"]}
    want = sorted(map(tuple, selection.select(docs, **how).collect()))
    assert sorted(map(tuple, select_spread(docs, **how, chunk=11).collect())) == want and len({p for _, _, p, _ in want}) >= 3
