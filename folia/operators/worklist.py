"""A work list that is resumed: tasks run in order under a budget a batch, failures come back, and every task leaves once.

What waits is in two tables: the next ``AHEAD`` budgets of each group, which every batch reads, and all that comes after
them, which is read only when a group may run out of those or new tasks come.  So a batch costs the same however long the list is.

``resume`` runs the batches of a window of each group in one step: a window's tasks have their tries one after another, and from the
tries that each took follows the batch it began in.  No task in Spark holds more of a group than its window's keys and sizes.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.operators.ranks import fresh, running, running_sums
from folia.sources.commits import commit, commits, place

# Tries of a task, and the reason of one that has had them all.
TRIES, TIRED = 3, "max_retries"
#: Budgets of each group that are kept at hand; rows of a range of tasks in order; rows of a group that a step runs at most.
AHEAD, RANGE_ROWS, STEP_ROWS = 32, 100_000, 500_000
Work = Callable[[DataFrame], DataFrame]


def _schema(tasks: DataFrame) -> T.StructType:
    """A task's columns, its tries so far, why it was skipped, and how it ended (done, duplicate, skipped; null while it waits)."""
    more = [("attempts", T.IntegerType()), ("skip_reason", T.StringType()), ("outcome", T.StringType())]
    return T.StructType([*(f for f in tasks.schema.fields if f.name not in dict(more)), *(T.StructField(n, k) for n, k in more)])


def _read(spark: SparkSession, path: str, kind: str, numbers: list[int], schema: T.StructType) -> DataFrame:
    if not numbers:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/{kind}").parquet(*(f"{path}/{kind}/batch={n}" for n in numbers)).select(*schema.names)


def _far(spark: SparkSession, path: str, done: list[int]) -> list[int]:
    """The batch that last parted what waits, if any did."""
    fs, at = place(spark, f"{path}/far")
    found = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in found if n in done)[-1:]


def _step_of(token: str) -> tuple[int, int, int] | None:
    """Of a step's token: the step that parted what waits, the window that was run, and the highest batch so far."""
    found = re.fullmatch(r"windows\.(\d+)\.(\d+)\.(\d+)", token)
    return tuple(map(int, found.groups())) if found else None


def _next(done: dict[int, str]) -> int:
    """A number above those of all commits and batches."""
    steps = filter(None, map(_step_of, done.values()))
    return max((*done, *(last for *_, last in steps)), default=-1) + 1


def _windows(spark: SparkSession, path: str, parted: int, window: int) -> list[str]:
    """Folders of the windows after ``window``, in order."""
    fs, at = place(spark, f"{path}/far/batch={parted}")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    found = {int(name.split("=")[1]): name for name in names if "=" in name}
    return [f"{path}/far/batch={parted}/{found[w]}" for w in sorted(found) if w > window]


def _near_and_far(spark: SparkSession, path: str, done: dict[int, str], schema: T.StructType) -> tuple[DataFrame, list[int]]:
    """What is at hand, and the batch that parted the rest; after a step all is at hand."""
    numbers = list(done)
    step = _step_of(done[numbers[-1]]) if done else None
    if step is None:
        return _read(spark, path, "leftover", numbers[-1:], schema), _far(spark, path, numbers)
    ahead = _windows(spark, path, *step[:2])
    return (spark.read.schema(schema).parquet(*ahead) if ahead else spark.createDataFrame([], schema)), []


def leftover(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What waits for the next batch."""
    near, far = _near_and_far(spark, path, commits(spark, path), schema)
    return near.unionByName(_read(spark, path, "far", far, schema))


def _short(spark: SparkSession, path: str, far: list[int], near: DataFrame, budget: int, schema: T.StructType, group: str, size: str) -> bool:
    """Whether a group with tasks further on may have no more than a budget of tasks at hand."""
    if not far:
        return False
    more = _read(spark, path, "far_groups", far, T.StructType([schema[group]])).withColumnRenamed(group, "more")
    sums = near.groupBy(group).agg(F.sum(F.coalesce(F.col(size), F.lit(0)).cast("long")).alias("at_hand"))
    return not more.join(sums, F.col("more").eqNullSafe(F.col(group)), "left").where(F.coalesce("at_hand", F.lit(0)) <= budget).isEmpty()


def left(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tasks that have left the list, with the batch they left in."""
    done = commits(spark, path)
    whole = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    steps = [n for n, token in done.items() if _step_of(token)]
    out = _read(spark, path, "left", [n for n in done if n not in steps], whole)
    return out.unionByName(spark.read.schema(whole).parquet(*(f"{path}/left/batch={n}" for n in steps))) if steps else out


def _tried(result: DataFrame) -> DataFrame:
    """What ``work`` gave back, with attempts, reason and outcome; no result is a failure."""
    failed = F.coalesce(F.col("result") == "failed", F.lit(True))
    tried = result.withColumn("attempts", F.col("attempts") + failed.cast("int"))
    over = F.when(failed, F.when(F.col("attempts") >= TRIES, TIRED)).when(~F.col("result").isin("done", "duplicate"), F.col("result"))
    tried = tried.withColumn("skip_reason", over)
    return tried.withColumn("outcome", F.when(F.col("skip_reason").isNotNull(), "skipped").when(~failed, F.col("result")))


def batch(tasks: DataFrame | None, path: str, work: Work, budget: int, token: str, schema: T.StructType, spark: SparkSession, group: str = "case_id", order: str = "task_id", size: str = "size") -> int:
    """One batch over what waits and new ``tasks``; how many wait after it.  A token that is done already changes nothing.

    A group's tasks begin, in ``order``, while the sizes of those before them in the batch are within ``budget``;
    the others wait.  ``work`` gets the ones that begin and gives them back with ``result``: done, duplicate, failed, or any
    other word, which is the reason for leaving them out.  A failed task waits with one more attempt until it has
    had three.  Tasks that come with a skip reason leave with it and cost nothing.
    """
    done = commits(spark, path)
    number, mark = _next(done), fresh(schema.names, "later")[0]
    if token not in done.values():
        now, far = _near_and_far(spark, path, done, schema)
        stepped = bool(done) and _step_of(list(done.values())[-1]) is not None
        parted = tasks is not None or stepped or _short(spark, path, far, now, budget, schema, group, size)
        if parted:
            now = now.unionByName(_read(spark, path, "far", far, schema))
        if tasks is not None:
            new = tasks.withColumns({c: F.lit(None).cast(schema[c].dataType) for c in ("attempts", "skip_reason") if c not in tasks.columns} | {"outcome": F.lit(None).cast("string")})
            now = now.unionByName(new.withColumn("attempts", F.coalesce("attempts", F.lit(0)).cast("int")).select(*schema.names))
        tired = F.when(F.col("attempts") >= TRIES, TIRED)
        now = now.withColumn("skip_reason", F.coalesce("skip_reason", tired))
        skipped = now.where("skip_reason IS NOT NULL").withColumn("outcome", F.lit("skipped"))
        spent = running(now.where("skip_reason IS NULL"), "spent", [group], [order], size, 1 + now.count() // RANGE_ROWS)
        tried = _tried(work(spent.where(F.col("spent") <= budget).drop("spent")))
        later = (F.lit(parted) & (F.col("spent") > (AHEAD + 1) * budget)).alias(mark)
        waits = spent.where(F.col("spent") > budget).select(*schema.names, later)
        whole = tried.select(*schema.names).unionByName(skipped.select(*schema.names)).withColumn(mark, F.lit(False)).unionByName(waits)
        held = f"{path}/all/batch={number}"
        whole.write.mode("overwrite").parquet(held)  # work is done once, whatever is read of it
        rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(mark, T.BooleanType())])).parquet(held)
        rows.where("outcome IS NOT NULL").drop(mark).write.mode("overwrite").parquet(f"{path}/left/batch={number}")
        rows.where(F.col("outcome").isNull() & ~F.col(mark)).drop(mark).write.mode("overwrite").parquet(f"{path}/leftover/batch={number}")
        if parted:
            rows.where(mark).drop(mark).write.mode("overwrite").parquet(f"{path}/far/batch={number}")
            rows.where(mark).select(group).distinct().write.mode("overwrite").parquet(f"{path}/far_groups/batch={number}")
        else:  # what a batch that broke off may have parted
            fs, at = place(spark, f"{path}/far/batch={number}")
            fs.delete(at, True)
        commit(spark, path, number, token)
    return leftover(spark, path, schema).count()


#: A task's place in its group, and its window; the columns of a state.
NAMES, STATE = ("place", "window"), ("began", "used", "soon", "late")


def _part(spark: SparkSession, path: str, number: int, schema: T.StructType, budget: int, group: str, order: str, size: str) -> bool:
    """Parts what waits into windows that follow each other in every group, each of twice the budgets of the one before; whether anything waits."""
    waits = leftover(spark, path, schema)
    count = waits.count()
    at, window, before = fresh(schema.names, *NAMES, "before")
    if count:
        rows = running_sums(waits, {before: F.greatest(F.col(size), F.lit(0)), at: F.lit(1)}, [group], [order], 1 + count // RANGE_ROWS)
        doubled = F.length(F.bin(1 + F.floor(F.col(before) / (AHEAD * max(budget, 1))))) - 1
        windowed = rows.withColumn(window, doubled + F.floor(F.col(at) / STEP_ROWS).cast("int")).drop(before)
        windowed.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(window).parquet(f"{path}/far/batch={number}")
    return count > 0


def _batches(sizes: np.ndarray, tries: np.ndarray, state: tuple[int, int, int, int], budget: int) -> tuple[np.ndarray, tuple[int, int, int, int]]:
    """The batch that each task of a group begins in, and the state after them.

    A task begins while the sizes of those before it in the batch are within ``budget``, and is in as many batches as it has
    tries: it fails, comes back before those that haven't begun, and what came before it can't have grown.
    state: the batch that is open, what it has taken, and what comes back in the next one and in the one after.
    """
    number, used, soon, late = state
    before = np.concatenate(([0], np.cumsum(sizes)))
    twice, thrice = (np.concatenate(([0], np.cumsum(np.where(tries > k, sizes, 0)))) for k in (1, 2))
    began, i = np.empty(len(sizes), dtype=np.int64), 0
    while i < len(sizes):
        if used > budget:
            number, used, soon, late = number + 1, soon, late, 0
            continue
        j = min(int(np.searchsorted(before, before[i] + budget - used, side="right")), len(sizes))
        began[i:j] = number
        used, soon, late, i = used + int(before[j] - before[i]), soon + int(twice[j] - twice[i]), late + int(thrice[j] - thrice[i]), j
    return began, (number, used, soon, late)


def _began(first: int, budget: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For the sizes of a group's window and its state: the batch that each task begins in, and a row without a place for the new state."""

    def plan(tasks: pa.Table, state: pa.Table) -> pa.Table:
        tasks = tasks.sort_by("place")
        now = tuple(state[c][0].as_py() for c in STATE) if len(state) else (first, 0, 0, 0)
        began, now = _batches(tasks["size"].to_numpy(), tasks["tries"].to_numpy(), now, budget)
        some, rest = (tasks if len(tasks) else state), pa.nulls(len(tasks), pa.int64())
        groups = pa.chunked_array([*tasks["group"].chunks, *some["group"].slice(0, 1).chunks], some["group"].type)
        places = pa.chunked_array([*tasks["place"].chunks, pa.nulls(1, pa.int64())], pa.int64())
        numbers = [pa.chunked_array([pa.array(began) if c == "began" else rest, pa.array([v], pa.int64())], pa.int64()) for c, v in zip(STATE, now, strict=True)]
        return pa.table([groups, places, *numbers], names=["group", "place", *STATE])

    return plan


def _step(path: str, work: Work, budget: int, schema: T.StructType, spark: SparkSession, group: str = "case_id", order: str = "task_id", size: str = "size") -> bool:
    """Runs the batches of the next window of every group; whether there is another."""
    done = commits(spark, path)
    number, before = _next(done), max(done, default=-1)
    parted, window, most = (_step_of(done[before]) if done else None) or (number, -1, 0)
    if parted == number and not _part(spark, path, number, schema, budget, group, order, size):
        return False
    ahead = _windows(spark, path, parted, window)
    if not ahead:
        return False
    states = T.StructType([T.StructField("group", schema[group].dataType), *(T.StructField(c, T.LongType()) for c in ("place", *STATE))])
    at, _, tries, own, its, first = fresh(schema.names, *NAMES, "tries", "own", "its", "first")
    placed = T.StructType([*schema.fields, T.StructField(at, T.LongType())])  # a place tells rows apart, even those of one key

    now, ended = spark.read.schema(placed).parquet(ahead[0]), []
    for k in range(1, TRIES + 1):
        held = f"{path}/all/batch={number}/try={k}"
        _tried(work(now)).select(*placed.names).write.mode("overwrite").parquet(held)  # work is done once, whatever is read of it
        now = spark.read.schema(placed).parquet(held).where("outcome IS NULL")
        ended.append(spark.read.schema(placed).parquet(held).where("outcome IS NOT NULL").withColumn(tries, F.lit(k).cast("long")))
        if now.isEmpty():
            break
    ended = reduce(DataFrame.unionByName, ended)

    worth = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).cast("long")
    tasks = ended.select(F.col(group).alias("group"), F.col(at).alias("place"), worth.alias("size"), F.col(tries).alias("tries"))
    state = spark.createDataFrame([], states) if parted == number else spark.read.schema(states).parquet(f"{path}/began/batch={before}").where("place IS NULL")
    planned = tasks.groupBy("group").cogroup(state.groupBy("group")).applyInArrow(_began(parted, budget), states)
    planned.write.mode("overwrite").parquet(f"{path}/began/batch={number}")
    began = spark.read.schema(states).parquet(f"{path}/began/batch={number}").where("place IS NOT NULL")
    began = began.select(F.col("group").alias(own), F.col("place").alias(its), F.col("began").alias(first))
    same = F.col(group).eqNullSafe(F.col(own)) & (F.col(at) == F.col(its))
    gone = ended.join(began.hint("merge"), same).select(*schema.names, (F.col(first) + F.col(tries) - 1).cast("int").alias("batch"))
    gone.write.mode("overwrite").parquet(f"{path}/left/batch={number}")
    last = spark.read.schema(gone.schema).parquet(f"{path}/left/batch={number}").agg(F.max("batch")).first()[0]
    commit(spark, path, number, f"windows.{parted}.{ahead[0].split('=')[-1]}.{max(most, last or 0)}")
    return len(ahead) > 1


def resume(tasks: DataFrame, path: str, work: Work, budget: int, **columns: str) -> DataFrame:
    """Batches over ``tasks`` until none waits: each task once, with its attempts, how it left and in which batch.

    ``work`` must judge each task by itself, as a step hands it the tasks of many batches, and their next tries after that, and give
    them back with all columns.  The batches are those that ``batch`` would make one by one.  Called again on a path where a run broke off, it goes on after the last step.
    """
    if budget < 0:
        raise ValueError("under a budget below 0 no task begins")
    spark, schema = tasks.sparkSession, _schema(tasks)
    if not commits(spark, path):
        batch(tasks, path, work, budget, "run.0", schema, spark, **columns)
    while _step(path, work, budget, schema, spark, **columns):
        pass
    return left(spark, path, schema)


def sink(path: str, work: Work, budget: int, name: str = "stream", **columns: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: new tasks of a stream join those that wait, and a batch of work follows."""

    def put(tasks: DataFrame, number: int) -> None:
        batch(tasks, path, work, budget, f"{name}.{number}", _schema(tasks), tasks.sparkSession, **columns)

    return put
