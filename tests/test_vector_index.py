"""Cells: exact with all of them, recall with a few, pruned reads, and vectors without a direction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folia.operators import retrieval
from folia.operators import vector_index as vx

KIND = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    return [(i, (centres[i % 30] + 0.4 * rng.standard_normal(16)).astype("float32").tolist(), i % 3) for i in range(3000)]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('vx')}/index"
    odd = [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] + [1.0] * 15, 0), (9004, [None] * 16, 0)]
    vx.create(spark.createDataFrame(rows[:2500] + odd, KIND), path, cells=40, sample_rows=800)
    vx.add(spark.createDataFrame(rows[2500:], KIND), path)
    return path


def test_all_cells_are_exact(spark, rows, index):
    df = spark.createDataFrame(rows, KIND)
    for i in (0, 7, 2999):
        want = retrieval.vector_search(df, rows[i][1], 10, 2).collect()
        assert vx.search(spark, index, rows[i][1], 10, 40, F.col("label") == 2).collect() == want
    assert spark.read.parquet(f"{index}/cells").count() == 3004


def exact(rows, query, k):
    m = np.asarray([r[1] for r in rows], float)
    s = np.round(m @ np.asarray(query, float) / np.linalg.norm(m, axis=1) / np.linalg.norm(query), 6)
    return sorted(zip((-s).tolist(), (r[0] for r in rows), strict=True))[:k]


@pytest.mark.parametrize("block", [vx.BLOCK, 7])
def test_many_queries(spark, rows, index, block):
    queries = spark.createDataFrame([rows[i] for i in range(0, 3000, 100)] + [rows[0], (-1, None, 0)], KIND)
    want = {rows[i][0]: exact(rows, rows[i][1], 10) for i in range(0, 3000, 100)}
    got = {}
    for r in vx.search_many(queries, index, 10, 40, block=block).collect():
        got.setdefault(r["query"], []).append((r["place"], -r["similarity"], r["vec_id"]))
    assert {q: [(s, i) for _, s, i in sorted(x)] for q, x in got.items()} == want
    few = vx.search_many(queries, index, 10, block=block).collect()
    hits = sum((r["query"], r["vec_id"]) in {(q, i) for q, x in want.items() for _, i in x} for r in few)
    assert hits >= 0.9 * 10 * len(want)


def test_cells_are_pruned(spark, rows, index):
    plan = vx.search(spark, index, rows[0][1], 10, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan
    assert vx.search(spark, index, rows[0][1], 3000, 3).count() < 1000


def test_a_hot_vector_and_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}/hot"
    same = [(i, [1.0, 0.0], 0) for i in range(400)] + [(900 + i, [0.0, 1.0 + i], 1) for i in range(5)]
    vx.create(spark.createDataFrame(same, KIND), path)
    got = vx.search(spark, path, [1.0, 0.0], 3, 1).collect()
    assert [(r["vec_id"], r["similarity"]) for r in got] == [(0, 1.0), (1, 1.0), (2, 1.0)]
    empty = f"file://{tmp_path}/empty"
    vx.create(spark.createDataFrame([], KIND), empty)
    assert vx.search(spark, empty, [1.0, 0.0], 3).collect() == [] == vx.search_many(spark.createDataFrame(same, KIND), empty, 3).collect()
