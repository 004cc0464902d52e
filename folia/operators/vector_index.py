"""A stored index of vectors by cells: nearest neighbours by cosine from a few cells instead of all rows.

Centroids come from a bounded sample, every vector goes to the cell of its nearest centroid, and cells are
folders.  A search reads the folders of the cells nearest to its vector and ranks their rows exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.operators.retrieval import cosine

#: Rows that centroids are fitted to, rounds of that, and cells at most: together they bound what the driver and a broadcast hold.
SAMPLE_ROWS, ROUNDS, MOST_CELLS = 20_000, 12, 4096
#: Of the sample, rows that are asked for their nearest to find how many cells a search must read, how many nearest, and the share of them it must find.
ASKED, NEAREST, RECALL = 256, 10, 0.95
#: Queries that go through the cells together.
BLOCK = 2048
#: The cell of vectors without a direction (null, of zeros, or with a null or non-finite entry): nothing is near them.
NOWHERE = -1


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-300)


def _directed(vector: str):
    c = F.col(vector)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(c, lambda v: v != 0), F.lit(False))


def centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows, by rounds of nearest centroid and mean direction; an empty cell takes the row farthest from its own."""
    rng = np.random.default_rng(5)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        near = sample @ centres.T
        own = near.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = sample[np.argsort(near.max(1), kind="stable")[: len(empty)]]
        centres = _unit(sums)
    return centres


def enough_probes(sample: np.ndarray, centres: np.ndarray, recall: float = RECALL, nearest: int = NEAREST) -> int:
    """The least number of cells that hold so large a share of the nearest rows, measured within the sample.

    Among more rows the nearest are closer, so that an index of all of them finds no smaller share.
    """
    asked = sample[:ASKED]
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, : nearest + 1]
    own = (sample @ centres.T).argmax(1)
    order = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    turns = np.take_along_axis(order, own[near], axis=1)  # the turn in which a search comes to a neighbour's cell
    return next((p for p in range(1, len(centres)) if (turns < p).mean() >= recall), len(centres))


def _with_cell(rows: DataFrame, centres: np.ndarray, vector: str) -> DataFrame:
    shared, schema = rows.sparkSession.sparkContext.broadcast(centres), T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])
    at = rows.columns.index(vector)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            m = np.asarray(batch.column(at).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            cell = (m @ own.T).argmax(1).astype(np.int32) if len(own) else np.zeros(batch.num_rows, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=schema.names)

    return rows.mapInArrow(assign, schema)


def _put(rows: DataFrame, centres: np.ndarray, path: str, key: str, vector: str) -> None:
    good = _directed(vector)
    lost = rows.where(~good).withColumn("cell", F.lit(NOWHERE))
    whole = _with_cell(rows.where(good), centres, vector).unionByName(lost)
    # ranges are sampled, so a cell of very many rows is spread over several files
    whole.repartitionByRange("cell", key).sortWithinPartitions("cell", key).write.mode("append").partitionBy("cell").parquet(f"{path}/cells")


def create(vectors: DataFrame, path: str, cells: int | None = None, key: str = "vec_id", vector: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> None:
    """Writes the index of ``vectors`` with all their columns (none of them may be named cell), about the square root of their number of cells.

    How many cells a search must read is measured on the sample (``enough_probes``).  All vectors with a direction must be of one length.  An empty table gives an index that finds nothing.
    """
    spark, good = vectors.sparkSession, _directed(vector)
    some = vectors.where(good).orderBy(F.xxhash64(key), key).select(vector).limit(sample_rows).collect()
    n = vectors.count() if cells is None else 0
    sample = _unit(np.asarray([r[0] for r in some], np.float64)) if some else np.zeros((0, 0))
    count = min(MOST_CELLS, max(1, cells if cells is not None else round(n**0.5)))
    centres = centroids(sample, count) if some else sample
    probes = enough_probes(sample, centres) if some else 1
    table = spark.createDataFrame([(k, c.tolist(), probes) for k, c in enumerate(centres)], "cell int, centre array<double>, probes int")
    table.coalesce(1).write.mode("errorifexists").parquet(f"{path}/centroids")
    spark.createDataFrame([], vectors.schema).write.parquet(f"{path}/layout")
    _put(vectors, centres, path, key, vector)


def add(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding") -> None:
    """Puts new rows into the cells; centroids stay as they are."""
    _put(vectors, _centres(vectors.sparkSession, path)[0], path, key, vector)


def _centres(spark: SparkSession, path: str) -> tuple[np.ndarray, int]:
    """The centroids and how many cells a search reads unless told otherwise."""
    rows = sorted(spark.read.parquet(f"{path}/centroids").collect())  # MOST_CELLS at most
    return (np.asarray([r["centre"] for r in rows]), rows[0]["probes"]) if rows else (np.zeros((0, 0)), 1)


def _cells(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/layout").schema
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("cell", T.IntegerType())])).parquet(f"{path}/cells")


def _nearest_cells(centres: np.ndarray, queries: np.ndarray, probes: int) -> np.ndarray:
    """A row of cell numbers for each query, ties by number."""
    return np.argsort(-(queries @ centres.T), axis=1, kind="stable")[:, :probes]


def search(spark: SparkSession, path: str, query: list[float], k: int, probes: int | None = None, where=None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, similarity) of the k nearest rows in the ``probes`` cells nearest to the query (or as many as were found enough), of those that ``where`` holds for; ties by key.

    With as many probes as cells this is the exact search.
    """
    centres, enough = _centres(spark, path)
    near = _nearest_cells(centres, np.asarray([query], float), probes or enough)[0].tolist() if len(centres) else []
    rows = _cells(spark, path).where(F.col("cell").isin(near) if near else F.lit(False))
    if where is not None:
        rows = rows.where(where)
    return rows.select(key, F.round(cosine(F.col(vector), query), 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def search_many(queries: DataFrame, path: str, k: int, probes: int | None = None, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query, key, similarity, place from 1) of the k nearest rows of each row of ``queries`` (key, vector), itself among them.

    Queries go in blocks through the union of their cells; tasks keep the k best of each query, and these are ranked at last.  A query without a
    direction, or a repeated one, gives no row, or one set of rows.
    """
    spark, (centres, enough) = queries.sparkSession, _centres(queries.sparkSession, path)
    kind = queries.schema[key].dataType
    schema = T.StructType([T.StructField("query", kind), T.StructField(key, kind), T.StructField("similarity", T.DoubleType())])
    asked = queries.where(_directed(vector)).dropDuplicates([key]).select(key, vector)
    parts = -(-asked.count() // block)
    found = [_block(asked.where(F.pmod(F.xxhash64(key), F.lit(parts)) == p), path, centres, k, probes or enough, key, vector, schema) for p in range(parts)] if len(centres) else []
    whole = found[0] if found else spark.createDataFrame([], schema)
    for more in found[1:]:
        whole = whole.unionByName(more)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key))
    return whole.withColumn("place", place).where(F.col("place") <= k)


def _block(asked: DataFrame, path: str, centres: np.ndarray, k: int, probes: int, key: str, vector: str, schema: T.StructType) -> DataFrame:
    spark, rows = asked.sparkSession, sorted(asked.collect())  # about a block
    ids = [r[0] for r in rows]
    vectors = _unit(np.asarray([r[1] for r in rows], np.float64).reshape(len(rows), centres.shape[1]))
    near = _nearest_cells(centres, vectors, probes)
    of = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
    shared = spark.sparkContext.broadcast((ids, vectors, of))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, of = shared.value
        kept: dict[int, list[tuple[float, object]]] = {}
        worst = np.full(len(ids), -np.inf)  # the similarity of the last of a query's k rows
        for batch in batches:
            cells, keys = batch.column(2).to_numpy(zero_copy_only=False), batch.column(0)
            m = _unit(np.asarray(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1))
            for cell in np.unique(cells):
                here = np.flatnonzero(cells == cell)
                names = np.asarray(keys.take(pa.array(here)).to_pylist(), object)
                scores = np.round(m[here] @ vectors[of[int(cell)]].T, 6)
                asked = of[int(cell)]
                least = np.partition(scores, -k, axis=0)[-k] if len(here) > k else np.full(len(asked), -np.inf)
                near = scores >= np.maximum(least, worst[asked])  # the others are behind k rows already
                for j in np.flatnonzero(near.any(0)).tolist():
                    q, some = int(asked[j]), np.flatnonzero(near[:, j])
                    own = zip((-scores[some, j]).tolist(), names[some].tolist(), strict=True)
                    kept[q] = sorted([*kept.get(q, ()), *own], key=lambda r: (r[0], r[1] is None, r[1]))[:k]
                    if len(kept[q]) == k:
                        worst[q] = -kept[q][-1][0]
        for q, own in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([ids[q]] * len(own), batch.column(0).type), pa.array([n for _, n in own], batch.column(0).type), pa.array([-s for s, _ in own], pa.float64())], names=schema.names)

    return _cells(spark, path).where(F.col("cell").isin(sorted(of))).select(key, vector, "cell").mapInArrow(best, schema)
