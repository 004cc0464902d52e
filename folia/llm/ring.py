"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys arrive in the order of their ring positions.  A key goes to the shard of the next virtual
node clockwise; where that shard is full, it continues clockwise to the first one with room.
How many keys of each arc end up where depends only on the arcs' counts, which are as many as
there are virtual nodes times ``PARTS``, whatever the number of rows; rows then find their place
by their rank within the arc.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.llm.common import fresh, lean, written

VIRTUAL_NODES = 128
#: Each arc is counted in so many parts, so that its keys are ranked by several tasks.
PARTS = 8


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions (unsigned 64-bit) of the virtual nodes, and the shard of each."""
    nodes = sorted((xxhash.xxh64_intdigest(f"shard {s} node {v}"), s) for s in range(shards) for v in range(virtual_nodes))
    return np.asarray([p for p, _ in nodes], np.uint64), np.asarray([s for _, s in nodes], np.int32)


def capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most keys by shard: equal shares, which differ by at most one and add up to the total, plus ``slack``."""
    return [int((total // shards + (s < total % shards)) * (1 + slack)) for s in range(shards)]


def flow(counts: dict[tuple[int, int], int], owners: np.ndarray, room: list[int]) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
    """By arc and part, (first rank, shard, first slot): ranks from each first one on go there.

    ``counts`` are the keys by (arc, part); an arc's keys enter at its own virtual node.
    """
    room, used = list(room), [0] * len(room)
    nodes = len(owners)
    beyond = list(range(1, nodes + 1))  # the next node that may have room, with path compression

    def open_from(at: int) -> int:
        seen = []
        for _ in range(2 * nodes + 2):
            at %= nodes
            if room[owners[at]] > 0:
                for x in seen:
                    beyond[x] = at if at > x else at + nodes
                return at
            seen.append(at)
            at = beyond[at]
        raise ValueError("the shards have less room than there are keys")

    out = {}
    for arc, part in sorted(counts):
        left, rank, at, places = counts[arc, part], 0, arc, []
        while left:
            at = open_from(at)
            shard = int(owners[at])
            n = min(left, room[shard])
            places.append((rank, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
            rank += n
            left -= n
        out[arc, part] = places
    return out


def assign(rows: DataFrame, shards: int, key: str = "doc_id", slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """``rows`` with shard (int, 0 to shards - 1) and slot (long, gapless from 0 within the shard).

    A key's place on the ring is the hash of the column ``key`` as text (null: as empty text).
    With ``slack`` 0 the shards' counts differ by at most one.  Rows of equal keys stay together
    while there is room; equal rows are interchangeable.  An empty table gives an empty one.
    Columns named shard and slot in the input are replaced; any other names may be in use.
    """
    arc_, hash_, key_, part_, rank_ = fresh(rows.columns, "arc", "hash", "key", "part", "rank")
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    positions, owners = ring(shards, virtual_nodes)
    at = names.index(key)
    marked = T.StructType([*(rows.schema[c] for c in names), T.StructField(arc_, T.IntegerType()), T.StructField(hash_, T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.asarray([xxhash.xxh64_intdigest(x) for x in batch.column(len(names)).cast(pa.binary()).to_pylist()], np.uint64)
            arcs = np.searchsorted(positions, hashes, "left") % len(positions)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(arcs.astype(np.int32)), pa.array(hashes.view(np.int64))], names=marked.names)

    text = F.coalesce(F.col(names[at]).cast("string"), F.lit(""))
    kept = written(rows.select(*names, text.alias(key_)).mapInArrow(lean(place), marked), "ring").withColumn(part_, F.pmod(F.xxhash64(*names), F.lit(PARTS)).cast("int"))
    counts = {(r[arc_], r[part_]): r["count"] for r in kept.groupBy(arc_, part_).count().collect()}  # nodes x PARTS rows at most
    plan = flow(counts, owners, capacities(sum(counts.values()), shards, slack))
    shared = kept.sparkSession.sparkContext.broadcast({k: ([p[0] for p in places], places) for k, places in plan.items()})
    ranked = kept.withColumn(rank_, F.row_number().over(Window.partitionBy(arc_, part_).orderBy(hash_, *names)) - 1)
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            to, slot = [], []
            for arc, part, rank in zip(*(batch.column(len(names) + k).to_pylist() for k in range(3)), strict=True):
                firsts, places = found[arc, part]
                first, shard, start = places[bisect.bisect_right(firsts, rank) - 1]
                to.append(shard)
                slot.append(start + rank - first)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(to, pa.int32()), pa.array(slot, pa.int64())], names=schema.names)

    return ranked.select(*names, arc_, part_, rank_).mapInArrow(lean(send), schema)
