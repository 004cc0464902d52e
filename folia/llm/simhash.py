"""SimHash near-duplicates by the generalised pigeonhole principle.

Sixty-four-bit fingerprints link at ``RADIUS`` or fewer differing bits.  Correlated bits are
grouped into parts, and a dynamic programme allots each part its own threshold t so that the
sum of t + 1 is RADIUS + 1: two linked fingerprints then agree, within t, on at least one part.
Fingerprints are probed part by part and every candidate is verified on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.llm.common import LOWER, by_bytes, fresh, lean, written
from folia.llm.components import connected_components

SHINGLE = 4
RADIUS = 4
BITS = 64
#: Fingerprints from which bit correlations and candidate counts are estimated.
SAMPLE = 4096
#: Rows of one part value that are compared in one task; larger groups are refined or split.
GROUP_ROWS = 8192
#: Cost of a probe row, in compared candidates.
PROBE_COST = 60.0
#: Ids of rows that go which are broadcast, at most (some 40 bytes each); more of them are joined.
FEW_IDS = 1_000_000
#: Candidates that are compared at once.
CHUNK = 1 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text; zero without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.asarray([xxhash.xxh64_intdigest(b" ".join(words), 42)], "<u8")
    else:
        joined = b" ".join(words)
        ends = (np.fromiter(map(len, words), np.int64, len(words)) + 1).cumsum()
        first = [0, *ends[: -shingle].tolist()]
        grams = [joined[a:b] for a, b in zip(first, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), "<u8", len(grams))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): a row for each of ``docs``; fp holds the 64 bits as a signed long."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, n in by_bytes(whole.column(1), 8_000_000):
                batch = whole.slice(at, n)
                fps = np.asarray([fingerprint(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()], "<u8")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("<i8"))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(lean(make), schema)


def hex_of(fp: str):
    """A signed long's 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """``parts`` groups of bits, of nearly equal size; each bit joins the group it correlates with most."""
    bits = _bits_of(sample).astype(np.float64)
    if len(bits) < 2:
        return [list(range(BITS * k // parts, BITS * (k + 1) // parts)) for k in range(parts)]
    dev = bits - bits.mean(0)
    norm = np.sqrt((dev**2).sum(0)) + 1e-9
    corr = np.abs(dev.T @ dev) / np.outer(norm, norm)
    left, out = set(range(BITS)), []
    for k in range(parts):
        room = BITS * (k + 1) // parts - BITS * k // parts
        seed = max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))
        own = [seed]
        left.discard(seed)
        while len(own) < room:
            best = max(left, key=lambda b: (corr[b, own].sum(), -b))
            own.append(best)
            left.discard(best)
        out.append(sorted(own))
    return out


def _near_share(sample: np.ndarray, bits: list[int], most: int) -> list[float]:
    """By threshold 0..most, the share of pairs that agree on ``bits`` within it, from the sample."""
    own = _bits_of(sample)[:, bits].astype(np.float64)
    n = len(own)
    one = own.mean(0) if n else np.full(len(bits), 0.5)
    differ = 2 * one * (1 - one)
    chance = np.zeros(len(bits) + 1)  # by number of differing bits, were bits independent
    chance[0] = 1
    for p in differ:
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
    seen = np.zeros(len(bits) + 1)
    if n > 1:
        dots = own @ own.T
        ones = own.sum(1)
        distance = (ones[:, None] + ones[None] - 2 * dots).round().astype(np.int64)
        seen = (np.bincount(distance[np.triu_indices(n, 1)], minlength=len(bits) + 1) / (n * (n - 1) / 2))[: len(bits) + 1]
    return [float(max(seen[: t + 1].sum(), chance[: t + 1].sum())) for t in range(most + 1)]


def allot(sample: np.ndarray, total: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Parts (bits, threshold) of least estimated cost for ``total`` fingerprints; a threshold of -1 is left out.

    The dynamic programme runs over parts and the sum of thresholds + 1 spent so far; the cost of a threshold is its
    probes' and the estimated number of candidates that they meet.
    """
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    few = sample[:1024]
    for m in range(1, radius + 2):
        parts = group_bits(few, m)
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in parts:
            share = _near_share(few, bits, radius)
            cost = [0.0] + [PROBE_COST * total * sum(comb(len(bits), j) for j in range(t + 1)) + total * total * share[t] for t in range(radius + 1)]
            new: dict[int, tuple[float, list[int]]] = {}
            for spent, (c, ts) in state.items():
                for t1 in range(radius + 2 - spent):  # t + 1
                    if spent + t1 not in new or c + cost[t1] < new[spent + t1][0]:
                        new[spent + t1] = (c + cost[t1], [*ts, t1 - 1])
            state = new
        c, ts = state[radius + 1]
        if c < best[0]:
            best = (c, [(bits, t) for bits, t in zip(parts, ts, strict=True) if t >= 0])
    return best[1]


@cache
def _flips(bits: tuple[int, ...], t: int) -> np.ndarray:
    """Masks of 1 to t of the bits."""
    return np.asarray([sum(1 << b for b in some) for j in range(1, t + 1) for some in combinations(bits, j)], "<u8")


def _mask(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def _mixed(part: int, value: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit key of a part's number and value (a bijection for each part)."""
    with np.errstate(over="ignore"):
        x = value + np.uint64((0x9E3779B97F4A7C15 * (part + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


KEYED = "key long, probe boolean, fp long"


def _keys(parts: list[tuple[list[int], int]]):
    """Each fingerprint under its own value of every part, and as a probe under the values within the threshold."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                fps = whole.column(0).slice(at, 2000).to_numpy().view("<u8")
                for k, (bits, t) in enumerate(parts):
                    own = fps & _mask(bits)
                    yield _keyed(_mixed(k, own), False, fps)
                    if t > 0:
                        flips = _flips(tuple(bits), t)
                        yield _keyed(_mixed(k, (own[:, None] ^ flips[None]).ravel()), True, np.repeat(fps, len(flips)))

    return make


def _keyed(keys: np.ndarray, probe: bool, fps: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view("<i8")), pa.array(np.full(len(keys), probe)), pa.array(fps.view("<i8"))], names=["key", "probe", "fp"])


class _Forest:
    """Union-find over fingerprints that keeps the links which joined two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((x, y))


def _spread(fps: np.ndarray, radius: int, forest: _Forest) -> None:
    """Links of one large group, by breadth-first search: only a spanning forest comes out."""
    left = np.unique(fps)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                for y in found:
                    forest.join(int(x), int(y))
                queue.extend(found)


def _linked(keys: np.ndarray, probe: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among rows of equal keys; rows come sorted by key, own values first."""
    forest = _Forest()
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    own = np.add.reduceat((~probe).astype(np.int64), starts)
    large = sizes * own > CHUNK // 8
    for s, n in zip(starts[large].tolist(), sizes[large].tolist(), strict=True):
        _spread(fps[s : s + n], radius, forest)
    ok = np.repeat(~large & (sizes > 1), sizes) & ~probe
    rows = np.flatnonzero(ok)
    ends = np.repeat(starts + sizes, sizes)[rows]
    todo = ends - rows - 1  # each own value meets the rows after it in its group
    rows, ends, todo = rows[todo > 0], ends[todo > 0], todo[todo > 0]
    upto = todo.cumsum()
    at = 0
    while at < len(rows):
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(upto.searchsorted(before + CHUNK, "right")))
        n = todo[at:end]
        left = np.repeat(rows[at:end], n)
        right = left + 1 + np.arange(len(left)) - np.repeat(n.cumsum() - n, n)
        near = np.flatnonzero(np.bitwise_count(fps[left] ^ fps[right]) <= radius)
        for x, y in zip(fps[left[near]].tolist(), fps[right[near]].tolist(), strict=True):
            if x != y:
                forest.join(x, y)
        at = end
    return forest.links


def _link_groups(radius: int):
    """Links within the groups of a sorted partition; a group is held whole, at most GROUP_ROWS rows of it."""

    def out(keys: np.ndarray, probe: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        links = np.asarray(_linked(keys, probe, fps.view("<u8"), radius), "<u8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy().view("<i8")), pa.array(links[:, 1].copy().view("<i8"))], names=["a", "b"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1], "left")) if len(now[0]) else 0
            if cut:
                yield out(*(x[:cut] for x in now))
            held = [x[cut:] for x in now]
        if held is not None and len(held[0]):
            yield out(*held)

    return make


def links(fps: DataFrame, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): links among the distinct ``fp`` of ``fps``, enough of them to connect what is connected."""
    spark = fps.sparkSession
    total = fps.count()
    some = fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()
    parts = allot(np.asarray([r["fp"] for r in some], "<i8").view("<u8"), total, radius)
    keyed = fps.select("fp").mapInArrow(lean(_keys(parts)), KEYED)
    n = keyed.groupBy("key").count().where(F.col("count") > group_rows)
    heavy = written(n, "heavy_keys")  # one row for each group_rows rows at most
    if heavy.isEmpty():
        return _compared(keyed, radius)
    light = keyed.join(heavy, "key", "left_anti")
    return _compared(light, radius).union(_heavy_links(keyed.join(heavy, "key").select("key", "probe", "fp"), radius, group_rows))


def _compared(keyed: DataFrame, radius: int) -> DataFrame:
    return keyed.repartition("key").sortWithinPartitions("key", "probe").mapInArrow(lean(_link_groups(radius)), "a long, b long")


def _heavy_links(keyed: DataFrame, radius: int, group_rows: int) -> DataFrame:
    """Groups of more than ``group_rows`` rows: refined by 5 parts of all bits, then split into pairs of blocks.

    Within a group, linked fingerprints agree on at least one of radius + 1 further parts.
    What stays too large is compared block by block, each pair of blocks in a group of its own.
    """
    finer = group_bits(np.zeros(0, "<u8"), radius + 1)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, probe, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for k, bits in enumerate(finer):
                value = _mixed(k, fps.view("<u8") & _mask(bits)) ^ keys.view("<u8")
                yield pa.RecordBatch.from_arrays([pa.array(_mixed(k, value).view("<i8")), pa.array(probe), pa.array(fps)], names=["key", "probe", "fp"])

    fine = written(keyed.mapInArrow(lean(refine), KEYED), "refined")
    blocks = fine.groupBy("key").count().select("key", F.ceil(F.col("count") / (group_rows // 2)).cast("int").alias("blocks"))
    placed = fine.join(blocks.where("blocks > 2"), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    placed = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    placed = placed.select(F.when(F.col("blocks") > 1, pair).otherwise(F.col("key")).alias("key"), "probe", "fp")
    return _compared(placed, radius)


def near_groups(docs: DataFrame, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, fp, component_id): a row for each row of ``docs``.

    component_id is the smallest doc_id reachable over links of ``radius`` or fewer bits, the
    row's own included (null doc_ids count only where there are no others).  Null and empty
    texts have fingerprint zero and link like any other; an empty table gives an empty one.
    """
    rows = written(fingerprints(docs), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    roots = connected_components(links(nodes.select("fp"), radius, group_rows))
    own = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    own = written(own, "roots")
    least = written(own.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = own.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id, all columns unchanged.

    Where several rows of a group share that doc_id (repeated rows, or null ids alone) one of them stays.  Null and
    empty texts are a group, long ones count whole, an empty table gives an empty one, and extra columns may have any names.
    """
    groups = written(near_groups(docs, radius), "near_groups")
    n, ids = groups.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids:  # no id is null or repeated
        gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
        if gone.limit(FEW_IDS + 1).count() <= FEW_IDS:  # the texts stay where they are
            gone = F.broadcast(gone)
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    rid, fp, own, none = fresh(docs.columns, "row", "fp", "component", "none")
    rows = written(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")
    marked = fingerprints(rows.select(F.struct("doc_id", rid).alias("doc_id"), "text")).select("doc_id.*", F.col("fp").alias(fp))
    marked = marked.join(groups.select(F.col("fp").alias(fp), F.col("component_id").alias(own)).distinct(), fp).where(F.col("doc_id").eqNullSafe(F.col(own)))
    roots = marked.groupBy(own, F.when(F.col(own).isNull(), F.col(fp)).alias(none)).agg(F.min(rid).alias(rid))
    return rows.join(roots.select(rid), rid, "left_semi").select(*docs.columns)
