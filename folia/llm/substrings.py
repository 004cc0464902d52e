"""Exact substring dedup: bytes covered by a 50-byte string of an earlier document go.

Sorting all suffixes of a corpus isn't needed to compare strings of bounded width.  Each window of
``WIDTH`` bytes names its least-hashed q-gram (its anchor), so that equal windows name equal
q-grams at equal places.  Documents first exchange only their anchors' hashes, one for each batch of
documents; windows whose anchor no other document has are done.  For the others the text around
the anchor is brought together by anchor, and bucket-pointer refinement tells their windows apart: buckets of
8-byte q-grams are refined by the bucket pointers at later offsets, recursively.

Copies of a whole text are settled beforehand, by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.llm.common import by_bytes, fresh, lean, written

WIDTH = 50
#: Bytes of the q-gram that a window is found by.
GRAM = 24
#: Bytes of text for each partition of the exchange of anchors.
PART_BYTES = 12_000_000
#: Contexts of one partition of the exchange of contexts, and bytes of them that are refined together.
PART_CONTEXTS = 40_000
BUCKET_BYTES = 1_000_000
#: Anchors with more contexts than this are compared window by window instead.
HOT_CONTEXTS = 100_000
#: A null doc_id counts as this.
LAST = (1 << 63) - 1

_TOP = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)


class Anchors(NamedTuple):
    """The anchors of a text, in order: place, hash, and the first and last window start that name each."""

    place: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    last: np.ndarray


def anchors(text: bytes, width: int = WIDTH, gram: int = GRAM) -> Anchors | None:
    """None for a text of fewer than ``width`` bytes.  ``gram`` is at least 16."""
    n = len(text)
    if n < width:
        return None
    words = np.ndarray((n - 7,), "<u8", text, 0, (1,)).copy()
    k = n - gram + 1
    h = words[:k] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for at in (*range(8, gram - 8, 8), gram - 8):
        h += words[at : at + k]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    least = (h & _TOP) | np.arange(k, dtype=np.uint64)
    size, want = 1, width - gram + 1
    while 2 * size <= want:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < want:
        least = np.minimum(least[: len(least) - (want - size)], least[want - size :])
    place = (least & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return Anchors(place[first], h[place[first]], first, np.concatenate((first[1:], [len(place)])) - 1)


def _ord(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def _key(hashes: np.ndarray, parts: int) -> np.ndarray:
    """An anchor's part and the low half of its hash: what tells anchors apart in the exchange."""
    return (hashes >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | hashes & _LOW


def _exchange(width: int, gram: int, parts: int):
    """Each batch's distinct anchors, one row for each part; anchors of several texts of the batch come out flagged."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, n in by_bytes(whole.column(1), 8_000_000):
                batch = whole.slice(at, n)
                order, texts = _ord(batch.column(0)), batch.column(1).cast(pa.binary()).to_pylist()
                first: dict[bytes, int] = {}
                for row in np.argsort(order, kind="stable").tolist():
                    first.setdefault(texts[row] or b"", row)  # of equal texts, the one of the smallest id
                found = [(row, a) for text, row in first.items() if (a := anchors(text, width, gram))]
                if not found:
                    continue
                hashes = np.concatenate([a.hash for _, a in found])
                places = np.concatenate([a.place for _, a in found]).astype(np.uint32)
                ids = np.repeat(order[[row for row, _ in found]], [len(a.hash) for _, a in found])
                texts_of = np.repeat(np.arange(len(found)), [len(a.hash) for _, a in found])
                sort = np.lexsort((texts_of, hashes))
                hashes, places, ids, texts_of = hashes[sort], places[sort], ids[sort], texts_of[sort]
                new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
                own = np.concatenate(([True], new[1:] | (texts_of[1:] != texts_of[:-1])))  # once for each text
                group = new.cumsum() - 1
                texts_in = np.bincount(group[own])
                shared = own & (texts_in[group] > 1)
                yield _rows([-1], [ids[shared]], [_key(hashes[shared], parts)], [places[shared]])
                hashes, places, ids = hashes[new], places[new], ids[new]
                part = (_key(hashes, parts) >> np.uint64(32)).astype(np.int64)
                sort = np.lexsort((places, ids, part))
                part, hashes, places, ids = part[sort], hashes[sort], places[sort], ids[sort]
                edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
                cut = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                yield _rows([int(part[a]) for a, _ in cut], [ids[a:b] for a, b in cut], [(hashes[a:b] & _LOW).astype("<u4") for a, b in cut], [places[a:b] for a, b in cut])

    return make


_EXCHANGED = "part int, ids binary, hashes binary, places binary"


def _planes(x: np.ndarray) -> bytes:
    """An array's bytes by significance, as the high ones of small numbers are all zero and compress away."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _rows(part, ids, hashes, places) -> pa.RecordBatch:
    ids = [_planes(np.diff(x, prepend=0).astype("<i8")) for x in ids]
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(ids, pa.binary()), pa.array([x.tobytes() for x in hashes], pa.binary()), pa.array([_planes(x.astype("<u4")) for x in places], pa.binary())], names=["part", "ids", "hashes", "places"])


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, place, key) of the anchors that more than one batch has, and those flagged before."""

    def out(ids: np.ndarray, places: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(places.astype(np.int32)), pa.array(keys.astype(np.int64))], names=["ord", "place", "key"])

    held: list[tuple[int, pa.Scalar, pa.Scalar]] = []  # as they came; places are unpacked once it is known which are wanted
    keys = []
    for batch in batches:
        for part, i, h, p in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
            if part < 0:
                i, p = _from_planes(i.as_py(), "<i8").cumsum(), _from_planes(p.as_py(), "<u4")
                for at in range(0, len(i), 100_000):
                    yield out(i[at : at + 100_000], p[at : at + 100_000], np.frombuffer(h.as_py(), "<u8")[at : at + 100_000])
            else:
                keys.append(np.frombuffer(h.as_py(), "<u4"))
                held.append((part, i, p))
    if not keys:
        return
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    parts = np.fromiter((part for part, _, _ in held), np.uint64, len(held))
    keys = np.concatenate(keys).astype(np.uint64) | np.repeat(parts << np.uint64(32), sizes)
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    del order
    at = 0
    for n, (_, i, p) in zip(sizes.tolist(), held, strict=True):
        own = keys[at : at + n]
        shared = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own) if len(twice) else ()
        if len(shared):
            yield out(_from_planes(i.as_py(), "<i8").cumsum()[shared], _from_planes(p.as_py(), "<u4")[shared], own[shared])
        at += n


_CONTEXT = T.StructType([T.StructField("key", T.LongType()), T.StructField("ord", T.LongType()), T.StructField("row", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("at", T.IntegerType()), T.StructField("context", T.BinaryType())])
_ARROW = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary())


def _contexts(width: int, gram: int, parts: int, hot: frozenset[int], only_hot: bool):
    """The bytes of all windows that name a flagged anchor: ``at`` is the anchor's place in them, ``starts`` theirs in the text.

    A batch sends each context once, for the text of the smallest id in it.  Its other texts
    lose all windows of it; their rows have the length of the context for ``at`` and no context.
    """
    barred = np.asarray(sorted(hot), np.int64)

    def send(found: dict[tuple[int, int, bytes], list[tuple[int, int, list[int]]]]) -> pa.RecordBatch:
        out: list[tuple] = []
        for (key, at, context), places in found.items():
            least = min(places)
            out.append((key, *least, at, context))
            out += [(_spread_key(row, starts[0]), ord_, row, starts, len(context), None) if ord_ > least[0] else (key, ord_, row, starts, at, context) for ord_, row, starts in places if row != least[1]]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(_ARROW)], names=_CONTEXT.names)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for begin, size in by_bytes(whole.column(2), 1_500_000):  # compressed
                found: dict[tuple[int, int, bytes], list[tuple[int, int, list[int]]]] = {}
                for ord_, row, text, places in zip(*(c.to_pylist() for c in whole.slice(begin, size).columns), strict=True):
                    text = unpack(text)
                    a = anchors(text, width, gram)
                    if a is None:
                        continue
                    mine = np.flatnonzero(np.isin(a.hash, a.hash[np.isin(a.place, places)]))
                    keys = _key(a.hash[mine], parts).astype(np.int64)
                    if len(barred) or only_hot:
                        some = np.isin(keys, barred) == only_hot
                        mine, keys = mine[some], keys[some]
                    first = a.first[mine]
                    for key, at, x, y in zip(keys.tolist(), (a.place[mine] - first).tolist(), first.tolist(), a.last[mine].tolist(), strict=True):
                        own = found.setdefault((key, at, text[x : y + width]), [])
                        if own and own[-1][1] == row:
                            own[-1][2].append(x)
                        else:
                            own.append((ord_, row, [x]))
                if found:
                    yield send(found)

    return make


def _spread_key(row: int, start: int) -> int:
    """Deals settled ranges out evenly."""
    return (row * 0x9E3779B97F4A7C15 + start * 0xC2B2AE3D27D4EB4F) >> 7 & (1 << 62) - 1


def refine(contexts: list[bytes], group: np.ndarray, least: np.ndarray, width: int = WIDTH, bucket_bytes: int = BUCKET_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, from, to) of the bytes of contexts whose windows another context of a smaller ``least`` has.

    Equal windows are in contexts of one ``group``, so runs of whole groups are refined apart, in about
    ``bucket_bytes`` bytes at a time.
    """
    order = np.argsort(group, kind="stable")
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))[order]
    ends = np.flatnonzero(np.diff(group[order], append=-1)) + 1  # of groups
    upto = np.append(0, sizes.cumsum())
    found, at = [], 0
    while at < len(order):
        end = int(ends[max(np.searchsorted(ends, at, "right"), np.searchsorted(upto[ends], upto[at] + bucket_bytes, "right") - 1)])
        some = order[at:end]
        context, begin, stop = _refined([contexts[k] for k in some.tolist()], least[some], width)
        found.append((some[context], begin, stop))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _refined(contexts: list[bytes], least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket-pointer refinement of the contexts' suffixes to the depth of ``width`` bytes.

    The initial buckets are those of the 8-byte q-grams.  A round refines the buckets of several members: each member's
    pointer is paired with the pointer at the place as many bytes on as the buckets are deep, the
    pairs are sorted, and their ranks become the members' new pointers.  Those are what the next round
    pairs, so each round doubles the depth.  A suffix alone in its bucket keeps its pointer.
    """
    raw = b"".join(contexts) + bytes(8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    upto = sizes.cumsum()
    room = np.repeat(upto, sizes) - np.arange(len(raw) - 8)  # bytes from a place to the end of its context
    grams = np.ndarray((len(raw) - 8,), "<u8", raw, 0, (1,))
    depth = 8
    places = np.flatnonzero(room >= depth)
    pointer = np.full(len(room), -1, np.int64)
    pointer[places], many = _ranks(grams[places], 0)
    places = places[many > 1]
    while depth < width:
        step = min(depth, width - depth)
        places = places[room[places] >= depth + step]
        top = int(pointer.max()) + 1
        pointer[places], many = _ranks(pointer[places] * top + pointer[places + step], top)
        places = places[many > 1]
        depth += step
    owner = np.searchsorted(upto, places, "right")
    first = np.full(int(pointer.max()) + 1, LAST)
    np.minimum.at(first, pointer[places], least[owner])
    gone = np.zeros(len(room) + 2, bool)
    gone[places + 1] = first[pointer[places]] < least[owner]
    begin, stop = np.flatnonzero(gone[1:] & ~gone[:-1]), np.flatnonzero(gone[:-1] & ~gone[1:])  # no run crosses contexts: each one's last places have no room
    context = np.searchsorted(upto, begin, "right")
    shift = upto[context] - sizes[context]
    return context, begin - shift, stop - 1 + width - shift


def _ranks(values: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The values' ranks among the distinct ones, counted from ``start``, and how often each value occurs."""
    order = np.argsort(values)
    new = np.flatnonzero(np.diff(values[order], prepend=~values[order[:1]]))
    sizes = np.diff(np.append(new, len(order)))
    ranks, many = np.empty((2, len(order)), np.int64)
    ranks[order] = np.repeat(np.arange(start, start + len(new)), sizes)
    many[order] = np.repeat(sizes, sizes)
    return ranks, many


def _settle(width: int, gram: int):
    """Byte ranges to remove, from contexts of equal anchors: (ord, row, from, to)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where: dict[tuple[bytes, int], int] = {}
        of, ords, rows, starts, many = [], [], [], [], []
        for batch in batches:
            done = batch.filter(batch.column(5).is_null())
            if done.num_rows:
                n = np.diff(done.column(3).offsets.to_numpy())
                begin = done.column(3).flatten().to_numpy()
                yield _ranges(np.repeat(done.column(1).to_numpy(), n), np.repeat(done.column(2).to_numpy(), n), begin, begin + np.repeat(done.column(4).to_numpy(), n))
            _, o, r, s, at, contexts = batch.filter(batch.column(5).is_valid()).columns
            ords.append(o.to_numpy())
            rows.append(r.to_numpy())
            starts.append(s.flatten().to_numpy())
            many.append(np.diff(s.offsets.to_numpy()))
            of.append(np.fromiter((where.setdefault(x, len(where)) for x in zip(contexts.to_pylist(), at.to_pylist(), strict=True)), np.int64, len(contexts)))
        if not where:
            return
        many = np.concatenate(many)
        of, ords, rows = (np.repeat(np.concatenate(x), many) for x in (of, ords, rows))
        starts = np.concatenate(starts)
        contexts, at = [c for c, _ in where], np.fromiter((a for _, a in where), np.int64, len(where))
        sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
        least = np.full(len(contexts), LAST)
        np.minimum.at(least, of, ords)
        later = ords > least[of]  # all windows of theirs are in an earlier document
        yield _ranges(ords[later], rows[later], starts[later], starts[later] + sizes[of[later]])
        grams: dict[bytes, int] = {}
        group = np.fromiter((grams.setdefault(c[a : a + gram], len(grams)) for c, a in where), np.int64, len(contexts))
        active = np.flatnonzero(np.bincount(group)[group] > 1)  # buckets of one member need no refinement
        if not len(active):
            return
        context, begin, end = refine([contexts[k] for k in active.tolist()], group[active], least[active], width)
        first = np.flatnonzero(~later)  # rows of the document that has the context first
        first = first[np.argsort(of[first], kind="stable")]
        a, b = (np.searchsorted(of[first], active[context], side) for side in ("left", "right"))
        pick = np.repeat(np.arange(len(context)), b - a)
        row = first[np.repeat(a, b - a) + np.arange(len(pick)) - np.repeat((b - a).cumsum() - (b - a), b - a)]
        yield _ranges(ords[row], rows[row], starts[row] + begin[pick], starts[row] + end[pick])

    return make


def _ranges(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["ord", "row", "from", "to"])


_RANGES = "ord long, row long, from long, to long"


def _hot_ranges(contexts: DataFrame, width: int) -> DataFrame:
    """The same for anchors with very many contexts: windows meet in an aggregate and a join on their bytes."""
    settled = contexts.where("context is null").select("ord", "row", F.explode("starts").alias("from"), "at").select("ord", "row", "from", (F.col("from") + F.col("at")).alias("to"))
    at = F.explode(F.sequence(F.lit(0), F.length("context") - width))
    windows = contexts.where("context is not null").withColumn("i", at).select("ord", "row", "starts", "i", F.substring("context", F.col("i") + 1, F.lit(width)).alias("window"))
    least = written(windows.groupBy("window").agg(F.min("ord").alias("least")), "hot_windows")
    found = windows.join(least, "window").where("least < ord").select("ord", "row", F.explode(F.transform("starts", lambda x: x + F.col("i"))).alias("from"))
    return settled.union(found.select("ord", "row", "from", (F.col("from") + width).alias("to")))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])


_CUT = T.StructType([T.StructField("ord", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out = []
        for ord_, sha, text, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = unpack(text)
            spans = _merged(list(zip(begin, end, strict=True)))
            kept = _without(text, spans)
            out.append((ord_, sha, len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=_CUT.names)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, as they move twice between machines."""
    pack = zstandard.ZstdCompressor(level=5).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack(x) for x in batch.column(2).to_pylist()], pa.binary())], names=["ord", "sha", "text"])


def _order_of(doc_id: str):
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))


def _numbered(docs: DataFrame) -> DataFrame:
    """(ord, absent, text as binary, sha, n_bytes) of ``docs``; absent tells a null doc_id."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(_order_of("doc_id").alias("ord"), F.col("doc_id").isNull().alias("absent"), text.alias("text"))
    return rows.select("ord", "absent", "text", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))


class Shared(NamedTuple):
    """``info`` has (ord, absent, sha, n_bytes) for each row of the documents, ``firsts`` (sha, first): the smallest ord of each text.

    ``held`` has (ord, row, sha, text, places) for the first rows of texts with shared anchors, texts compressed;
    ``ranges`` has (row, begin, end) for those of them that lose bytes to an earlier document.
    """

    info: DataFrame
    firsts: DataFrame
    held: DataFrame
    ranges: DataFrame


def shared_ranges(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS) -> Shared:
    """What is known of each row's whole text, and the byte ranges that an earlier document has too."""
    rows = _numbered(docs)
    info = written(rows.select("ord", "absent", "sha", "n_bytes"), "texts")
    total = info.agg(F.sum("n_bytes")).first()[0] or 0
    firsts = written(info.groupBy("sha").agg(F.min("ord").alias("first")), "first_texts")
    parts = max(8, total // PART_BYTES)
    flagged = rows.select("ord", "text").mapInArrow(lean(_exchange(width, gram, parts)), _EXCHANGED)
    spread = F.when(F.col("part") < 0, F.xxhash64("places")).otherwise(F.col("part").cast("long"))
    flagged = written(flagged.repartition(parts, spread).mapInArrow(lean(_flag), "ord long, place int, key long"), "flagged")
    places = flagged.groupBy("ord").agg(F.collect_list("place").alias("places"))
    places = places.join(firsts.select(F.col("first").alias("ord"), "sha"), "ord")
    held = rows.select("ord", "sha", "text").mapInArrow(lean(_packed), "ord long, sha string, text binary").join(places, ["ord", "sha"]).withColumn("row", F.monotonically_increasing_id())
    held = written(held.select("ord", "row", "sha", "text", "places"), "flagged_texts")
    share = 16 if hot_contexts >= HOT_CONTEXTS else 1  # which way an anchor goes changes no result, so a share of the rows may tell
    some = flagged.select("key").where(F.pmod(F.xxhash64("ord", "place"), F.lit(share)) == 0) if share > 1 else flagged.select("key")
    hot = frozenset(r["key"] for r in some.groupBy("key").count().where(F.col("count") > hot_contexts // share).select("key").collect())  # one for each hot_contexts contexts at most
    n = max(8, flagged.count() // PART_CONTEXTS)
    found = held.select("ord", "row", "text", "places")
    ranges = found.mapInArrow(lean(_contexts(width, gram, parts, hot, False)), _CONTEXT).repartition(n, "key").mapInArrow(lean(_settle(width, gram)), _RANGES)
    if hot:
        ranges = ranges.union(_hot_ranges(found.mapInArrow(lean(_contexts(width, gram, parts, hot, True)), _CONTEXT), width))
    ranges = ranges.groupBy("row").agg(F.collect_list("from").alias("begin"), F.collect_list("to").alias("end"))
    return Shared(info, firsts, held, ranges)


def repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): a row for each row of ``docs``.

    A byte is removed when a ``width``-byte string that covers it also starts in a document with
    a smaller doc_id.  Strings are judged on the whole input; matches never cross documents, and
    rows of equal doc_id, repeated rows among them, don't count against each other.  doc_id is an integer; a null
    one counts as 2^63 - 1, hence comes after all others, and stays null.  A null text is empty, a long one is
    judged whole, an empty table gives an empty one, and only doc_id and text are read, so extra columns can't clash.
    """
    info, firsts, held, ranges = shared_ranges(docs, width, gram, hot_contexts)
    cut = held.join(ranges, "row").select("ord", "sha", "text", "begin", "end").mapInArrow(lean(_cut), _CUT)
    info, cut = written(info.join(firsts, "sha"), "texts"), written(cut.distinct(), "cut_texts")
    first = info.where("ord = first").join(cut, ["ord", "sha"], "left")
    first = first.select("ord", "absent", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
    whole = F.col("n_bytes") >= width
    other = info.where("ord > first").select("ord", "absent", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"), F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha")).alias("kept_sha256"))
    ids = F.when(~F.col("absent"), F.col("ord")).cast(docs.schema["doc_id"].dataType)
    return first.unionByName(other).select(ids.alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``, other columns unchanged.

    Bytes of a character of which a part was cut go with it, so that texts stay valid UTF-8.
    A null text stays null and a long one is judged whole.  Rows of equal doc_id, repeated rows among them, don't
    count against each other; a null doc_id comes after all others.  An empty table gives an empty one, and
    extra columns may have any names.
    """
    info, firsts, held, ranges = shared_ranges(docs, width, gram)
    order, digest, first, begin, end = fresh(docs.columns, "order", "digest", "first", "begin", "end")
    spans = held.select("row", "sha").join(ranges, "row").select("sha", "begin", "end").dropDuplicates(["sha"])  # repeated rows have equal ones
    known = written(firsts.join(spans, "sha", "left"), "spans")
    known = known.select(F.col("sha").alias(digest), F.col("first").alias(first), F.col("begin").alias(begin), F.col("end").alias(end))
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    marked = docs.withColumns({order: _order_of("doc_id"), digest: F.sha2(whole, 256)}).join(known, digest)
    later = F.col(order) > F.col(first)
    loses = ~later & F.col(begin).isNotNull()
    cut = _cut_text(F.when(loses, whole), F.when(loses, F.col(begin)), F.when(loses, F.col(end)))
    text = F.when(later & (F.octet_length(whole) >= width), F.lit("")).when(loses, cut).otherwise(F.col("text"))
    return marked.select(*(text.alias("text") if c == "text" else F.col(c) for c in docs.columns))


@F.pandas_udf(T.StringType())
def _cut_text(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
    """The texts without those ranges of bytes, and without characters of which a part is gone."""
    return pd.Series([None if t is None else _without(t, _merged(list(zip(a, b, strict=True)))).decode("utf-8", "ignore") for t, a, b in zip(texts, begins, ends, strict=True)], dtype=object)
