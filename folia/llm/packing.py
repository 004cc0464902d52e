"""Best-fit packing of token pieces into sequences by exact-complement hashing.

The plan depends only on how many pieces have each length, at most ``capacity`` counters, so it
is made once on the driver from that bounded histogram, whatever the number of documents.  Rows
then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.llm.common import by_bytes, fresh, lean, written

CAPACITY = 4096
#: Id that ends each document.
END_ID = 1
#: Words of one generation of a Python worker's memory; it holds two of them.
MEMO_WORDS = 200_000
#: Bytes of text whose words are looked up together.
BATCH_BYTES = 4_000_000
#: Ranks of a length are counted in parts of about so many rows, so that a frequent length is no hot key.
PART_ROWS = 100_000
SPREAD = 1 << 16

_LATIN = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
_WORD_AND_MARKS = re.compile(rb"(" + _LATIN + rb")([^\w\s\x80-\xff']*)")


class _Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, remembered by word.

    The vocabulary's pre-tokeniser never joins what white space parts, nor a Latin letter and
    the ASCII mark after it, so a text's ids are those of its words one after another.  A run of Latin letters
    is one pre-token, which the vocabulary's merges take as it is.  Texts that hold a special
    token's first characters are encoded whole.  Words that weren't seen for a generation are forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path)
        self.merge = self.tok.model.tokenize
        self.raw = [i.to_bytes(4, "little") for i in range(max(self.tok.get_vocab().values()) + 1)]
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        young, old, raw, merge, match, letters = self.young, self.old, self.raw, self.merge, _WORD_AND_MARKS.fullmatch, self.letters
        out = []
        for w in words:
            ids = young.get(w)
            if ids is not None:
                out.append(ids)
                continue
            ids = old.get(w)
            if ids is not None:
                pass
            elif w.isalpha():
                ids = b"".join([raw[t.id] for t in merge(w.lower().decode())])
            elif m := match(w):
                core, marks = m.groups()
                ids = young.get(core) or old.get(core)
                if ids is None:
                    young[core] = ids = b"".join([raw[t.id] for t in merge(core.decode().lower().translate(letters))])
                if marks:
                    if (end := young.get(marks)) is None:
                        young[marks] = end = self._ids(marks.decode())
                    ids += end
            else:
                ids = self._ids(w.decode())
            young[w] = ids
            out.append(ids)
        if len(young) > MEMO_WORDS:
            self.old, self.young = young, {}
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # A letter before a combining mark isn't put in lower case here, as that may change what the two compose to.
        plain = [b"" if b"<|" in t else t if b"\xcc" in t or b"\xcd" in t else t.lower() for t in texts]
        raw = b"\n".join(plain) + bytes(_WIDE)
        starts, sizes = _words(raw)
        number, where = _numbered(raw, starts, sizes)
        known = self._learn([raw[a:b] for a, b in zip(starts[where].tolist(), (starts[where] + sizes[where]).tolist(), strict=True)])
        ids, n = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        first, many = n.cumsum() - n, n[number]
        upto = many.cumsum()
        tokens = ids[np.repeat(first[number] - upto + many, many) + np.arange(upto[-1] if len(upto) else 0)].tobytes()
        ends = (np.fromiter(map(len, plain), np.int64, len(plain)) + 1).cumsum()
        edges = (4 * np.append(0, upto)[np.append(0, np.searchsorted(starts, ends))]).tolist()
        return [self._ids(t.decode()) if b"<|" in t else tokens[a:b] for t, a, b in zip(texts, edges[:-1], edges[1:], strict=True)]


#: Bytes of a word that are compared as numbers; longer words are told apart as byte strings.
_WIDE = 24
_MASKS = np.asarray([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and sizes of the words of ``raw``, which ends with _WIDE zero bytes."""
    space = np.ones(len(raw) - _WIDE + 2, bool)
    space[1:-1] = _SPACE[np.frombuffer(raw, np.uint8, len(raw) - _WIDE)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2] - edges[::2]


def _numbered(raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word, equal for equal words, and a place of each number's word."""
    view = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    parts = [view[starts + at] & _MASKS[np.clip(sizes - at, 0, 8)] for at in range(0, _WIDE, 8)]
    mixed = np.zeros(len(starts), np.uint64)
    for x in parts:
        mixed = (mixed ^ x) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed)
    new = np.flatnonzero(np.diff(mixed[order], prepend=~mixed[order[:1]]))
    number = np.empty(len(starts), np.int64)
    number[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
    where = order[new]
    alike = (sizes <= _WIDE) & (sizes[where][number] == sizes)
    for x in parts:
        alike &= x[where][number] == x
    other: dict[bytes, int] = {}  # long words, and those whose mixed numbers are equal by chance
    more = []
    for k in np.flatnonzero(~alike).tolist():
        word = raw[starts[k] : starts[k] + sizes[k]]
        if word not in other:
            other[word] = len(where) + len(more)
            more.append(k)
        number[k] = other[word]
    return number, np.append(where, np.asarray(more, np.int64)).astype(np.int64)


_ENCODERS: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and then END_ID, cut at ``capacity``.

    ``ids`` is binary, little-endian unsigned 32-bit.  A null or empty text is the end id alone.
    Only doc_id and text are read, so further columns can't clash.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), np.asarray([END_ID], "<u4").tobytes()
        for whole in batches:
            for at, n in by_bytes(whole.column(1), BATCH_BYTES):
                batch = whole.slice(at, n)
                rows, pieces, starts, lengths, ids = [], [], [], [], []
                texts = [(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()]
                for row, own in enumerate(enc.encode(texts)):
                    own += end
                    for k, first in enumerate(range(0, len(own), 4 * capacity)):
                        part = own[first : first + 4 * capacity]
                        rows.append(row)
                        pieces.append(k)
                        starts.append(first // 4)
                        lengths.append(len(part) // 4)
                        ids.append(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(lean(cut), schema)


class _Lengths:
    """Counts of pieces by length, with the index of sums of pairs that are still available."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.cap = capacity
        self.n = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            if not 1 <= length <= capacity:
                raise ValueError(f"length {length} is not in 1..{capacity}")
            self.n[length] += n
        self.pairs = np.zeros(2 * capacity + 1, np.int32)  # by sum, unordered pairs of available lengths
        have = np.flatnonzero(self.n)
        for a in have:
            self.pairs[a + have[have > a]] += 1
            self.pairs[2 * a] += self.n[a] > 1

    def take(self, lengths: list[int], times: int) -> None:
        for a in lengths:
            before = self.n[a]
            self.n[a] = after = before - times
            if before > 1 >= after:
                self.pairs[2 * a] -= 1
            if before > 0 >= after:
                have = np.flatnonzero(self.n > 0)
                self.pairs[a + have[have != a]] -= 1

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.n[gap] > 0 else None

    def pair(self, gap: int) -> list[int] | None:
        if gap < 2 or self.pairs[gap] <= 0:
            return None
        a = np.arange((gap + 1) // 2, gap)  # the larger one
        ok = a[(self.n[a] > 0) & (self.n[gap - a] > np.where(2 * a == gap, 1, 0))]
        return [int(ok[-1]), gap - int(ok[-1])] if len(ok) else None

    def triple(self, gap: int) -> list[int] | None:
        a = np.arange(1, gap - 1) if gap >= 3 else np.arange(0)
        a = a[(self.n[a] > 0) & (self.pairs[gap - a] > 0)]
        for x in a[::-1].tolist():  # the largest first, so that small pieces stay for later gaps
            self.n[x] -= 1
            rest = self.pair(gap - x)
            self.n[x] += 1
            if rest:
                return [x, *rest]
        return None

    def largest(self, gap: int) -> int:
        have = np.flatnonzero(self.n[1 : gap + 1] > 0)
        return int(have[-1]) + 1 if len(have) else 0


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many sequences follow each, from the counts of pieces by length.

    From the longest length down, a sequence is opened and its gap looked up among single
    lengths, sums of pairs and sums of triples; a combination that fills it exactly is used as
    often as the counts allow.  Where none does, the longest piece that fits goes in (best fit)
    and the smaller gap is looked up again.
    """
    lengths, out = _Lengths(counts, capacity), []
    while top := lengths.largest(capacity):
        pattern, gap = [top], capacity - top
        lengths.n[top] -= 1  # held back while the gap is filled
        held = [top]
        while gap:
            found = lengths.single(gap) or lengths.pair(gap) or lengths.triple(gap)
            if not found:
                fit = lengths.largest(gap)
                if not fit:
                    break
                found = [fit]
            pattern += found
            gap -= sum(found)
            for x in found:
                lengths.n[x] -= 1
                held.append(x)
        for x in held:
            lengths.n[x] += 1
        need = {x: pattern.count(x) for x in pattern}
        times = int(min(lengths.n[x] // k for x, k in need.items()))
        lengths.take([x for x in pattern], times)
        out.append((pattern, times))
    return out


def plan_intervals(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, offset): ranks from each first one on go there."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for pattern, times in patterns:
        offset = 0
        for x in pattern:
            rank = used.get(x, 0)
            rows.setdefault(x, []).append((rank, first, offset))
            used[x] = rank + times
            offset += x
        first += times
    return {x: np.asarray(r, np.int64).T.copy() for x, r in rows.items()}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, among them a ``length`` in 1..capacity) with sequence_id and offset.

    Columns of those two names in the input are replaced; any other names may be in use.  Equal rows are
    interchangeable, so their order is of no consequence; an empty table gives an empty one.  Sequences of one full
    piece have negative numbers.  A null ``length``, or one outside 1..capacity, is an error.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    part, parts, spread, rank, before, n = fresh(pieces.columns, "part", "parts", "spread", "rank", "before", "n")
    spark = pieces.sparkSession
    number = F.monotonically_increasing_id()
    kept = written(pieces.select(*names, F.pmod(F.xxhash64(*names, number), F.lit(SPREAD)).cast("int").alias(spread)), "pieces")
    counts = {r[0]: r[1] for r in kept.where(F.col("length") != capacity).groupBy("length").count().collect()}  # at most ``capacity`` rows
    found = spark.sparkContext.broadcast(plan_intervals(plan_patterns(counts, capacity)))
    dealt = spark.createDataFrame([(int(x), min(SPREAD, 1 + k // PART_ROWS)) for x, k in counts.items()], T.StructType([T.StructField("length", kept.schema["length"].dataType), T.StructField(parts, T.IntegerType())]))
    rows = kept.where(F.col("length") != capacity).join(F.broadcast(dealt), "length").withColumn(part, F.pmod(spread, parts))
    starts = rows.groupBy("length", part).agg(F.count("*").alias(n))
    ahead = F.coalesce(F.sum(n).over(Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("length", part, ahead.alias(before))
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy("length", part).orderBy(*names)) - 1)
    ranked = ranked.join(starts, ["length", part]).select(*names, (F.col(rank) + F.col(before)).alias(rank))
    schema = T.StructType([*(kept.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    length_at = names.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = found.value
        for batch in batches:
            lengths, ranks = batch.column(length_at).to_numpy(), batch.column(len(names)).to_numpy()
            seq, off = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for x in np.unique(lengths):
                mine = np.flatnonzero(lengths == x)
                first, sequence, offset = plan[int(x)]
                k = np.searchsorted(first, ranks[mine], "right") - 1
                seq[mine], off[mine] = sequence[k] + ranks[mine] - first[k], offset[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(seq), pa.array(off)], names=schema.names)

    whole = kept.where(F.col("length") == capacity)  # one is a sequence of its own, whatever its rank
    whole = whole.select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(lean(place), schema).union(whole)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed training sequences, each at most ``capacity`` ids."""
    put = placed.select("doc_id", "piece", "sequence_id", "offset").join(pieces.select("doc_id", "piece", "ids", "length"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return put.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_p")).select("sequence_id", "length", F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
