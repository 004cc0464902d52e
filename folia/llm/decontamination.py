"""Benchmark decontamination: a broadcast hash set of normalised n-grams scans all training windows.

The set holds at most ``MOST_BYTES`` of benchmark text; a larger benchmark is hashed into a
shuffle join instead, which gives the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.llm.common import LOWER, fresh, lean, written

WINDOW = 10
#: The n-gram set is broadcast up to so many bytes of benchmark text, of which each makes some 40 bytes of it.
MOST_BYTES = 4_000_000

#: A-Z in lower case; bytes that no word has become spaces.
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in LOWER)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

Grams = dict[int, dict[bytes, tuple[str, ...]]]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def windows_of(words: list[bytes], n: int = WINDOW) -> list[bytes]:
    """An item's windows: its n-grams, or all its words where they are fewer; none without words."""
    if not words:
        return []
    n = min(n, len(words))
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def grams_of(items: Iterable[tuple[object, str | None]], n: int = WINDOW) -> Grams:
    """By number of words, the windows and the ids of their items as strings (a null id is '')."""
    found: dict[int, dict[bytes, set[str]]] = {}
    for item, text in items:
        words = words_of((text or "").encode())
        own = found.setdefault(min(n, len(words)), {})
        for w in windows_of(words, n):
            own.setdefault(w, set()).add("" if item is None else str(item))
    return {k: {w: tuple(sorted(ids)) for w, ids in own.items()} for k, own in found.items() if k}


class Scanner:
    def __init__(self, grams: Grams):
        self.grams = grams
        self.known = {w: 1 for own in grams.values() for gram in own for w in gram.split()}

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words lie in an occurrence of a window (None: none does), and the items it is of."""
        mask, items = None, set()
        if not words:
            return mask, items
        known = np.fromiter(map(self.known.get, words, repeat(0)), np.int64, len(words))
        total = np.concatenate(([0], known.cumsum()))
        for n, own in self.grams.items():
            for i in np.flatnonzero(total[n:] - total[:-n] == n).tolist() if len(words) >= n else ():
                if ids := own.get(b" ".join(words[i : i + n])):
                    mask = np.zeros(len(words), bool) if mask is None else mask
                    mask[i : i + n] = True
                    items.update(ids)
        return mask, items


def _spans(text: bytes, mask: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges from the first to the last word of each run of hit words."""
    places = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))).tolist()
    return [(places[a][0], places[b - 1][1]) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, last = [], 0
    for a, b in spans:
        kept.append(text[last:a])
        last = b
    return b"".join([*kept, text[last:]])


HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("clean_text", T.StringType())])


def _grams_if_small(benchmark: DataFrame, n: int, most_bytes: int) -> Grams | None:
    size = benchmark.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    if size > most_bytes:
        return None
    return grams_of(((r[0], r[1]) for r in benchmark.select("item_id", "text").collect()), n)


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, clean_text): per row of ``docs`` what the benchmark's windows hit.

    ``items`` are the ids of the items with an occurring window, sorted as strings;
    ``clean_text`` is the text without the hit spans.  A null or empty text has no words and
    no hits; equal rows give equal rows; an empty benchmark hits nothing.
    """
    grams = _grams_if_small(benchmark, n, most_bytes)
    if grams is None:
        return _find_by_join(docs, benchmark, n)
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(grams))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *HITS.fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            found = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(text or b"")
                found.append(_hits_of((text or b"", len(words)), *scanner.scan(words)))
            yield _batch(batch.column(0), found, schema)

    return docs.select("doc_id", "text").mapInArrow(lean(scan), schema)


def _hits_of(text: tuple[bytes, int], mask: np.ndarray | None, items: set[str]) -> tuple:
    raw, n_words = text
    if mask is None:
        return n_words, 0, [], raw
    return n_words, int(mask.sum()), sorted(items), cut(raw, _spans(raw, mask))


def _batch(ids: pa.Array, found: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    n_words, n_hit, items, clean = zip(*found, strict=True) if found else ((), (), (), ())
    clean = pa.array(clean, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), clean], names=schema.names)


def _hash(gram: bytes) -> int:
    return xxhash.xxh64_intdigest(gram) - (1 << 63)


def _find_by_join(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """The same for a benchmark of any size: hashes of windows meet in a join, and what meets is verified word by word."""
    kind = docs.schema["doc_id"].dataType
    rows = written(docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()), "decontaminate")

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(str(i) if i is not None else "", w, _hash(w), min(n, len(words))) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True) for words in (words_of(x or b""),) for w in set(windows_of(words, n))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.binary(), pa.int64(), pa.int32()))], names=["item", "gram", "h", "n"])

    grams = written(benchmark.select("item_id", "text").mapInArrow(lean(item_windows), "item string, gram binary, h long, n int"), "grams")
    sizes = sorted(r[0] for r in grams.select("n").distinct().collect())  # 1 to n

    def doc_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                rid, words = whole.column(0)[at].as_py(), words_of(whole.column(1)[at].as_py() or b"")
                for k in sizes:
                    for first in range(0, len(words) - k + 1, 50_000):
                        own = [_hash(b" ".join(words[i : i + k])) for i in range(first, min(first + 50_000, len(words) - k + 1))]
                        yield pa.RecordBatch.from_arrays([pa.array([rid] * len(own), pa.int64()), pa.array(range(first, first + len(own)), pa.int32()), pa.array(own, pa.int64()), pa.array([k] * len(own), pa.int32())], names=["rid", "at", "h", "n"])

    places = rows.select("rid", F.col("text").cast("binary")).mapInArrow(lean(doc_windows), "rid long, at int, h long, n int")
    one = grams.groupBy("h", "n", "gram").agg(F.collect_set("item").alias("of"))
    hits = places.join(one, ["h", "n"]).groupBy("rid").agg(F.collect_list(F.struct("at", "n", "gram", "of")).alias("places"))
    schema = T.StructType([T.StructField("doc_id", kind), *HITS.fields])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, places in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, mask, items = words_of(x or b""), None, set()
                for p in places or ():
                    span = slice(p["at"], p["at"] + p["n"])
                    if b" ".join(words[span]) == p["gram"]:
                        mask = np.zeros(len(words), bool) if mask is None else mask
                        mask[span] = True
                        items.update(p["of"])
                found.append(_hits_of((x or b"", len(words)), mask, items))
            yield _batch(batch.column(0), found, schema)

    return rows.join(hits, "rid", "left").select("doc_id", "text", "places").mapInArrow(lean(apply), schema)


def items_digest(ids: str = "items"):
    """SHA-256, in lower-case hex, of the comma-joined ids."""
    return F.sha2(F.concat_ws(",", ids), 256)


def drop_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, without those that a window occurs in.

    Null and empty texts have no words and stay; long ones are scanned whole; repeated rows stay or go
    together; an empty table gives an empty one, and extra columns may have any names.
    """
    grams = _grams_if_small(benchmark, n, most_bytes)
    if grams is None:
        (row,) = fresh(docs.columns, "row")  # ids may be null or repeated
        rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        bad = _find_by_join(rows.select(F.col(row).alias("doc_id"), "text"), benchmark, n).where("n_hit > 0").select(F.col("doc_id").alias(row))
        return rows.join(bad, row, "left_anti").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(grams))
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            yield batch.filter(pa.array([scanner.scan(words_of(x or b""))[0] is None for x in batch.column(at).cast(pa.binary()).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(clean), docs.schema)

