"""Toxicity by compression distance.

One zstandard dictionary is trained on ordinary text and one on the toxic passages of toxic text.  A
window is compressed with the ordinary dictionary and with the ordinary and the toxic one together; the bytes
that the toxic one saves are its distance.  A document's windows give it a few statistics, whose
calibration turns them into a probability.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.llm.calibration import logistic, sigmoid
from folia.llm.common import by_bytes, crc32_of, lean, written

#: Labelled rows of each class that the model is fitted to, with all their windows.
TOXIC_ROWS, ORDINARY_ROWS = 2000, 4000
#: Bytes of texts of each class that fitting takes at most; whole texts only.
FIT_BYTES = 64 << 20
#: Bytes of a window, and of one without a space at most.
WINDOW, LONGEST = 96, 384
LEVEL = 9
TOXIC_DICTIONARY, ORDINARY_DICTIONARY = 16_384, 65_536
#: A passage of so many bytes is toxic if at least so many toxic rows have it, and its share among them is so many times that among the others.
PASSAGE, LEAST_ROWS, RATIO = 5, 4, 40.0
#: Saved bytes from which a window counts.
SAVED = 2


class Model(NamedTuple):
    ordinary: bytes
    both: bytes
    beta: np.ndarray


def windows(text: bytes) -> list[bytes]:
    """The whole text in windows that end at a space; an empty text is one empty window."""
    text = text.lower()
    out, at, n = [], 0, len(text)
    while at < n:
        end = text.find(b" ", at + WINDOW, at + LONGEST)
        if end < 0:
            end = min(at + LONGEST, n)
        if n - end < WINDOW // 4:
            end = n
        out.append(text[at:end] + b" ")
        at = end
    return out or [b" "]


@lru_cache(4)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)


def _sizes(content: bytes, some: list[bytes]) -> np.ndarray:
    if not some:
        return np.zeros(0, np.int64)
    done = _compressor(content).multi_compress_to_buffer(some)
    return np.fromiter((len(done[k]) for k in range(len(done))), np.int64, len(done))


def features(model: Model, rows: list[list[bytes]]) -> np.ndarray:
    """Mean saving, share of windows that save, and the largest saving of each row of windows."""
    flat = [w for own in rows for w in own]
    saved = _sizes(model.ordinary, flat) - _sizes(model.both, flat)
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    at = sizes.cumsum() - sizes
    if not len(rows):
        return np.zeros((0, 4))
    mean = np.add.reduceat(np.maximum(saved, 0), at) / sizes
    share = np.add.reduceat((saved >= SAVED).astype(np.float64), at) / sizes
    most = np.maximum.reduceat(saved, at)
    return np.column_stack([np.sqrt(mean), np.sqrt(share), np.log1p(np.maximum(most, 0)), np.log1p(sizes)])


def _passages(word: bytes) -> Iterator[bytes]:
    word = b" " + word + b" "
    return (word[k : k + PASSAGE] for k in range(len(word) - PASSAGE + 1))


def _known(rows: list[list[bytes]]) -> Counter:
    found: Counter = Counter()
    for own in rows:
        found.update({p for w in set(b"".join(own).split()) for p in _passages(w)})
    return found


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary's bytes; too few samples to train one are used as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """The ordinary dictionary, and the toxic one followed by it."""
    own, other = _known(toxic), _known(ordinary)
    bound = RATIO * len(toxic) / max(1, len(ordinary))
    marks = {p for p, n in own.items() if n >= min(LEAST_ROWS, max(1, len(toxic) // 4)) and n > bound * (other[p] + 0.5)}
    words = [b" " + w + b" " for row in toxic for w in b"".join(row).split() if any(p in marks for p in _passages(w))]
    words = _dealt(words)
    groups = [b"".join(words[k : k + 6]) for k in range(0, len(words), 6)]
    flat = [w for row in ordinary for w in row]
    plain = _trained(flat, ORDINARY_DICTIONARY) if flat else b""
    return plain or b" ", (_trained(groups, TOXIC_DICTIONARY) if groups else b"") + (plain or b" ")


def _dealt(words: list[bytes]) -> list[bytes]:
    """The words in a fixed order in which each training sample holds different ones."""
    seen: Counter = Counter()
    placed = []
    for w in words:
        seen[w] += 1
        placed.append((zlib.crc32(w + b"%d" % seen[w]), w))
    return [w for _, w in sorted(placed)]


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learnt from; of repeated labels the largest counts."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (F.pmod(crc32_of("doc_id"), F.lit(5)) != 0))
    return own.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))


def _sample(docs: DataFrame, labels: DataFrame, toxic_rows: int, ordinary_rows: int) -> tuple[DataFrame, float]:
    """Rows (row, h, label, size, text) of the sampled doc_ids with their whole texts, written, and the share of toxic labels."""
    known = training_labels(labels, "toxic")
    count = dict(known.groupBy("label").count().collect())
    share = count.get(1, 0) / max(1, sum(count.values()))
    some = known.where("label = 1").orderBy(F.xxhash64("doc_id")).limit(toxic_rows).union(known.where("label = 0").orderBy(F.xxhash64("doc_id")).limit(ordinary_rows))
    picked = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")
    return written(picked.select(F.monotonically_increasing_id().alias("row"), F.xxhash64("doc_id").alias("h"), "label", size, "text"), "labelled_rows"), share


def _numbered(rows: DataFrame, most: dict[int, int], fit_bytes: int) -> dict[int, list[int]]:
    """By label, numbers of sampled rows in a fixed order, at most so many and with whole texts of at most ``fit_bytes`` together.

    A doc_id may have any number of rows, so both bounds are set here, after the join.
    """
    out = {}
    for c, n in most.items():
        own = rows.where(F.col("label") == c).select("h", F.xxhash64("text").alias("t"), "row", "size").orderBy("h", "t", "row").limit(n).collect()
        ends = np.cumsum([r["size"] for r in own])
        out[c] = [r["row"] for r, end in zip(own, ends, strict=True) if end <= fit_bytes]
    return out


def _picked(rows: DataFrame, numbers: list[int]) -> DataFrame:
    some = rows.sparkSession.createDataFrame([(n,) for n in numbers], "row long")
    return rows.join(F.broadcast(some), "row").select("row", "text")


def _windows_of(rows: DataFrame, numbers: list[int]) -> list[list[bytes]]:
    texts = {r["row"]: r["text"] for r in _picked(rows, numbers).select("row", F.col("text").cast("binary").alias("text")).collect()}
    return [windows(bytes(texts[n] or b"")) for n in numbers]


def _features_of(rows: DataFrame, model: Model, numbers: list[int]) -> np.ndarray:
    """The features of the rows over all their windows: only they leave the tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(_features(shared.value, batch.column(1))), pa.list_(pa.float64()))], names=["row", "x"])

    found = {r["row"]: r["x"] for r in _picked(rows, numbers).mapInArrow(lean(make), "row long, x array<double>").collect()}
    return np.asarray([found[n] for n in numbers], np.float64).reshape(-1, 4)


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, fit_bytes: int = FIT_BYTES) -> Model:
    """Learns from at most ``toxic_rows`` and ``ordinary_rows`` labelled rows of at most ``fit_bytes`` a class, none of them held out.

    Two thirds of them train the dictionaries and the rest calibrate.  Without labels of both
    classes every text gets the same score.
    """
    rows, share = _sample(docs, labels, toxic_rows, ordinary_rows)
    by = _numbered(rows, {0: ordinary_rows, 1: toxic_rows}, fit_bytes)
    learn = {c: _windows_of(rows, [n for k, n in enumerate(own) if k % 3] or own) for c, own in by.items()}
    check = {c: own[::3] for c, own in by.items()}
    ordinary, both = dictionaries(learn[1], learn[0])
    model = Model(ordinary, both, np.zeros(5))
    x = _features_of(rows, model, check[0] + check[1])
    y = np.asarray([0] * len(check[0]) + [1] * len(check[1]))
    weights = np.where(y == 1, share / max(1, len(check[1])), (1 - share) / max(1, len(check[0])))
    return model._replace(beta=logistic(x, y, weights + 1e-12))


_ADDED = [T.StructField("tox_score", T.DoubleType()), T.StructField("tox_predicted", T.IntegerType())]


def _features(model: Model, texts: pa.Array) -> np.ndarray:
    """The features of whole texts."""
    out = [np.zeros((0, 4))]
    for at, n in by_bytes(texts, 2_000_000):
        out.append(features(model, [windows(t or b"") for t in texts.slice(at, n).cast(pa.binary()).to_pylist()]))
    return np.concatenate(out)


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    return sigmoid(_features(model, texts) @ model.beta[:-1] + model.beta[-1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with tox_score (0 to 1) and tox_predicted (1 from 0.5 on); the model's size is bounded.

    A null text scores as an empty one.  Columns of the two names are replaced.
    """
    names = [c for c in docs.columns if c not in ("tox_score", "tox_predicted")]
    schema = T.StructType([*(docs.schema[c] for c in names), *_ADDED])
    shared, at = docs.sparkSession.sparkContext.broadcast(model), names.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _scores(shared.value, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select(*names).mapInArrow(lean(add), schema)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model doesn't call toxic, all columns unchanged."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, batch.column(at)) < 0.5))

    return docs.mapInArrow(lean(keep), docs.schema)
