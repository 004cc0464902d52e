"""Naive Bayes support vectors for text quality.

Features are indicators of hashed n-grams: of three bytes, and of the signs that a word repeats the
one before it.  Each is scaled by its log-count ratio between the classes; a linear hinge-loss model is then fitted
by dual coordinate descent, and its margins are calibrated to probabilities.  Fitting takes bounded
samples of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.llm.calibration import logistic, sigmoid
from folia.llm.common import lean
from folia.llm.toxicity import training_labels

#: Number of hashed features, one more than which is the highest sign of repetition.
BUCKETS = 1 << 17
SIGNS = 8
#: Labelled rows that the log-count ratios come from, and of those, rows that the hinge-loss model is fitted to and calibrated on.
COUNT_ROWS, FIT_ROWS = 40_000, 6000
#: Added to counts; bound of the dual variables; passes over the sample.
SMOOTH, COST, EPOCHS = 1.0, 0.1, 12


def grams(text: bytes) -> np.ndarray:
    """The distinct features of a whole text, sorted; those of an empty text are none."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    code = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) if len(raw) > 2 else np.zeros(0, np.uint32)
    own = np.unique(((code * np.uint32(0x9E3779B1)) >> np.uint32(15)) & np.uint32(BUCKETS - 1)).astype(np.int32)
    words = text.split()
    share = sum(map(eq, words, words[1:])) / len(words) if words else 0.0
    signs = [BUCKETS + k for k in range(SIGNS) if share > 0.8 * 0.5**k]
    return np.concatenate((own, np.asarray(signs, np.int32)))


class Model(NamedTuple):
    weights: np.ndarray  # of all features
    bias: float
    beta: np.ndarray


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros((2, BUCKETS + SIGNS), np.int64)
    for batch in batches:
        for text, label in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found[int(label > 0), grams(text or b"")] += 1
    some = np.flatnonzero(found.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[0, some]), pa.array(found[1, some])], names=["feature", "n0", "n1"])


def ratios(texts: DataFrame) -> np.ndarray:
    """Log-count ratio of each feature between the labels of ``texts`` (text, label)."""
    found = texts.select("text", "label").mapInArrow(lean(_counts), "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0"), F.sum("n1")).toArrow()
    n = np.full((2, BUCKETS + SIGNS), SMOOTH)  # a row for each feature at most comes to the driver
    at = found.column(0).to_numpy()
    n[0, at] += found.column(1).to_numpy()
    n[1, at] += found.column(2).to_numpy()
    return np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights of the scaled indicators and the bias, for the hinge loss with classes weighted evenly."""
    w, bias = np.zeros(len(scale)), 0.0
    sign = np.where(labels > 0, 1.0, -1.0)
    share = np.asarray([(sign < 0).mean(), (sign > 0).mean()])
    bound = cost / np.maximum(share, 1e-9)[(sign > 0).astype(int)] / 2
    norms = np.asarray([np.sqrt((scale[x] ** 2).sum()) + 1e-9 for x in rows])
    values = [scale[x] / n for x, n in zip(rows, norms, strict=True)]
    alpha, order = np.zeros(len(rows)), np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            x, v, y = rows[i], values[i], sign[i]
            gradient = y * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), bound[i])  # unit rows and a unit bias feature
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                w[x] += step * v
                bias += step
                alpha[i] = new
    return w * scale, bias


def _margin(weights: np.ndarray, square: np.ndarray, bias: float, own: np.ndarray) -> tuple[float, float]:
    norm = np.sqrt(square[own].sum()) + 1e-9
    return weights[own].sum() / norm + bias, np.log1p(len(own))


def fit(docs: DataFrame, labels: DataFrame, count_rows: int = COUNT_ROWS, fit_rows: int = FIT_ROWS) -> tuple[Model, np.ndarray]:
    """The model and its features' squared scales.

    Log-count ratios come from at most ``count_rows`` labelled rows that aren't held out, the margin and
    its calibration from ``fit_rows`` of those.  Without labels of both classes all scores are equal.
    """
    known = training_labels(labels, "quality")
    counted = known.orderBy(F.xxhash64("doc_id")).limit(count_rows)
    ratio = ratios(docs.select("doc_id", "text").join(F.broadcast(counted), "doc_id").select("text", "label"))
    some = known.orderBy(F.xxhash64("doc_id")).limit(fit_rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [grams(x or b"") for x in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in own], pa.binary())], names=["h", "label", "grams"])

    picked = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select(F.xxhash64("doc_id").alias("h"), "label", "text")
    cuts = picked.mapInArrow(lean(cut), "h long, label int, grams binary")
    found = cuts.orderBy("h", "grams").limit(fit_rows).collect()  # a doc_id may have any number of rows
    rows = [np.frombuffer(r["grams"], np.int32) for r in found]
    y = np.asarray([int(r["label"] > 0) for r in found], np.int64)
    square = ratio**2
    check = np.arange(len(rows)) % 4 == 0
    learn = [x for x, c in zip(rows, check, strict=True) if not c]
    weights, bias = dual_descent(learn, y[~check], ratio) if len(set(y[~check].tolist())) > 1 else (np.zeros(len(ratio)), 0.0)
    x = np.asarray([_margin(weights, square, bias, own) for own, c in zip(rows, check, strict=True) if c]).reshape(-1, 2)
    return Model(weights, bias, logistic(x, y[check], np.ones(len(x)))), square


def score(docs: DataFrame, fitted: tuple[Model, np.ndarray], threshold: float = 0.3) -> DataFrame:
    """``docs`` with quality_score (0 to 1) and quality_predicted (1 from ``threshold`` on).

    A null text scores as an empty one.  Columns of the two names are replaced.
    """
    names = [c for c in docs.columns if c not in ("quality_score", "quality_predicted")]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("quality_score", T.DoubleType()), T.StructField("quality_predicted", T.IntegerType())])
    shared, at = docs.sparkSession.sparkContext.broadcast(fitted), names.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, square = shared.value
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            x = np.asarray([_margin(model.weights, square, model.bias, grams(t or b"")) for t in texts]).reshape(-1, 2)
            p = sigmoid(x @ model.beta[:-1] + model.beta[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=schema.names)

    return docs.select(*names).mapInArrow(lean(add), schema)
