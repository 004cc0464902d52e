"""Subword lattice language model.

The pieces of an existing vocabulary weight all segmentations of a word, and a forward recursion
in log space sums over them.  The vocabulary's scores give the first weights, which
expectation-maximisation over all distinct words of the corpus then fits.  Single bytes are
pieces too, so that every text has a probability.

A word that the corpus has is an arc of the lattice of its own: it keeps its discounted
frequency, and what the discount frees goes to the lattice of pieces.  Frequencies are those of the
document's class, which isn't known: classes are a mixture, fitted to all training documents, and a
document's probability is its marginal over them too.

Beside it stands the add-one unigram model of whole words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import log10
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.llm.common import LOWER, by_bytes, crc32_of, lean, written

#: Rounds of expectation-maximisation of the pieces; pseudo-count of each piece.
ROUNDS, SMOOTH = 2, 0.01
#: Classes of documents, told by how often the first CLASS_WORDS words of the vocabulary occur, and rounds of their fit.
CLASSES, CLASS_WORDS, CLASS_ROUNDS = 6, 1000, 10
#: Share of the frequency over all classes in what a class' discount frees.
OVERALL = 0.2
#: Words whose scores every task holds, at most; only words of up to MOST_BYTES are among them.
FREQUENT, MOST_BYTES = 250_000, 64
#: Words that go through the recursion together.
TOGETHER = 60_000

_BASE = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_AGAIN = np.uint64(0xC2B2AE3D27D4EB4F)
_SLOTS = 20


class Pieces(NamedTuple):
    """A vocabulary: pieces as bytes (a word's start is a space) and their log-weights."""

    text: list[bytes]
    weight: np.ndarray


def vocabulary(path: str) -> Pieces:
    """Pieces and weights of a SentencePiece model's file, single bytes included.

    Its scores are ranks, which weigh as 1 / (rank + 10); bytes weigh less than any piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        raw = model.id_to_piece(i).replace("▁", " ").encode()
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or raw != raw.translate(LOWER) or b" " in raw[1:]:
            continue
        found[raw] = 1 / (10 - model.get_score(i))
    least = min(found.values(), default=1.0) / 10
    for b in range(256):
        found.setdefault(bytes([b]), least)
    weight = np.asarray(list(found.values()))
    return Pieces(list(found), np.log(weight / weight.sum()))


class Lattice:
    """Finds the pieces at all places of words, and sums over the words' segmentations."""

    def __init__(self, pieces: Pieces):
        self.weight = pieces.weight
        self.longest = max(map(len, pieces.text))
        hashes = np.zeros(len(pieces.text) + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k, raw in enumerate(pieces.text):
                h = np.uint64(len(raw))
                for b in raw:
                    h = h * _BASE + np.uint64(b + 1)
                hashes[k] = h
        self.hashes = hashes
        self.tables = [np.full(1 << _SLOTS, len(pieces.text), np.int32) for _ in range(3)]
        left = np.arange(len(pieces.text))
        for k, own in enumerate(self.tables):
            slot = self._slot(hashes[left], k)
            _, first = np.unique(slot, return_index=True)
            own[slot[first]] = left[first]
            left = np.delete(left, first)
        if len(left) or len(np.unique(hashes[:-1])) < len(pieces.text):
            raise ValueError("the vocabulary's hashes collide")

    @staticmethod
    def _slot(hashes: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (hashes ^ (hashes >> np.uint64(31 - 3 * k))) * (_SPREAD if k == 0 else _AGAIN * np.uint64(2 * k + 1))
        return (mixed >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def _ids(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash; that of no piece is one beyond the last."""
        out = self.tables[0][self._slot(hashes, 0)]
        miss = np.flatnonzero(self.hashes[out] != hashes)
        for k in (1, 2):
            ids = self.tables[k][self._slot(hashes[miss], k)]
            out[miss] = ids
            miss = miss[self.hashes[ids] != hashes[miss]]
        out[miss] = len(self.hashes) - 1
        return out

    def _places(self, chars: np.ndarray) -> list[np.ndarray]:
        """For each length k, the ids of the pieces of that length at places 0.. of words of one length."""
        n = chars.shape[1]
        codes, out = chars.astype(np.uint64) + np.uint64(1), []
        with np.errstate(over="ignore"):
            h = np.zeros(chars.shape, np.uint64)
            power = np.uint64(1)
            for k in range(1, min(self.longest, n) + 1):
                h = h[:, : n - k + 1] * _BASE + codes[:, k - 1 :]
                power = power * _BASE
                out.append(self._ids((h + np.uint64(k) * power).ravel()).reshape(h.shape))
        return out

    def _forward(self, ids: list[np.ndarray], logs: np.ndarray, n: int, rows: int) -> np.ndarray:
        total = np.full((rows, n + 1), -np.inf)
        total[:, 0] = 0
        for end in range(1, n + 1):
            terms = np.stack([total[:, end - k] + logs[ids[k - 1][:, end - k]] for k in range(1, min(end, len(ids)) + 1)])
            top = terms.max(0)
            total[:, end] = top + np.log(np.exp(terms - top).sum(0))
        return total

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers, characters) of the words by length, each with a space before it."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        edges = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            size = int(sizes[order[a]])
            step = max(1, 4_000_000 // (size * self.longest + 1))
            for at in range(a, b, step):
                some = order[at : min(b, at + step)]
                chars = np.frombuffer(b"".join(b" " + words[i] for i in some.tolist()), np.uint8).reshape(len(some), size + 1)
                yield some, chars

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the words' marginal probabilities."""
        logs, out = np.append(self.weight, -np.inf), np.zeros(len(words))
        for some, chars in self._groups(words):
            out[some] = self._forward(self._places(chars), logs, chars.shape[1], len(some))[:, -1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected number of each piece in the words, which occur so many times."""
        logs, found = np.append(self.weight, -np.inf), np.zeros(len(self.hashes))
        for some, chars in self._groups(words):
            n, ids = chars.shape[1], self._places(chars)
            ahead = self._forward(ids, logs, n, len(some))
            behind = np.full((len(some), n + 1), -np.inf)
            behind[:, n] = 0
            for at in range(n - 1, -1, -1):
                terms = np.stack([behind[:, at + k] + logs[ids[k - 1][:, at]] for k in range(1, min(n - at, len(ids)) + 1)])
                top = terms.max(0)
                behind[:, at] = top + np.log(np.exp(terms - top).sum(0))
            base = np.log(counts[some].astype(np.float64)) - ahead[:, -1]
            for k in range(1, len(ids) + 1):
                part = np.exp(ahead[:, : n - k + 1] + logs[ids[k - 1]] + behind[:, k:] + base[:, None])
                found += np.bincount(ids[k - 1].ravel(), part.ravel(), len(found))
        return found[:-1]


def _in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, pa.RecordBatch]]:
    """Words and counts of several batches at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= TOGETHER:
            yield _chunk(held)
            held, rows = [], 0
    if rows:
        yield _chunk(held)


def _chunk(held: list[pa.RecordBatch]):
    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    return whole.column(0).to_pylist(), whole.column(1).to_numpy(), whole


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


class Classes(NamedTuple):
    """A mixture of document classes over a few words of the vocabulary."""

    number: dict[bytes, int]
    prior: np.ndarray
    logs: np.ndarray  # by class and word

    def of(self, words: list[bytes]) -> int:
        """The likeliest class."""
        at = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        return int((np.log(self.prior) + self.logs[:, at[at >= 0]].sum(1)).argmax())


def fit_classes(docs: DataFrame, pieces: Pieces, classes: int = CLASSES, rounds: int = CLASS_ROUNDS) -> Classes:
    """Fits the mixture to all of ``docs`` (text), from a fixed start."""
    spark = docs.sparkSession
    order = [k for k in np.argsort(-pieces.weight, kind="stable").tolist() if pieces.text[k][:1] == b" " and len(pieces.text[k]) > 1]
    number = {pieces.text[k][1:]: i for i, k in enumerate(order[:CLASS_WORDS])}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, rows in by_bytes(whole.column(0), 4_000_000):
                ids, counts = [], []
                for text in whole.column(0).slice(at, rows).cast(pa.binary()).to_pylist():
                    own, n = np.unique(np.fromiter(map(number.get, words_of(text or b""), repeat(-1)), np.int32), return_counts=True)
                    ids.append(own[own >= 0])
                    counts.append(n[own >= 0])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["ids", "counts"])

    rows = written(docs.select("text").mapInArrow(lean(count), "ids array<int>, counts array<long>").where(F.size("ids") > 0), "class_counts")
    now = Classes(number, np.full(classes, 1 / classes), np.random.default_rng(11).normal(0, 1, (classes, len(number))) - 7)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(now)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            found, members = np.zeros(own.logs.shape), np.zeros(len(own.prior))
            for batch in batches:
                sizes = np.diff(batch.column(0).offsets.to_numpy())
                ids, counts = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
                starts = sizes.cumsum() - sizes
                fit = np.log(own.prior) + np.add.reduceat(own.logs[:, ids] * counts, starts, axis=1).T
                share = np.exp(fit - fit.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                members += share.sum(0)
                each = np.repeat(share, sizes, axis=0) * counts[:, None]
                for k in range(len(members)):
                    found[k] += np.bincount(ids, each[:, k], found.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(members), dtype=np.int32)), pa.array(members), pa.array(list(found))], names=["class", "members", "n"])

        got = rows.mapInArrow(lean(expect), "class int, members double, n array<double>").select("class", "members", F.posexplode("n").alias("at", "n")).groupBy("class", "at").agg(F.sum("members").alias("members"), F.sum("n").alias("n")).collect()
        n, members = np.full(now.logs.shape, 0.1), np.full(classes, 1.0)
        for r in got:  # classes times words
            n[r["class"], r["at"]] += r["n"]
            members[r["class"]] = 1 + r["members"]
        now = Classes(number, members / members.sum(), np.log(n / n.sum(1, keepdims=True)))
    return now


def _n(classes: int) -> list[str]:
    return [f"n{k}" for k in range(classes)]


def word_counts(docs: DataFrame, train: str, classes: Classes) -> DataFrame:
    """(word, n0, n1, ...): all words of ``docs`` (train, text) and how often the rows marked in ``train`` have each, by class."""
    names = _n(len(classes.prior))
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for at, n in by_bytes(whole.column(1), 16_000_000):
                batch = whole.slice(at, n)
                found = [Counter() for _ in names]
                other: set[bytes] = set()
                for mine, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    words = words_of(text or b"")
                    (found[own.of(words)] if mine else other).update(words)
                for k, some in enumerate([*found, dict.fromkeys(other.difference(*found), 0)]):
                    zero = np.zeros(len(some), np.int64)
                    counts = np.fromiter(some.values(), np.int64, len(some))
                    yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.binary()), *(pa.array(counts if j == k else zero) for j in range(len(names)))], names=["word", *names])

    schema = T.StructType([T.StructField("word", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in names)])
    return docs.select(train, "text").mapInArrow(lean(count), schema).groupBy("word").agg(*(F.sum(c).alias(c) for c in names))


def fit(words: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> Pieces:
    """The pieces with weights fitted to ``words`` (word, n): each word that occurs counts once."""
    spark = words.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(pieces)  # as large as the vocabulary

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, found = Lattice(shared.value), np.zeros(len(shared.value.text))
            for own, _, _ in _in_chunks(batches):
                found += lattice.expected(own, np.ones(len(own)))
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], names=["piece", "n"])

        rows = words.where("n > 0").select("word", "n").mapInArrow(lean(expect), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        n = np.full(len(pieces.text), SMOOTH)
        for r in rows:
            n[r["piece"]] += r["n"]
        pieces = pieces._replace(weight=np.log(n / n.sum()))
    return pieces


class Law(NamedTuple):
    """What turns a word's counts by class, and its lattice's marginal, into its probability in each class."""

    tokens: np.ndarray  # by class, ends included
    ends: np.ndarray
    words: np.ndarray
    discount: np.ndarray
    prior: np.ndarray

    def logs(self, counts: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """log10 probability by word and class; counts by word and class, natural logs of marginals by word."""
        total = max(self.tokens.sum(), 1)
        overall = counts.sum(1) / total
        rest = np.logaddexp(np.log(np.maximum(OVERALL * overall, 1e-300)), lattice + np.log(1 - OVERALL))
        n = np.maximum(self.tokens, 1)
        freed = np.where(self.words > 0, self.discount * self.words / n, 1.0)
        own = np.maximum(counts - self.discount, 0) / n
        return np.logaddexp(np.log(np.maximum(own, 1e-300)), np.log(freed) + rest[:, None]) / np.log(10)

    def end(self) -> np.ndarray:
        return np.log10((self.ends + 0.5) / (self.tokens + 1))


class Frequent(NamedTuple):
    number: dict[bytes, int]
    n: np.ndarray
    scores: np.ndarray


def _frequent(scored: DataFrame, most: int, names: list[str]) -> Frequent:
    """The most frequent words, at most ``most`` of at most MOST_BYTES bytes each."""
    some = scored.where((F.length("word") <= MOST_BYTES) & (F.col("n") > 0))
    steps = some.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most).collect()
    least, total = 1 << 62, 0
    for r in steps:
        total += r["words"]
        if total > most:
            break
        least = r["n"]
    found = some.where(F.col("n") >= least).toArrow()
    scores = np.column_stack([found.column(c).to_numpy() for c in names])
    return Frequent({w: k for k, w in enumerate(found.column("word").to_pylist())}, found.column("n").to_numpy().astype(np.float64), scores.astype(np.float64))


def document_scores(docs: DataFrame, model_path: str, modulus: int = 7, remainder: int = 2, frequent: int = FREQUENT, rounds: int = ROUNDS, classes: int = CLASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score): a row for each row of ``docs``.

    Learns from the rows whose crc32(doc_id as text) mod ``modulus`` isn't ``remainder``.  Tokens are
    the words of the lower-cased text and one end; scores are log10 probabilities.  ``lattice_score`` is that of the
    lattice of pieces alone, the marginal over all segmentations, without word arcs and classes.  A null text
    is empty and has the end alone; equal rows score equally; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", (F.pmod(crc32_of("doc_id"), F.lit(modulus)) == remainder).alias("held_out"), "text")
    pieces = vocabulary(model_path)
    mixture = fit_classes(rows.where("not held_out"), pieces, classes)
    names = _n(classes)
    counts = written(word_counts(rows.select((~F.col("held_out")).alias("train"), "text"), "train", mixture).withColumn("n", sum(F.col(c) for c in names)), "word_counts")
    ends = rows.where("not held_out").count()
    zero = F.lit(0)
    sums = counts.agg(F.coalesce(F.sum("n"), zero), F.count_if(F.col("n") > 0), *(F.coalesce(F.sum(c), zero) for c in names), *(F.count_if(F.col(c) == k) for k in (1, 2) for c in names), *(F.count_if(F.col(c) > 0) for c in names)).first()
    n_words, known = sums[0], sums[1]
    total, distinct = n_words + ends, known + (ends > 0)
    by = np.asarray(sums[2:], np.float64).reshape(4, classes)
    ended = ends * mixture.prior
    law = Law(by[0] + ended, ended, by[3], np.clip(by[1] / np.maximum(by[1] + 2 * by[2], 1), 0.1, 0.95), mixture.prior)
    shared = spark.sparkContext.broadcast(fit(counts.select("word", "n"), pieces, rounds))
    score_names = [f"s{k}" for k in range(classes)]
    go_on, stop = np.log10((n_words + 0.5) / (total + 1)), np.log10((ends + 0.5) / (total + 1))  # a text has another word, or ends
    with_scores = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType()), *(T.StructField(c, T.FloatType()) for c in (*score_names, "lat"))])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for own, _, whole in _in_chunks(batches):
            by_class = np.column_stack([whole.column(2 + k).to_numpy() for k in range(classes)])
            marginals = lattice.scores(own)
            logs = np.column_stack([law.logs(by_class, marginals), marginals / np.log(10) + go_on]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([whole.column(0), whole.column(1), *(pa.array(logs[:, k].copy()) for k in range(classes + 1))], names=with_scores.names)

    scored = written(counts.select("word", "n", *names).mapInArrow(lean(rate), with_scores), "word_scores")
    held = spark.sparkContext.broadcast(_frequent(scored, frequent, [*score_names, "lat"]))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("sums", T.ArrayType(T.DoubleType())), ("rare", T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("tf", T.LongType())])))))])
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        logs, start = np.log10(own.n + 1), np.append(np.log10(law.prior) + law.end(), stop)
        for batch in batches:
            tokens, base, sums, rare, times, edges = [], [], [], [], [], [0]
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                words = words_of(text or b"")
                at = np.fromiter(map(own.number.get, words, repeat(-1)), np.int64, len(words))
                few = Counter([words[i] for i in np.flatnonzero(at < 0).tolist()])
                at = at[at >= 0]
                tokens.append((len(words) + 1, len(at) + (ends > 0)))
                base.append(logs[at].sum() + log10(ends + 1))
                sums.append(start + own.scores[at].sum(0))
                rare += few
                times += few.values()
                edges.append(len(rare))
            pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], names=["word", "tf"])
            n = np.asarray(tokens, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n[:, 0].copy()), pa.array(n[:, 1].copy()), pa.array(base, pa.float64()), pa.array(sums, pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pairs)], names=schema.names)

    per_doc = written(rows.mapInArrow(lean(add), schema).withColumn("row", F.monotonically_increasing_id()), "document_sums")
    rare = per_doc.where(F.size("rare") > 0).select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf")
    n, tf = F.col("n"), F.col("tf")
    rare = rare.join(scored, "word").groupBy("row").agg(F.sum(F.when(n > 0, tf).otherwise(0)).alias("k"), F.sum(tf * F.log10(n + 1)).alias("b"), *(F.sum(tf * F.col(c).cast("double")).alias(c) for c in (*score_names, "lat")))
    whole = per_doc.drop("rare").join(rare, "row", "left")
    by_class = F.array(*(F.col("sums")[k] + F.coalesce(c, F.lit(0.0)) for k, c in enumerate(score_names)))
    most = F.array_max("c")
    marginal = most + F.log10(F.aggregate("c", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - most)))
    return whole.withColumn("c", by_class).select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0)) - F.col("n_tokens") * log10(total + distinct + 1)).alias("base_score"), marginal.alias("score"),
        (F.col("sums")[classes] + F.coalesce("lat", F.lit(0.0))).alias("lattice_score"),
    )
