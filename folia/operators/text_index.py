"""A stored full-text index with upkeep: a base segment, delta segments with tombstones, compaction.

A segment has postings (a row for each lexeme of a document with its places), laid out by a checksum of the
lexeme and sorted, and the ids of the documents it touches.  A document's newest segment counts, whether
that has new text for it or none, so changes never rewrite older files.  A segment holds from the
moment its name is in the log; what a failed writer leaves isn't read.  There is one writer at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.functions import spanish

#: Folders of a segment's postings; rows of a batch of postings; words that are grouped at a time, beside the longest text; words whose lexeme a task remembers.
PARTS, BATCH_ROWS, BATCH_WORDS, MEMORY = 64, 50_000, 500_000, 200_000
POSTINGS = "lexeme string, doc_id long, positions array<int>, segment int, part int"
WORD = re.compile(r"[a-zà-öø-ÿ0-9]+")
#: What a cover of entries without words between them is worth: the weight of plain text.
WEIGHT = 0.1


class Segment(NamedTuple):
    number: int
    kind: str  # base or delta
    config: str  # simple or spanish
    token: str  # names the batch it was made from


#: Letters and digits of words among the characters of Latin-1, all others as spaces.
LETTERS = bytes(b if WORD.fullmatch(bytes([b]).decode("latin-1")) else 32 for b in range(256))


def _words(text: str | None) -> list[str]:
    """The words of a text in order, as ``WORD`` finds them: all their characters are Latin-1's."""
    return (text or "").lower().encode("latin-1", "replace").translate(LETTERS).decode("latin-1").split()


def lexemes(text: str | None, config: str) -> list[tuple[str, int]]:
    """(lexeme, position from 1) of the indexed words; words that aren't indexed take up positions.  ``simple`` indexes every word as it is."""
    words = enumerate(_words(text), 1)
    if config == "simple":
        return [(w, k) for k, w in words]
    skip = spanish.stop_words()
    return [(spanish.stem(w), k) for k, w in words if w not in skip]


class _Codes(dict):
    """Number of the lexeme of each word, -1 of a word that isn't indexed; a word's stem is made once."""

    def __init__(self, config: str):
        self.config, self.names, self.known = config, [], {}

    def __missing__(self, word: str) -> int:
        found = lexemes(word, self.config)
        self[word] = code = self.known.setdefault(found[0][0], len(self.names)) if found else -1
        if code == len(self.names):
            self.names.append(found[0][0])
        return code


def postings(docs: DataFrame, config: str = "spanish") -> DataFrame:
    """(lexeme, doc_id, positions) of whole texts, made in the tasks that read them; a null or empty text has none."""

    def grouped(ids: list[int], words: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        code = np.concatenate(words)
        place = np.arange(1, len(code) + 1) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        key = np.repeat(np.arange(len(words)), lengths) * len(names) + code
        kept = np.flatnonzero(code >= 0)
        order = kept[np.argsort(key[kept], kind="stable")]  # places of a lexeme of a text stay in order
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), pa.array(place[order], pa.int32()))
        of, lexeme = np.divmod(key[starts], max(1, len(names)))
        rows = pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(lexeme)), pa.array(ids, pa.int64()).take(pa.array(of)), lists], names=["lexeme", "doc_id", "positions"])
        for at in range(0, rows.num_rows, BATCH_ROWS):
            yield rows.slice(at, BATCH_ROWS)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(config)
        ids: list[int] = []
        words: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = _words(text.as_py())
                ids.append(doc_id)
                words.append(np.fromiter(map(codes.__getitem__, own), np.int64, len(own)))
                held += len(own)
                if held >= BATCH_WORDS:
                    yield from grouped(ids, words, codes.names)
                    ids, words, held = [], [], 0
                    if len(codes) > MEMORY:
                        codes = _Codes(config)
        if ids:
            yield from grouped(ids, words, codes.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, "lexeme string, doc_id long, positions array<int>")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def log(spark: SparkSession, path: str) -> list[Segment]:
    """All segments that ever held, oldest first."""
    fs, at = _files(spark, f"{path}/log")
    if not fs.exists(at):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(at))
    return [Segment(int(n), kind, config, token) for n, kind, config, token in (name.split("-", 3) for name in names if name[0].isdigit())]


def live(segments: list[Segment]) -> list[Segment]:
    """The last base and what came after it."""
    last = max((k for k, s in enumerate(segments) if s.kind == "base"), default=0)
    return segments[last:]


def _put(spark: SparkSession, path: str, kind: str, config: str, token: str, rows: DataFrame, touched: DataFrame) -> None:
    number = max((s.number for s in log(spark, path)), default=-1) + 1
    dealt = rows.withColumn("part", (F.crc32(F.col("lexeme").cast("binary")) % PARTS).cast("int"))
    # dealt without a sample, for which all postings would be made twice; a part of very many is split, as rebalancing cuts large partitions
    dealt = dealt.hint("rebalance", F.col("part")).sortWithinPartitions("part", "lexeme", "doc_id")
    dealt.write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings/segment={number}")
    touched.write.mode("overwrite").parquet(f"{path}/touched/segment={number}")
    fs, at = _files(spark, f"{path}/log/{number:09d}-{kind}-{config}-{token}")
    fs.create(at, False).close()


def create(docs: DataFrame, path: str, config: str = "spanish") -> None:
    """A new index of ``docs`` (doc_id, text) at ``path``, which may not have one yet.

    Rows without a doc_id are left out, as nothing could be found or changed by it; several rows of a document count as one
    text with all their places.  An empty table gives an index that finds nothing.
    """
    spark = docs.sparkSession
    if log(spark, path):
        raise FileExistsError(f"{path} has an index already")
    known = docs.where("doc_id IS NOT NULL")
    _put(spark, path, "base", config, "create", postings(known, config), known.select(F.col("doc_id").cast("long")).limit(0))


def apply(changes: DataFrame, path: str, token: str = "apply") -> None:
    """Inserts, changes and deletions (doc_id, text, deleted) as one delta segment.

    Where a batch has several rows of a document, a deletion among them wins; else their places are put together.
    """
    spark = changes.sparkSession
    config = live(log(spark, path))[0].config
    known = changes.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text", F.coalesce("deleted", F.lit(False)).alias("deleted"))
    gone = known.where("deleted").select("doc_id").distinct()
    kept = known.where("NOT deleted").join(gone, "doc_id", "left_anti")
    _put(spark, path, "delta", config, token, postings(kept, config), known.select("doc_id").distinct())


def _rows(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """Postings that hold: of each document those of its newest segment; of the lexemes ``wanted`` only, which prunes folders and row groups."""
    now = live(log(spark, path))
    folders = lambda kind, some: [f"{path}/{kind}/segment={s.number}" for s in some]
    rows = spark.read.schema(POSTINGS).option("basePath", f"{path}/postings").parquet(*folders("postings", now))
    if wanted is not None:
        parts = sorted({zlib.crc32(w.encode()) % PARTS for w in wanted})
        rows = rows.where(F.col("part").isin(parts) & F.col("lexeme").isin(wanted))
    if len(now) > 1:
        touched = spark.read.schema("doc_id long, segment int").option("basePath", f"{path}/touched").parquet(*folders("touched", now[1:]))
        newer = touched.select(F.col("doc_id").alias("of"), F.col("segment").alias("later"))
        rows = rows.join(newer, (F.col("doc_id") == F.col("of")) & (F.col("later") > F.col("segment")), "left_anti")
    return rows


def compact(spark: SparkSession, path: str) -> None:
    """All that holds as a new base; searches that began before go on with the old segments until ``vacuum``."""
    now = live(log(spark, path))
    rows = _rows(spark, path).select("lexeme", "doc_id", "positions")
    _put(spark, path, "base", now[0].config, "compact", rows, rows.select("doc_id").limit(0))


def vacuum(spark: SparkSession, path: str) -> None:
    """Deletes the files of segments before the last base; their log stays, as it names batches that are done."""
    segments = log(spark, path)
    for s in segments[: len(segments) - len(live(segments))]:
        for kind in ("postings", "touched"):
            fs, at = _files(spark, f"{path}/{kind}/segment={s.number}")
            fs.delete(at, True)


def maintain(changes: DataFrame, path: str, checkpoint: str, name: str = "stream"):
    """A stream of changes that keeps the index up to date, a delta segment a batch; a batch that is replayed changes nothing."""

    def put(batch: DataFrame, number: int) -> None:
        token = f"{name}.{number}"
        if token not in {s.token for s in log(batch.sparkSession, path)}:
            apply(batch, path, token)

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cover_density(entries: DataFrame, terms: int) -> DataFrame:
    """(doc_id, rank) of ``entries`` (doc_id, position, term from 0): the sum over minimal covers of all terms of WEIGHT / (1 + words between entries).

    Each cover is found at its last entry, as the stretch from the earliest of the terms' last places, unless the entry before ends one with the same start.
    """
    order = Window.partitionBy("doc_id").orderBy("position", "term")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = entries.withColumn("row", F.row_number().over(order))
    place = F.struct("position", "row")
    lasts = [F.last(F.when(F.col("term") == k, place), ignorenulls=True).over(so_far).alias(f"last{k}") for k in range(terms)]
    rows = rows.select("doc_id", "position", "row", *lasts)
    every = reduce(lambda a, b: a & b, (F.col(f"last{k}").isNotNull() for k in range(terms)))
    least = F.col("last0") if terms == 1 else F.least(*(F.col(f"last{k}") for k in range(terms)))
    rows = rows.select("doc_id", "position", "row", F.when(every, least).alias("begin"))
    rows = rows.withColumn("former", F.lag("begin").over(Window.partitionBy("doc_id").orderBy("row")))
    covers = rows.where("begin IS NOT NULL AND (former IS NULL OR begin.row > former.row)")
    between = (F.col("position") - F.col("begin.position")) - (F.col("row") - F.col("begin.row"))
    return covers.groupBy("doc_id").agg(F.round(F.sum(WEIGHT / (1 + F.greatest(between, F.lit(0)))), 6).alias("rank"))


def search(spark: SparkSession, path: str, query: str, k: int, scope: DataFrame | None = None) -> DataFrame:
    """(doc_id, rank) of the k best documents (of those in ``scope``, if given) that have all lexemes of the query; ties by doc_id.

    Texts aren't read.  A query without lexemes finds nothing.
    """
    config = live(log(spark, path))[0].config
    wanted = sorted({x for x, _ in lexemes(query, config)})
    if not wanted:
        return spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("rank", T.DoubleType())]))
    found = _rows(spark, path, wanted)
    if scope is not None:
        found = found.join(scope.select("doc_id").distinct(), "doc_id", "left_semi")
    of = Window.partitionBy("doc_id")
    every = found.withColumn("lexemes", F.size(F.collect_set("lexeme").over(of))).where(F.col("lexemes") == len(wanted))
    number = F.array_position(F.array(*map(F.lit, wanted)), F.col("lexeme")) - 1
    entries = every.select("doc_id", number.cast("int").alias("term"), F.explode("positions").alias("position"))
    return cover_density(entries, len(wanted)).orderBy(F.desc("rank"), "doc_id").limit(k)
