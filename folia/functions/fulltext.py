"""Full-text search: light stemming, postings, and ranking by cover density."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Stop words that are not indexed, and Spanish endings that the stemmer takes off, longest first.
STOP_WORDS = frozenset("a al con de del el en es la las lo los no o para por que se su un una y".split())
ENDINGS = ("aciones", "amiento", "imiento", "ación", "mente", "ciones", "ción", "idad", "ando", "iendo", "ados", "idos", "adas", "idas", "ado", "ido", "ada", "ida", "es", "os", "as", "o", "a", "e", "s")
LEAST_STEM = 3

#: Rows of a frame of postings; folders of a stored index; files over which a folder's documents are spread.
FRAME_ROWS, PARTS, SALTS = 100_000, 64, 8


def stem(word: str) -> str:
    """The word without the first of the endings that leaves a stem of three letters or more."""
    for end in ENDINGS:
        if word.endswith(end) and len(word) - len(end) >= LEAST_STEM:
            return word[: -len(end)]
    return word


def lexemes(text: str | None) -> list[tuple[str, int]]:
    """(lexeme, position) of the indexed words; stop words take up positions."""
    words = re.findall(r"[a-zà-öø-ÿ0-9]+", (text or "").lower())
    return [(stem(w), k) for k, w in enumerate(words, 1) if w not in STOP_WORDS]


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, lexeme, position) of all texts, made where the texts are, some 100,000 rows at a time."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, names, places = [], [], []
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                for lexeme, place in lexemes(text):
                    ids.append(doc_id)
                    names.append(lexeme)
                    places.append(place)
                if len(ids) >= FRAME_ROWS:
                    yield pd.DataFrame({"doc_id": ids, "lexeme": names, "position": places})
                    ids, names, places = [], [], []
        if ids:
            yield pd.DataFrame({"doc_id": ids, "lexeme": names, "position": places})

    return docs.select("doc_id", "text").mapInPandas(make, "doc_id long, lexeme string, position int")


def store(docs: DataFrame, path: str) -> None:
    """Writes the inverted index of all texts: a row for each lexeme of a document with its places.

    Rows are laid out by a checksum of the lexeme and sorted by lexeme in each file, so a search reads few
    folders and, in them, few row groups.  A lexeme of very many documents is spread over ``SALTS`` files.
    Repeated rows of documents give repeated places; a null text gives none.
    """
    rows = postings(docs).groupBy("lexeme", "doc_id").agg(F.array_sort(F.collect_list("position")).alias("positions"))
    rows = rows.withColumn("part", F.crc32(F.col("lexeme").cast("binary")) % PARTS)
    spread = rows.repartition("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    spread.sortWithinPartitions("part", "lexeme", "doc_id").write.partitionBy("part").mode("errorifexists").parquet(path)


def search_stored(index: DataFrame, query: str, k: int) -> DataFrame:
    """As ``search``, from a stored index: only the query's lexemes are read, texts never; no lexemes find nothing."""
    wanted = sorted({x for x, _ in lexemes(query)})
    parts = sorted({zlib.crc32(w.encode()) % PARTS for w in wanted})
    found = index.where(F.col("part").isin(parts) & F.col("lexeme").isin(wanted))
    # one row for each lexeme of the query, so a document's group is as large as its own words
    docs = found.groupBy("doc_id").agg(F.collect_list(F.struct("lexeme", "positions")).alias("found")).where(F.size("found") == len(wanted))
    ways = F.array_sort(F.flatten(F.transform("found", lambda x: F.transform(x["positions"], lambda p: F.struct(p.alias("position"), x["lexeme"].alias("lexeme"))))))

    def rank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ranks = [round(cover_density(list(zip(p, n, strict=True)), len(wanted)), 6) for n, p in zip(frame["names"], frame["places"], strict=True)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "rank": pd.Series(ranks, index=frame.index, dtype="float64")})

    placed = docs.select("doc_id", ways.alias("w")).select("doc_id", F.col("w.lexeme").alias("names"), F.col("w.position").alias("places"))
    return placed.mapInPandas(rank, "doc_id long, rank double").where("rank > 0").orderBy(F.desc("rank"), "doc_id").limit(k)


def cover_density(places: list[tuple[int, int]], terms: int) -> float:
    """Sum over minimal covers of (terms / words the cover spans): places are (position, term), sorted."""
    last, total = {}, 0.0
    best = 0
    for position, term in places:
        last[term] = position
        if len(last) == terms:
            begin = min(last.values())
            if begin > best:
                total += terms / (position - begin + 1)
                best = begin
    return total


def search(docs: DataFrame, query: str, k: int) -> DataFrame:
    """(doc_id, rank) of the k best texts that have all lexemes of the query; ties by doc_id."""
    wanted = sorted({x for x, _ in lexemes(query)})
    number = {w: i for i, w in enumerate(wanted)}

    def rank(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            places = [(p, number[x]) for x, p in lexemes(text) if x in number]
            out.append(cover_density(places, len(wanted)) if len({t for _, t in places}) == len(wanted) else 0.0)
        return pd.Series(out, dtype="float64")

    ranked = docs.select("doc_id", F.round(F.pandas_udf(rank, "double")("text"), 6).alias("rank"))
    return ranked.where("rank > 0").orderBy(F.desc("rank"), "doc_id").limit(k)
