"""Hybrid retrieval: vector and full-text candidates, their fusion, boosts and the context they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.sources.tables import NOW, moment

# Weights of the two candidate lists, boosts by age, and how much is fetched for k results.
VECTOR_WEIGHT, TEXT_WEIGHT, FLOOR = 0.7, 0.3, 0.001
RECENT = ((30.0, 0.1), (90.0, 0.05))
RECENCY_WORDS = ("último", "última", "actual", "vigente", "reciente", "estado", "hoy", "pendiente", "próximo", "vence")


def over_fetch(k: int) -> int:
    return max(2 * k, 10)


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity to one query vector, in doubles; null for a zero vector."""
    q = F.array(*(F.lit(float(x)) for x in query))
    x = F.transform(vector, lambda e: e.cast("double"))
    dot = F.aggregate(F.zip_with(x, q, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, b: a + b * b))
    return dot / F.nullif(norm(x) * norm(q), F.lit(0.0))


def query_vector(vectors: DataFrame, vec_id: int) -> list[float]:
    """The one vector that is asked with."""
    return [float(x) for x in vectors.where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def vector_search(vectors: DataFrame, query: list[float], k: int, label: int | None = None) -> DataFrame:
    """(vec_id, similarity) of the k nearest, ties by vec_id; exact."""
    if label is not None:
        vectors = vectors.where(F.col("label") == label)
    return vectors.select("vec_id", F.round(cosine(F.col("embedding"), query), 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(k)


def words(text: Column) -> Column:
    """Lower-case runs of letters of the four languages."""
    return F.filter(F.split(F.lower(text), r"[^a-zà-öø-ÿ]+"), lambda w: w != "")


LETTERS = "a-zà-öø-ÿ"


def text_search(docs: DataFrame, terms: list[str], k: int) -> DataFrame:
    """(doc_id, rank) of texts that have all terms (words of letters): their share of the words, ties by doc_id.

    Words are counted by patterns, never made: a text without a term's letters isn't looked at further.
    """
    low = F.lower("text")
    for t in terms:
        docs = docs.where(F.contains(low, F.lit(t)))
    times = [F.regexp_count(low, F.lit(f"(?<![{LETTERS}]){t}(?![{LETTERS}])")).alias(f"t{i}") for i, t in enumerate(terms)]
    counted = docs.select("doc_id", F.regexp_count(low, F.lit(f"[{LETTERS}]+")).alias("n"), *times)
    hits = sum(F.col(f"t{i}") for i in range(len(terms)))
    every = F.array_min(F.array(*(F.col(f"t{i}") for i in range(len(terms))))) > 0
    return counted.where(every).select("doc_id", F.round(hits / F.col("n"), 6).alias("rank")).orderBy(F.desc("rank"), "doc_id").limit(k)


def fuse(vector: DataFrame, text: DataFrame) -> DataFrame:
    """Full outer join of two short ranked lists (id, similarity) and (id, rank), each scaled by its largest value."""
    both = vector.join(text, "id", "full")
    everywhere = Window.partitionBy()  # two lists of over_fetch(k) rows
    top = lambda c: F.greatest(F.max(c).over(everywhere), F.lit(FLOOR))
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / top(c)
    return both.select("id", F.round(VECTOR_WEIGHT * share("similarity") + TEXT_WEIGHT * share("rank"), 6).alias("score"))


def age_days(column: str) -> Column:
    return (F.unix_micros(F.lit(NOW).cast("timestamp")) / 1e6 - moment(column)) / 86_400


def recency_boost(score: Column, created: str) -> Column:
    age = age_days(created)
    return F.round(score + F.when(age < RECENT[0][0], RECENT[0][1]).when(age < RECENT[1][0], RECENT[1][1]).otherwise(0.0), 6)


def asks_for_recent(question: str) -> bool:
    return any(w in question.lower() for w in RECENCY_WORDS)


def hybrid(vectors: DataFrame, docs: DataFrame, created: DataFrame, query: list[float], terms: list[str], k: int, label: int | None = None, question: str = "") -> DataFrame:
    """(id, score): fused, boosted by age where the question asks for recent documents, the best k.

    ``created`` has (id, created_at); a candidate without a date gets no boost.
    """
    n = over_fetch(k)
    found = fuse(vector_search(vectors, query, n, label).withColumnRenamed("vec_id", "id"), text_search(docs, terms, n).withColumnRenamed("doc_id", "id"))
    if asks_for_recent(question):
        found = docs.sparkSession.createDataFrame(found.collect(), found.schema)  # 2 n rows at most, which two joins need
        dated = created.join(F.broadcast(found.select(F.col("id").alias("of"))), F.col("id") == F.col("of"), "left_semi")
        found = found.join(F.broadcast(dated), "id", "left").select("id", recency_boost(F.col("score"), "created_at").alias("score"))
    return found.orderBy(F.desc("score"), "id").limit(k)
