"""Queries over stored indexes: full text with upkeep and nearest vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from folia.catalog import register
from folia.operators import retrieval, text_index, vector_index
from folia.sources.folders import shared
from folia.sources.tables import dealt, table

EDITED = """
c AS (SELECT doc_id, text, 0 AS n FROM documents
  UNION ALL SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN text || ' from that' END, 1 FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0
  UNION ALL SELECT CASE WHEN doc_id % 11 = 0 THEN -1 - doc_id ELSE doc_id END, text, 2 FROM documents WHERE doc_id % 35 = 0 OR doc_id % 11 = 0),
e AS (SELECT doc_id, text FROM c QUALIFY n = max(n) OVER (PARTITION BY doc_id))"""
COVERS = """
w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-zà-öø-ÿ0-9]+'), lambda x: x <> '') AS w FROM e),
t AS (SELECT doc_id, w[i] AS term, i AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) WHERE w[i] IN ('the', 'from', 'that')),
l AS (SELECT doc_id, pos, r, max(CASE WHEN term = 'the' THEN r END) OVER o AS a, max(CASE WHEN term = 'from' THEN r END) OVER o AS b, max(CASE WHEN term = 'that' THEN r END) OVER o AS c FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY r)),
s AS (SELECT doc_id, pos, r, least(a, b, c) AS begins FROM l WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
v AS (SELECT s.doc_id, 0.1::DOUBLE / (1 + (s.pos - t.pos) - (s.r - t.r)) AS x FROM (SELECT *, lag(begins) OVER (PARTITION BY doc_id ORDER BY r) AS former FROM s) s JOIN t ON t.doc_id = s.doc_id AND t.r = begins WHERE former IS NULL OR begins > former)
SELECT doc_id, round(sum(x), 6) AS rank FROM v GROUP BY doc_id ORDER BY rank DESC, doc_id LIMIT 50"""


def _edited(s, d, path):
    """An index of all documents, changed by two batches: new texts and deletions, then texts that come back and new documents."""
    docs = dealt(table(s, d, "documents").select("doc_id", "text"), "doc_id")
    text_index.create(docs, path, "simple")
    fifth, seventh, eleventh = (F.col("doc_id") % k == 0 for k in (5, 7, 11))
    text_index.apply(docs.where(fifth | seventh).select("doc_id", F.concat("text", F.lit(" from that")).alias("text"), seventh.alias("deleted")), path)
    back = docs.where((F.col("doc_id") % 35 == 0) | eleventh)
    text_index.apply(back.select(F.when(eleventh, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), "text", F.lit(False).alias("deleted")), path)


@register("ret2_search_of_changed_index", "WITH " + EDITED + ", " + COVERS)
def ret2_changed(s, d):
    """The best by cover density from the base and both deltas."""
    path = shared(s, "index")
    _edited(s, d, path)
    return text_index.search(s, path, "the from that", 50)


@register("ret2_search_of_compacted_index", "WITH " + EDITED + ", " + COVERS)
def ret2_compacted(s, d):
    """The same after the segments have become one."""
    path = shared(s, "index")
    _edited(s, d, path)
    text_index.compact(s, path)
    text_index.vacuum(s, path)
    return text_index.search(s, path, "the from that", 50)


@register("ret2_lexeme_postings")
def ret2(s, d):
    """Documents and places of each Spanish stem."""
    rows = text_index.postings(dealt(table(s, d, "documents"), "doc_id"))
    return rows.groupBy("lexeme").agg(F.count_distinct("doc_id").alias("docs"), F.sum(F.size("positions")).alias("places"))


@register("ret2_word_postings", """
SELECT word AS lexeme, count(DISTINCT doc_id) AS docs, count(*) AS places FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-zà-öø-ÿ0-9]+'), lambda x: x <> '')) AS word FROM documents) GROUP BY 1""")
def ret2_words(s, d):
    """Documents and places of each word as it is."""
    rows = text_index.postings(dealt(table(s, d, "documents"), "doc_id"), "simple")
    return rows.groupBy("lexeme").agg(F.count_distinct("doc_id").alias("docs"), F.sum(F.size("positions")).alias("places"))


@register("ret3_search_of_stored_index")
def ret3_stored(s, d):
    """The best documents for Spanish words, by their stems, from a stored index."""
    path = shared(s, "index")
    text_index.create(dealt(table(s, d, "documents"), "doc_id"), path)
    return text_index.search(s, path, "the from that", 50)


@register("ret3_cover_density", "WITH e AS (SELECT doc_id, text FROM documents), " + COVERS)
def ret3(s, d):
    """The best documents by cover density of three words as they are, from a stored index."""
    path = shared(s, "index")
    text_index.create(dealt(table(s, d, "documents"), "doc_id"), path, "simple")
    return text_index.search(s, path, "the from that", 50)


EACH = """WITH n AS (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0)
SELECT query, vec_id, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS place FROM n) WHERE place <= 10"""


def _indexed(s, d):
    path = shared(s, "vectors")
    vectors = table(s, d, "embeddings")
    vector_index.create(vectors, path)
    return path, vectors


@register("ret1_index_with_all_cells", EACH)
def ret1_all(s, d):
    """The ten nearest of every vector whose id is divisible by 100, from all cells, which is exact."""
    path, vectors = _indexed(s, d)
    return vector_index.search_many(vectors.where("vec_id % 100 = 0"), path, 10, vector_index.MOST_CELLS)


@register("ret1_index_with_few_cells")
def ret1_few(s, d):
    """The same from as many cells as the index found enough."""
    path, vectors = _indexed(s, d)
    return vector_index.search_many(vectors.where("vec_id % 100 = 0"), path, 10)


@register("ret1_recall_of_few_cells")
def ret1_recall(s, d):
    """Of the ten exact neighbours of each of these vectors, how many the nearest cells give."""
    path, vectors = _indexed(s, d)
    asked = vectors.where("vec_id % 100 = 0")
    exact = vector_index.search_many(asked, path, 10, vector_index.MOST_CELLS).select("query", "vec_id")
    few = vector_index.search_many(asked, path, 10).select("query", "vec_id", F.lit(1).alias("hit"))
    return exact.join(few, ["query", "vec_id"], "left").groupBy("query").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))


@register("ret1_vector_topk_from_index", "WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])), 6) AS similarity FROM embeddings, q WHERE label = 2 ORDER BY similarity DESC, vec_id LIMIT 10")
def ret1_one(s, d):
    """The filtered search of one vector, from all cells."""
    path, vectors = _indexed(s, d)
    return vector_index.search(s, path, retrieval.query_vector(vectors, 0), 10, vector_index.MOST_CELLS, F.col("label") == 2)
