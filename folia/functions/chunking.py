"""Splitting of texts into overlapping chunks that end at legal or sentence boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.functions.sections import matches
from folia.functions.slices import sliced

# Sizes in tokens of five characters.
CHARS_PER_TOKEN, TARGET, OVERLAP, LEAST, SHORT = 5, 768, 115, 50, 200
FLEX = int(TARGET * 0.30 * CHARS_PER_TOKEN)
BOUNDARY_TYPES = frozenset(("vistos", "considerando", "considerando_n", "resolutivo", "en_lo_principal", "otrosi", "petitorio", "receptor_certificacion", "audiencia_conciliacion", "audiencia_prueba", "mandamiento"))

CHUNK = "doc_id long, chunk_index int, chunk_text string, start_offset int, end_offset int, token_estimate int, overlap boolean"


def tokens(text: Column, per: int = CHARS_PER_TOKEN) -> Column:
    return F.ceil(F.length(text) / per)


class _Places:
    """Sorted places of legal boundaries and of sentence ends of one text."""

    def __init__(self, text: str):
        self.legal = sorted({m.start() for _, m in matches(text, BOUNDARY_TYPES)})
        self.sentence = [m.end() for m in re.finditer(r"\. |\n\n", text)]

    @staticmethod
    def near(places: list[int], at: int, flex: int) -> int | None:
        """The first place up to ``flex`` after ``at``, else the last one up to ``flex`` before it."""
        k = bisect_left(places, at)
        if k < len(places) and places[k] <= at + flex:
            return places[k]
        return places[k - 1] if k and places[k - 1] >= at - flex else None


def split(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks of a text.

    A short text is one chunk.  Otherwise a chunk aims at TARGET tokens and ends at the nearest
    legal boundary, else sentence end, else space; the next one begins up to OVERLAP tokens before, at
    the start of a sentence where there is one.  A remnant of fewer than LEAST tokens that isn't the
    last joins the chunk before it.
    """
    n = len(text)
    if not text.strip():
        return
    if n <= SHORT * CHARS_PER_TOKEN:
        yield 0, n
        return
    places, start, held = _Places(text), 0, None
    while start < n:
        ideal = start + TARGET * CHARS_PER_TOKEN
        if ideal >= n:
            end = n
        else:
            end = places.near(places.legal, ideal, FLEX) or places.near(places.sentence, ideal, FLEX)
            if end is None:
                space = text.find(" ", ideal, ideal + FLEX + 1)
                end = space + 1 if space >= 0 else ideal
            if end <= start:
                end = min(ideal, n)
        size = -(-len(text[start:end].strip()) // CHARS_PER_TOKEN)
        if held is None:
            held = (start, end)
        elif size >= LEAST or end >= n:
            yield held
            held = (start, end)
        else:
            held = (held[0], end)
        if end >= n:
            break
        back, reach = end - OVERLAP * CHARS_PER_TOKEN, int(OVERLAP * CHARS_PER_TOKEN * 1.35)
        k = bisect_left(places.sentence, end)
        begin = places.sentence[k - 1] if k else -1  # the last sentence that begins before the end
        start = max(start + 1, begin if begin >= max(0, end - reach, 2 * back - end) else max(0, back))
    if held:
        yield held


def chunk(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), texts: bool = True) -> DataFrame:
    """One row for each chunk of each text, with the columns ``keep`` of its document; an empty text has none.

    Where ``texts`` is false, chunks have their places but not their text.
    """
    names = [c.split()[0] for c in CHUNK.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
    schema = T.StructType([*(f for f in T.StructType.fromDDL(CHUNK) if texts or f.name != "chunk_text"), *(docs.schema[c] for c in keep)])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in sliced(batch.column(1)):
                some, rows, of = batch.slice(a, b - a), [], []
                for at, (doc_id, own) in enumerate(zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)):
                    for k, (start, end) in enumerate(split(own or "")):
                        part = own[start:end].strip()
                        rows.append((doc_id, k, part if texts else None, start, end, -(-len(part) // CHARS_PER_TOKEN), k > 0))
                        of.append(at)
                made = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds) if texts or names[j] != "chunk_text"]
                yield pa.RecordBatch.from_arrays(made + [some.column(2 + j).take(pa.array(of, pa.int64())) for j in range(len(keep))], names=schema.names)

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"), *keep).mapInArrow(make, schema)


def section_of(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """``chunks`` with section_type: the section that the chunk starts in, else 'general'.

    Sections of a document are few and disjoint: they ride along as one array, so that no range join is needed.
    """
    own = sections.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "type")).alias("s"))
    inside = F.filter("s", lambda x: (x["start"] <= F.col("start_offset")) & (F.col("start_offset") < x["stop"]))
    return chunks.join(own, "doc_id", "left").withColumn("section_type", F.coalesce(F.get(inside, F.lit(0))["type"], F.lit("general"))).drop("s")
