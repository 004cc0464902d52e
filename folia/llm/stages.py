"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of ``docs``; a row that a stage keeps is otherwise unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folia.llm.common import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from their labels, calls toxic go."""
    from folia.llm.toxicity import fit, keep_clean

    return keep_clean(docs, fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    from folia.llm.simhash import keep_representatives

    return keep_representatives(docs)


def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a document with a smaller doc_id has too are cut out."""
    from folia.llm.substrings import remove_repeats

    return remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    from folia.llm.decontamination import drop_hits

    return drop_hits(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per token piece with its sequence and its place there."""
    from folia.llm.queries import packed_digest

    return packed_digest(docs)
