"""The corpus pipeline: toxicity, near-duplicates, repeated substrings, benchmark leaks, packing."""

from __future__ import annotations

from folia.llm import stages
from folia.llm.common import forget, table, written

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("simhash_near_dedup", stages.keep_one_of_near_copies),
    ("suffix_array_dedup", stages.drop_repeated_substrings),
    ("benchmark_decontamination", stages.drop_contaminated),
    ("best_fit_packing", stages.pack),
]

#: No SQL expresses the compression distance of the first stage.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies the stages to ``documents``, each to the table that the one before it wrote."""
    docs, former = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if former is not None:
            forget(former)
        former = docs
    return STAGES[-1][1](spark, docs, sf_dir)
