"""Rule ledger: every quality rule is evaluated once a document and its outcome kept as a bit.

The ledger holds the measurements and one integer of failure bits.  Policies are versioned sets of
rules; applying one, comparing two or leaving a rule out (an ablation) reads the bits alone, by bitwise
operations and aggregates, and never the texts again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.llm.common import by_bytes, lean

SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: What is measured of a text, in the order of ``measure``.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words", "n_bullet_lines", "n_ellipsis_lines")
#: Texts that a task has in Python's form at a time, in bytes.
RUN_BYTES = 4 << 20
_LETTER = np.asarray([b >= 128 or chr(b).isalpha() for b in range(256)])
_SPACE = np.asarray([b in SPACE for b in range(256)])


class Rule(NamedTuple):
    """A rule's bit and failure, as a condition on the measurements that holds in Spark and in other SQL alike."""

    bit: int
    fails: str


#: A rule keeps its bit for good: ledgers are read by later policies.
RULES = {
    "few_words": Rule(0, "n_words < 50"),
    "repeated_windows": Rule(1, "100 * n_repeat_words > 50 * n_words"),
    "many_words": Rule(2, "n_words > 100000"),
    "short_words": Rule(3, "word_chars < 3 * n_words"),
    "long_words": Rule(4, "word_chars > 10 * n_words"),
    "symbols": Rule(5, "10 * n_symbols > n_words"),
    "duplicate_lines": Rule(6, "100 * n_dup_lines > 30 * n_lines"),
    "few_alphabetic_words": Rule(7, "100 * n_alpha_words < 80 * n_words"),
    "bullet_lines": Rule(8, "100 * n_bullet_lines > 90 * n_lines"),
    "ellipsis_lines": Rule(9, "100 * n_ellipsis_lines > 30 * n_lines"),
}
BASE = ("few_words", "repeated_windows")
#: Policies by version.  A version never changes; a new one is added.
POLICIES = {
    1: BASE,
    2: (*BASE, "short_words", "long_words", "symbols", "duplicate_lines"),
    3: tuple(RULES),
}
LATEST = max(POLICIES)


def _repeated(words: list[bytes], width: int = 3) -> int:
    """Words in windows of ``width`` that the text has twice or more."""
    n = len(words)
    if n <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) > n - width:  # too few words come twice for a window to do so
        return 0
    code = ids
    for k in range(1, width):
        code = np.unique(code[:-1] * len(known) + ids[k:], return_inverse=True)[1]
    at = np.flatnonzero(np.bincount(code)[code] > 1)
    hit = np.zeros(n, bool)
    for k in range(width):
        hit[at + k] = True
    return int(hit.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """``MEASURES`` of a whole text; words end at ASCII spaces, lines at line feeds, and a line without a word isn't counted."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    raw = np.frombuffer(text, np.uint8)
    in_word = ~_SPACE[raw]
    starts = in_word & ~np.concatenate(([False], in_word[:-1]))
    of_letter = np.cumsum(starts)[_LETTER[raw]]
    alpha = int((np.diff(of_letter) > 0).sum()) + (len(of_letter) > 0)
    bare = [x.strip() for x in lines]
    bullets = sum(x.startswith((b"-", b"*", "•".encode())) for x in bare)
    ellipses = sum(x.endswith((b"...", "…".encode())) for x in bare)
    chars = int((in_word & ((raw & 0xC0) != 0x80)).sum())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeated(words), len(lines), alpha, bullets, ellipses


def failures() -> Column:
    """The failure bits of a row of measurements."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES.values()]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def ledger(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``MEASURES`` and ``failures`` of each row of ``docs`` (``key``, text and whatever else).

    A null text has no words and an empty one neither; both fail ``few_words`` alone.  Repeated rows and
    rows without a key stay, very long texts are measured whole, and an empty table gives no rows.
    """
    schema = T.StructType([docs.schema[key], *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for at, n in by_bytes(texts, RUN_BYTES):
                found = np.asarray([measure(x or b"") for x in texts.slice(at, n).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *(pa.array(c) for c in found.T)], names=schema.names)

    return docs.select(key, "text").mapInArrow(lean(measured), schema).withColumn("failures", failures())


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES[r].bit for r in set(rules))


def kept(version: int = LATEST) -> Column:
    """Whether a row of a ledger passes a policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0


def _patterns(kept_rows: DataFrame, by: list[str], bits: int) -> DataFrame:
    """Rows by pattern of failure bits: at most two to the number of rules, whatever the number of documents."""
    return kept_rows.groupBy(*by, F.col("failures").bitwiseAND(F.lit(bits)).alias("pattern")).agg(F.count("*").alias("n"))


def ablation(rows: DataFrame, version: int = LATEST, by: tuple[str, ...] = ()) -> DataFrame:
    """For each rule of a policy (and group of ``by``): documents, those that pass, that fail the rule, that fail it alone, and that pass without it."""
    some = _patterns(rows, list(by), mask(POLICIES[version]))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r].bit).cast("long").alias("bit")) for r in POLICIES[version])))
    each = some.select("*", rules.alias("r")).select(*by, "pattern", "n", "r.rule", "r.bit")
    pattern, bit = F.col("pattern"), F.col("bit")

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return each.groupBy(*by, "rule").agg(
        F.sum("n").alias("n_docs"),
        count(pattern == 0).alias("n_kept"),
        count(pattern.bitwiseAND(bit) != 0).alias("n_failed"),
        count(pattern == bit).alias("n_failed_alone"),
        count(pattern.bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept_without"),
        F.bit_or(F.when(pattern.bitwiseAND(bit) != 0, pattern.bitwiseXOR(bit))).alias("failed_with"),
    )


def changes(rows: DataFrame, old: int, new: int) -> DataFrame:
    """One row: documents, and how many both versions keep, only the old one, only the new one, and neither."""
    some = _patterns(rows, [], mask(POLICIES[old]) | mask(POLICIES[new]))
    was, now = ((F.col("pattern").bitwiseAND(F.lit(mask(POLICIES[v]))) == 0) for v in (old, new))
    named = {"both": was & now, "only_old": was & ~now, "only_new": ~was & now, "neither": ~was & ~now}
    return some.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), *(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in named.items()))
