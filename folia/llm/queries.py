"""The registered query of each operator: it derives the contract's columns from the operator's rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm import sql
from folia.llm.common import crc32_of, table

Query = Callable[[SparkSession, str], DataFrame]


def held_out(modulus: int, remainder: int):
    return (F.pmod(crc32_of("doc_id"), F.lit(modulus)) == remainder).alias("held_out")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed_digest(docs: DataFrame) -> DataFrame:
    from folia.llm.packing import pack_pieces, tokenize_pieces

    pieces = tokenize_pieces(docs, tokenizer_path())
    return pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: query for name, query in globals().items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name.removeprefix("SQL_"): sql for name, sql in globals().items() if name.startswith("SQL_op")}


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.decontamination import find_hits, items_digest

    hits = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_digest().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.simhash import hex_of, near_groups

    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def op8_bounded_load_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.ring import assign

    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = assign(rows, 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_mpeg_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.transport_stream import read, store

    return read(store(table(spark, sf_dir, "documents")))


def op9_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.warc import archive_index

    index = archive_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "range_no", "range_pos")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.substrings import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents"))


def op3_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rated.select("doc_id", held_out(5, 0), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"))


def op7_naive_bayes_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.nbsvm import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rated.select("doc_id", held_out(5, 0), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op4_subword_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from folia.llm.lattice import document_scores

    return document_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.manifest import leaf_of, manifest, proof_digest, verified

    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs, altered = table(spark, sf_dir, "documents"), F.replace("text", F.lit("\n"), F.lit(""))
    tampered = docs.withColumn("altered", F.when(crc32_of("doc_id") % 2 == 0, altered).otherwise(F.col("text")))
    kept = tampered.withColumn("altered_leaf", leaf_of(*fields[:-1], "altered"))
    proved = manifest(kept, fields, "source", "doc_id", keep=("altered_leaf",))
    return verified(proved, F.col("altered_leaf")).select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


SQL_op12_merkle_manifest = sql.MANIFEST


def op11_rule_bitmask_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.ledger import kept, ledger

    rows = ledger(table(spark, sf_dir, "documents"))
    asked = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(*asked, (~kept(1)).alias("base_failed"), kept().alias("kept"), "failures")


SQL_op11_rule_bitmask_ledger = sql.LEDGER


def op13_jacobi_davidson_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))
