"""Registered queries of the training-data operators: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, lattice, media, near_join, oracles, packing, quality, secrets, sharding, suffix_dedup, token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty byte-balanced shards of all documents."""
    return sharding.shard_documents(_documents(spark, sf_dir), shards=40)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens at most."""
    packed = packing.pack_documents(_documents(spark, sf_dir))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated strings of 200 bytes."""
    cut = suffix_dedup.remove_repeats(_documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded to pieces and decoded again."""
    encoded = lattice.encode_documents(_documents(spark, sf_dir))
    decoded = encoded.select("doc_id", "ids", lattice.decode_ids(F.col("ids")).alias("text"))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.octet_length("text").cast("long").alias("decoded_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as images, read back and hashed."""
    kept = media.media_columns(_documents(spark, sf_dir))
    return kept.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("hash")).alias("feature"),
    )


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and Markov spans of secrets in all documents."""
    found = secrets.scan_secrets(_documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and adaptive verdict of all documents."""
    judged = quality.quality_rules(_documents(spark, sf_dir))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents under the unigram model."""
    return token_counts.token_counts(_documents(spark, sf_dir))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of Jaccard similarity 0.8 or more between all documents on five-word runs."""
    return near_join.near_duplicates(_documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    return language.identify_language(_documents(spark, sf_dir))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_sentencepiece_lattice": op4_sentencepiece_lattice,
    "op5_media_columns": op5_media_columns,
    "op6_secret_scans": op6_secret_scans,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_counts": op8_token_counts,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_language_id": op10_language_id,
}

#: The others take models, tokenizers, codecs or searches that SQL has not; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_suffix_dedup": oracles.OP3,
    "op7_quality_rules": oracles.OP7,
    "op9_ngram_jaccard_join": oracles.OP9,
}
