"""A corpus pipeline in five stages: language, near duplicates, repeated passages, secrets, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written
as Parquet and read again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.llm import language, near_join, packing, secrets, suffix_dedup
from molframe.llm._runtime import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame, text="text") -> DataFrame:
    """The columns of documents, with the length that the text has now."""
    text = F.col(text)
    return docs.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told, and puts the language that the text has in place of the label.

    Rejected are null and empty texts and those without letters. Where no document has a label nothing can be learned: all
    texts with letters stay then, as they are.
    """
    model = language.fit_language_model(docs)
    if not model.languages:
        return _documents(docs.where(F.col("text").rlike(r"\p{L}")))
    told = docs.withColumn("_told", language.predict_column(model, F.col("text")))
    return _documents(told.where(F.col("_told.lang_pred") != language.UNDETERMINED).withColumn("lang", F.col("_told.lang_pred")))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the smallest id, once."""
    return _documents(near_join.one_of_each_group(docs))


def stage_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated strings of 200 bytes; a document of which nothing is left goes.

    A cut inside a character takes the whole character, and nothing else that the text had.
    """
    cut = suffix_dedup.remove_repeats(docs, keep=("lang", "source"), whole_characters=True)
    return _documents(cut.where("octet_length(kept) > 0").withColumn("text", F.col("kept").cast("string")))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by its kind."""
    model = secrets.default_model(docs)
    found = docs.withColumn("_spans", secrets.secret_spans(F.coalesce(F.col("text"), F.lit("")), model))
    return _documents(found.withColumn("text", secrets.redact(F.col("text"), F.col("_spans"))))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2048 tokens at most."""
    packed = packing.pack_documents(docs)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", stage_language),
    ("ngram_jaccard_join", stage_near_duplicates),
    ("suffix_array_dedup", stage_repeats),
    ("secret_scans", stage_secrets),
    ("best_fit_packing", stage_packing),
]

#: SQL expresses none of the five (models, signatures, packing); tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of ``sf_dir``; what one hands to the next is a table in the shared folder.

    The tables are deleted when the last stage is through: what it returns lies in its own checkpoints.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.keep(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)
