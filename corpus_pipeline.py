"""A pipeline over a corpus: each stage reads what the one before it wrote, and its decisions hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, pieces, simhash, unitdedup
from tidemark.llm.common import run_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without a letter go, NULL and empty texts among them.

    The model is learned from the given table's labels. Each row is judged by itself, so repeated rows stay or go together.
    """
    model = langid.learn(langid.training_rows(table(spark, sf_dir, "documents")))
    found = langid.identify(docs, model, out="__language")
    return found.where(F.col("__language.lang_pred") != langid.UNKNOWN).select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id, one row of it.

    NULL and wordless texts are one group. Of repeated rows one stays. Rows without an id stay only in groups that have no id.
    """
    return simhash.keep_first(docs, simhash.near_duplicates(docs))


def unit_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and sentences that an earlier one has; ``n_chars`` follows the text. Emptied texts go.

    NULL and empty texts have no unit and stay as they are. Of repeated rows the first by the operator's order keeps its units.
    """
    left = unitdedup.remove_repeated_units(docs, out="__removed")
    kept = left.where((F.size("__removed") == 0) | (F.trim(F.col("text")) != ""))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. NULL and empty texts hold none; repeated rows, and rows under one id, go together."""
    return decontam.remove_leaks(docs, decontam.find_leaks(docs, table(spark, sf_dir, "benchmark")))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, their number, and whether they decode to the text: NULL ids and 0 for a NULL text, none for an empty one; a row for each row."""
    vocabulary = pieces.read_pieces(pieces.MODEL_PATH)
    coded = pieces.with_checked_pieces(docs, vocabulary).select("doc_id", "lang", "source", "n_chars", "coded.*")
    return coded.withColumn("n_pieces", pieces.n_pieces(F.col("ids"))).withColumnRenamed("same", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("unit_dedup", unit_dedup),
    ("decontaminate", decontaminate),
    ("encode_pieces", encode_pieces),
]

# Language models, shingle hashes and best paths have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    folder = run_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        place = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
