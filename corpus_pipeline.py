"""Documents through four stages: toxicity, near-duplicates, benchmark passages, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import bpe, decontaminate, neardup, toxicity
from panelspark.llm.registry import table
from panelspark.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle and hundredths of similarity that make near-duplicates here; op4 has its own.
NEAR_WORDS, NEAR_BAR = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below one half. The labels of all documents at hand are learnt from."""
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(COLUMNS), model, out="_score").where("_score < 0.5").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by a similarity of 0.8 in five-word shingles; documents without an id stay.

    An id that comes with several texts is as many documents; a row that repeats id and text goes.
    """
    return neardup.keep_one(docs.select(COLUMNS), NEAR_BAR, NEAR_WORDS)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of the benchmark in their texts."""
    cleaned = decontaminate.remove(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"), changed="_changed")
    chars = F.when(F.col("_changed"), F.length("text")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and whether they decode to its text."""
    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    both = bpe.decode(bpe.encode(docs.select(COLUMNS), vocabulary), vocabulary)
    same = (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    return both.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", same)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("bpe", encode),
]

#: SQL can't express learnt scores and merges; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
