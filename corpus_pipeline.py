"""From raw documents to packed training sequences: language, toxicity, exact and near copies, packing.

Each stage gets a DataFrame with the columns of `documents`, works on all of it and returns the documents that it
keeps; the last returns the pieces of packed sequences. Between stages the documents are written as Parquet to the
folder that spark.checkpoint.dir names, so that a lost executor costs the running stage only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurespark.llm import exact, language, near, packing, toxicity
from featurespark.llm.common import held_out, read_table, work_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those for which no language reaches the least score."""
    return language.keep_known(docs, ~held_out(F.col("doc_id"), 3, 1))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labels that are not held out, calls toxic."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of equal texts, white space aside."""
    return exact.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each component with similarity 0.8 or more over shingles of five words."""
    return near.drop_near_copies(docs, percent=80, width=5)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1,024 tokens."""
    pieces = packing.pack(docs, TOKENIZER)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("exact_copies", without_copies),
    ("near_copies", without_near_copies),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Two stages are learned models and one is a tokenizer: SQL can't express them.
ORACLE_SQL = None
