"""A training-corpus pipeline over ``documents``: language, near-duplicates, repeated passages, test sets, tokens.

Every stage takes and returns a DataFrame; all but the last return the columns of ``documents``. :func:`run` writes each stage's result as Parquet
in the shared folder and reads it again, so a later stage never recomputes an earlier one.

Defined cases: documents without letters (null texts too) go in the first stage; an empty table passes through as an empty table; repeated
rows are copies, of which the second stage keeps one; a null doc_id is kept like any other; extra columns are carried to the last stage but one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartmill.llm import decontamination, language_id, near_copies, sentencepiece_bpe, substring
from chartmill.llm.common import table, written

#: Share of a text's letters that its main language must have.
MIN_LANGUAGE_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents; texts without a letter or without a main language go."""
    return language_id.keep_identified(docs, language_id.learn(docs), MIN_LANGUAGE_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, exact Jaccard similarity of 0.8 and more) the document of the smallest doc_id stays."""
    return near_copies.keep_one_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that occur twice go; a document of which nothing is left goes too."""
    left = substring.cut_repeats(docs)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def drop_test_sets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ``benchmark`` go."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, digests of the ids and of the decoded text."""
    return sentencepiece_bpe.encode_digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("test sets", drop_test_sets),
    ("tokens", encode),
]

#: A language model of n-grams and Viterbi can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
