"""Cleaning a text corpus in stages: each keeps, cuts or encodes all that the one before it kept.

Columns of ``documents`` stay as they are, whatever further ones there are, but for text and n_chars, which
follow what is cut; the last stage returns what becomes of each document as tokens. In all stages empty tables
give empty tables, texts are read whole however long they are, and further columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholium.llm import bpe, fm_index, language_id, recompression, simhash
from scholium.llm.common import materialize, read, ship, stored, sweep
from scholium.llm.queries import tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with the calibrated confidence.

    Null texts and texts without a letter go; a row with a null id or language is judged like any other, and rows
    that repeat stay or go together. A tie of two languages is no ground for rejection by itself.
    """
    ship(spark)
    return language_id.keep_identified(docs, language_id.fit(docs))


#: Documents are near duplicates where their sets of five-word shingles have this Jaccard similarity or more.
NEAR_LEAST = 0.8


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group, over five-word shingles.

    Empty and null texts are copies of each other. Rows that share an id are one document: all of them stay or go.
    Rows with a null id stay only where no row of their group has an id.
    """
    ship(spark)
    return simhash.drop_near_duplicates(docs, words_per_shingle=5, least=NEAR_LEAST)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words or more that occur earlier; texts that are nothing else go.

    Null and empty texts stay. Rows that share an id count as one place, a null id as the smallest, so copies of one
    row under one id keep their words.
    """
    ship(spark)
    return recompression.remove_repeats(docs, length_col="n_chars")


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the benchmark's passages. Every row stays, repeated ones and those with null ids or texts too; an empty benchmark changes nothing."""
    return fm_index.decontaminate(docs, read(spark, sf_dir, "benchmark"), length_col="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of what they decode to; one row for each row, a null text counts as empty."""
    ship(spark)
    return bpe.encode_decode_digests(docs, tokenizer("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("identify_language", identify_language),
    ("drop_near_duplicates", drop_near_duplicates),
    ("remove_repeated_passages", remove_repeated_passages),
    ("remove_benchmark", remove_benchmark),
    ("encode", encode),
]

#: Several stages can't be expressed in SQL; tests/llm/test_pipeline.py compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage has stored is removed once the next one's result is."""
    docs, kept = read(spark, sf_dir, "documents"), stored()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        sweep(spark, [path for path in stored()[:-1] if path not in kept])
    return STAGES[-1][1](spark, docs, sf_dir)
