"""The corpus pipeline: documents through operators of lumenfold.llm, each stage on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import bpe, decontaminate, language, near_dedup, toxicity
from lumenfold.llm.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from those with a label, doesn't reject."""
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


#: The languages that the corpus is made for; documents in others go.
LANGUAGES = ("de", "en", "es", "fr")


def in_its_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are found to be in one of LANGUAGES with a posterior of a half or more; those without a letter go."""
    return language.in_languages(docs, language.train(docs), LANGUAGES)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return near_dedup.one_of_each(docs, words=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark (four fifths of its five-word shingles or more)."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the token ids and the text decoded from them."""
    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", not_toxic),
    ("language_id", in_its_languages),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

#: Learned scores and byte-pair encoding are no SQL; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage reads what the one before it has written."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        kept = scratch.table(stage(spark, docs, sf_dir))
        if i:
            scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
