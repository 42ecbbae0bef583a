"""A training corpus out of ``documents``: rules, classifier, near-duplicates, decontamination, packing.

Each stage takes all rows that the stage before it kept, and returns those that it keeps with the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lagwright.llm import decontaminate, packing, quality_classifier, quality_rules, simhash
from lagwright.llm.common import discard, read, written


def in_small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1000 rows from here on: texts are long, and a task holds a batch on both sides of its Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return quality_rules.keep_regular(docs, read(spark, sf_dir, "labels"))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on what the rules kept, so on the cases that are left to decide."""
    in_small_batches(spark)
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, read(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return simhash.one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), chunk_bytes=1 << 20, kept_words=150_000)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Forest, dictionaries and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table goes once the next one is written; the last is read by the result."""
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
