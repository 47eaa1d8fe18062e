"""The corpus pipeline: documents to a mix, each stage one training-data operator.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of documents:

* language ID drops documents whose language is not found;
* line dedup removes boilerplate lines of any length, and documents they leave
  empty;
* SimHash near-dedup keeps one document of each group of near copies
  (five-word shingles, similarity 0.8 or more);
* benchmark decontamination drops documents that hold a benchmark item;
* mixing says how often each remaining document is taken, and by which shards.

Stages meet null texts, ids and sources, repeated rows, empty tables and extra
columns as their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canopyframe.llm import decontaminate, language_id, line_dedup, mixing, simhash
from canopyframe.llm._shared import materialize, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.digest(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: A trained classifier, sampled fingerprint bits and edit distances are beyond SQL;
#: tests hold every stage against the known outcome on a small fixture with planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written once and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
