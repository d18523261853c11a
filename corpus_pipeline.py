"""The corpus pipeline: language ID, toxicity, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of ``documents``. A stage learns
from its own input, so none looks back at what an earlier one dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafwright.llm import op01_language, op02_personal, op05_minhash, op09_packing, op10_toxicity
from leafwright.llm.common import settled

#: No stage but the third can be written in SQL; tests hold them against brute force.
ORACLE_SQL = None

#: Near-duplicates of this pipeline: shingles of so many words, linked at so many hundredths.
WORDS, SHARE = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no language's dictionary explains better than the others'."""
    return op01_language.drop_rejected(docs, op01_language.dictionaries(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic, after learning from the labels of those given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return op10_toxicity.drop_toxic(docs, op10_toxicity.learn(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, linked at five-word shingles and similarity 0.8: the one with the smallest id. Rows without an id stay."""
    return op05_minhash.keep_one(docs, WORDS, SHARE)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind."""
    return op02_personal.redact(docs, op02_personal.train(op02_personal.labelled_table(spark)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 2048."""
    return op09_packing.pack(docs)


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("near-duplicates", near_duplicates),
    ("personal-data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
