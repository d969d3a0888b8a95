"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept. All but the last return the
columns of ``documents``. ``run`` writes every stage's rows to the shared folder before the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataledger.llm.decontamination import without_contaminated
from strataledger.llm.jaccard_join import one_of_each
from strataledger.llm.mixing import mix_copies
from strataledger.llm.queries import vocabulary
from strataledger.llm.storage import written
from strataledger.llm.subword_classifier import of_quality
from strataledger.llm.token_files import token_index


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return of_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles of similarity 0.8 or more link."""
    return one_of_each(docs, size=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights; a document stands as often as the mix takes it."""
    return mix_copies(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The written token ids of every document, as read back.

    Workers live on between stages, so this one remembers fewer chunks than the operator does by itself.
    """
    return token_index(docs, vocabulary("byte_bpe_50k.json"), cache_size=400_000)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: SQL can express neither the classifier nor the vocabulary; tests hold the rows of a small run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
