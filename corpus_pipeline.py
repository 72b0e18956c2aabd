"""A training corpus in five stages, each one operator of ``loomgraph.llm``.

Every stage takes what the one before has kept, and all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontaminate, mixing, near_dedup, quality, token_records
from loomgraph.llm.queries import encoding
from loomgraph.llm.tables import new_folder, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the stage's own input."""
    return quality.accepted(docs, quality.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The written token records, read back: a row for each."""
    return token_records.digest(token_records.written(docs, encoding()))


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicates", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources", mix_sources),
    ("token records", write_tokens),
]

#: Tokenizer, signatures and fitted scorer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        folder = new_folder(spark, "corpus")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
