"""A training-data pipeline over ``documents``: each stage reads what the one before it kept.

Each function of STAGES takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``documents``; the
last adds ``shard`` and ``slot``. ``run`` writes every stage's rows as Parquet in the shared folder and reads them
again. Mixing and sharding have no SQL form (hash draws of a splitting tree, CRC-free key line), so ORACLE_SQL is
None; the tests hold every stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismata.llm import decontaminate, mixing, ngram_join, quality, sharding
from prismata.plans.shared import materialize

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar documents stays, that with the smallest doc_id."""
    return ngram_join.one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one with other numbers or names, go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their target weights."""
    return mixing.mix(docs)


def histogram_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard and its slot there."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", histogram_sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
