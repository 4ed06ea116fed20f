"""A corpus pipeline of five stages, each one operator of ``glyphmill.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written and read again before the next.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import decontaminate, jaccard, mixing, quality, sharding
from glyphmill.llm.common import persisted


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels of the table, does not reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept(docs, model)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (word 5-grams, Jaccard 0.8) one row of the document with the least id."""
    return jaccard.one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of the benchmark."""
    return decontaminate.without_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them: every source once, rare ones up to twice."""
    return mixing.mixed(docs, max_repeats=2.0, marks=False)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with their shard."""
    return sharding.shards(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: No SQL: boosting, bisection and MinHash candidates are not expressible; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = persisted(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
