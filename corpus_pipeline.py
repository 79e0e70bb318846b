"""A corpus pipeline of training-data operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of
``documents``; it is written as Parquet and read again as the next stage's docs. The last stage
returns the shard of every document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm.decontaminate import without_contaminated
from fieldspark.llm.jaccard import one_of_each
from fieldspark.llm.mixing import mixture
from fieldspark.llm.scratch import shared_folder
from fieldspark.llm.sharding import sharded
from fieldspark.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of linked documents: shingles of five
    words, similarity 0.8."""
    return one_of_each(docs, width=5, num=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixture(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and the slot of every document of the mix."""
    return sharded(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Learned scores and graph components are beyond SQL; the operators' tests compare their rows with
#: brute force or held-out labels, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
