"""The cleaning pipeline: quality, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept;
``run`` writes every stage's rows as Parquet in the shared checkpoint folder and reads
them again for the next.  There is no SQL twin: the classifiers are learned.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusgap.functions.runtime import share_package
from corpusgap.llm import packing, stages
from corpusgap.llm.queries import vocabulary
from corpusgap.llm.session import shared_folder, table

CAPACITY = 2048


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.drop_toxic(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_package(spark)
    return stages.one_per_group(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_package(spark)
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), CAPACITY).drop("copy")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all filters keep."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
