"""A corpus from raw documents to token ids: quality rules, one document of each near-copy class, removal of repeated passages, decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stellate.llm import byte_bpe, near_copies, quality, repeats, winnowing
from stellate.llm.common import scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_documents(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.drop_repeats(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnowing.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_texts(docs, with_ids=True).drop("decoded")


STAGES = [("quality", quality_rules), ("near copies", one_of_each), ("repeats", without_repeats), ("decontamination", decontaminated), ("encoding", encoded)]

#: SQL can't express the merges of the last stage; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
