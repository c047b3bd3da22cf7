"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stellate.llm import byte_bpe, lengths, near_copies, perspectives, quality, repeats, sstable, toxicity, urls, winnowing
from stellate.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_sorted_string_tables": lambda spark, d: sstable.encode_to_shards(table(spark, d, "documents")),
    "op2_url_rules": lambda spark, d: urls.judge_urls(table(spark, d, "pages"), urls.rules_table(spark)),
    "op3_perspectives": lambda spark, d: perspectives.rotate(table(spark, d, "conversations")),
    "op4_toxicity": lambda spark, d: toxicity.score(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_near_copies": lambda spark, d: near_copies.near_copies(table(spark, d, "documents")),
    "op6_contamination": lambda spark, d: winnowing.contamination(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("items"),
    "op7_byte_bpe": lambda spark, d: byte_bpe.encode_texts(table(spark, d, "documents")),
    "op8_token_counts": lambda spark, d: lengths.with_suffix_sums(lengths.histogram(table(spark, d, "documents"))),
    "op9_repeats": lambda spark, d: repeats.find_repeats(table(spark, d, "documents")),
    "op10_quality": lambda spark, d: quality.judge(table(spark, d, "documents")),
}

ORACLES: dict[str, str] = {"op2_url_rules": urls.ORACLE, "op3_perspectives": perspectives.ORACLE, "op6_contamination": winnowing.ORACLE}
