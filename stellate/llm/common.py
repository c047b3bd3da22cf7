"""What the training-data operators share: the shared folder, table reading and Arrow batch bounds."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, BATCH_BYTES, READ_ROWS = 512, 4 << 20, 1_024
ROW_GROUP_BYTES = 16 << 20
#: Keys of 16 bytes that are broadcast at most.
KEYS_BROADCAST = 500_000


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a local one is set only if that is unset and there are no other machines."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "stellate-shared")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Paths that scratch gave out.
GIVEN: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    GIVEN.append(f"{shared_root(spark)}/stellate-{label}-{uuid.uuid4().hex}")
    return GIVEN[-1]


def write_scratch(df: DataFrame, path: str) -> None:
    """Writes df as Parquet in small row groups, which a task holds in memory until they are full."""
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.enable.dictionary", "false").parquet(path)


def discard_scratch(spark: SparkSession) -> int:
    """Deletes what operators have written under scratch paths; for when their results are no longer read. Returns how many there were."""
    paths, GIVEN[:] = list(GIVEN), []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder; later reads don't depend on any executor."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches hold BATCH_ROWS rows and BATCH_BYTES at most, and readers of files READ_ROWS rows, so that tasks over long texts need little memory."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize": READ_ROWS}
    for key, most in bounds.items():
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def per_worker(key: tuple, make: Callable):
    """make(), once for each Python worker: kept from task to task where workers are used again."""
    kept = sys.modules.setdefault("_stellate_worker", types.ModuleType("_stellate_worker")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text_col: str) -> Column:
    """128 bits that tell a text: a struct of two hashes."""
    return F.struct(F.xxhash64(F.col(text_col)).alias("a"), F.xxhash64(F.lit(1), F.col(text_col)).alias("b"))


def of_other_texts(docs: DataFrame, keys: DataFrame, key: Column, broadcast_most: int = KEYS_BROADCAST) -> DataFrame:
    """The rows of docs whose key isn't among keys (a column key); few keys are broadcast, many joined by shuffle."""
    name = "key"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    found = few(keys.select(F.col("key").alias(name)).distinct(), broadcast_most)
    return docs.join(found, key == found[name], "left_anti")


def few(df: DataFrame, most: int = KEYS_BROADCAST) -> DataFrame:
    """df, of narrow rows, to be broadcast in a join if it has few rows; else it is joined by shuffle."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= most else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; looked up where it is used, so on each executor."""
    import public_tokenizers

    return public_tokenizers.path(name)
