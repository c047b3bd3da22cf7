"""Columnar files: checked appends, scans and lookups by row key, and files with an encoding for each column."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellate.errors import InvalidDocumentError
from stellate.operators.profile import DICTIONARY, ENCODINGS, SPLIT
from stellate.sources.storage import Files


def same_schema(a: T.StructType, b: T.StructType) -> bool:
    """Equal names and types in order."""
    return [(f.name, f.dataType) for f in a] == [(f.name, f.dataType) for f in b]


class ColumnarWriter:
    """Appends batches of one schema; keyed: a column that gets Bloom filters, for lookups."""

    def __init__(self, path: str, schema: T.StructType, keyed: str | None = None, **options: str):
        self.path, self.schema = path, schema
        self.options = {"compression": "zstd"} | options
        if keyed:
            self.options |= {f"parquet.bloom.filter.enabled#{keyed}": "true"}

    def write(self, batch: DataFrame) -> None:
        if not same_schema(batch.schema, self.schema):
            raise InvalidDocumentError("write", "the batch has another schema")
        batch.write.mode("append").options(**self.options).parquet(self.path)


def read_columns(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Only the named columns leave the files; page checksums are verified where the files have them."""
    df = spark.read.option("parquet.page.verify-checksum.enabled", "true").parquet(path)
    return df.select(*columns) if columns else df


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def row_index_stats(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("entries"), F.count_distinct(key).alias("keys"))


def table_of(batches: list[DataFrame]) -> DataFrame:
    """Batches of equal schema as one table."""
    out = batches[0]
    for b in batches[1:]:
        if not same_schema(b.schema, out.schema):
            raise InvalidDocumentError("append", "the batch has another schema")
        out = out.union(b)
    return out


def read_encoded(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """What write_encoded wrote, with columns of any encoding (Spark's own reader doesn't know split bytes); a task a file, a row group at a time, only the named columns."""
    path = path.rstrip("/")
    schema = spark.read.parquet(path).schema
    schema = T.StructType([schema[c] for c in columns]) if columns else schema
    names = [c.name for c in schema]
    files = [(f"{path}/{n}",) for n in Files(spark).names(path) if n.endswith(".parquet")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(name if "://" in name else f"file://{name}")
                with system.open_input_file(at) as f:
                    yield from pq.ParquetFile(f, page_checksum_verification=True).iter_batches(batch_size=8_192, columns=names)

    return spark.createDataFrame(files, "file string").repartition(max(1, len(files)), "file").mapInArrow(read, schema)


def write_encoded(df: DataFrame, path: str, encodings: dict[str, str], rows: int = 1 << 20) -> list[str]:
    """Writes df as Parquet with the advised encoding of each column (others: zstd alone); returns the names of the files, one a task.

    Tasks write under names of their attempt in a folder of their own; only files of attempts that ended well are moved
    to path, so lost executors and repeated attempts leave nothing there. rows: of a row group.
    """
    wrong = [e for e in encodings.values() if e not in ENCODINGS]
    if wrong or not set(encodings) <= set(df.columns):
        raise InvalidDocumentError("write", f"unknown encodings or columns: {wrong or sorted(set(encodings) - set(df.columns))}")
    files, work = Files(df.sparkSession), f"{path.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    dictionary, split = [c for c, e in encodings.items() if e in DICTIONARY], [c for c, e in encodings.items() if e in SPLIT]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyarrow import parquet as pq
        from pyspark import TaskContext

        context, writer, held, n = TaskContext.get(), None, [], 0
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.parquet"
        for batch in batches:
            if writer is None:
                system, at = fs.FileSystem.from_uri(f"{work}/{name}" if "://" in work else f"file://{work}/{name}")
                system.create_dir(at.rpartition("/")[0], recursive=True)
                writer = pq.ParquetWriter(system.open_output_stream(at), batch.schema, compression="zstd", use_dictionary=dictionary or False, use_byte_stream_split=split or False, write_page_checksum=True)
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                writer.write_table(pa.Table.from_batches(held))
                held, n = [], 0
        if writer is not None:
            if n:
                writer.write_table(pa.Table.from_batches(held))
            writer.close()
            writer.file_handle and writer.file_handle.close()
            yield pa.RecordBatch.from_pydict({"name": [name]})

    names = sorted(r["name"] for r in df.mapInArrow(write, "name string").collect())  # a row a file
    for name in names:
        files.move(f"{work}/{name}", f"{path.rstrip('/')}/{name}")
    files.delete(work)
    return names
