"""Column profiles and the encoding they suggest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1024
WIDTHS = {"int": 4, "bigint": 8, "float": 4, "double": 8}


def bit_length(x: Column) -> Column:
    """Bits that a non-negative number takes; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def bit_widths(df: DataFrame, column: str, order: str, chunk: int = CHUNK) -> DataFrame:
    """chunk, bit_width: of all values OR-ed, for each chunk of order; a negative value takes the type's width.

    order numbers the rows from 0; a column of another kind must be numbered first.
    """
    return df.groupBy(F.expr(f"cast(`{order}` div {chunk} as bigint)").alias("chunk")).agg(chunk_width(df, column).alias("bit_width"))


def chunk_width(df: DataFrame, column: str) -> Column:
    wide = F.expr(f"bit_or(cast(`{column}` as bigint))")
    return F.when(F.min(F.col(column).cast("long")) < 0, 8 * WIDTHS[dict(df.dtypes)[column]]).otherwise(bit_length(F.coalesce(wide, F.lit(0)))).cast("int")


def run_counts(df: DataFrame, columns: list[str], order: str, block: int = 1 << 20) -> DataFrame:
    """A row with, for each column, the maximal runs of equal values in the order of a row number (r0, r1, ...).

    Runs are counted within blocks of rows, all columns at once; the ends of the blocks, a row each, show where runs go on.
    """
    names = range(len(columns))
    blocks = df.select(F.expr(f"cast(`{order}` div {block} as bigint)").alias("b"), F.col(order).alias("o"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    w = Window.partitionBy("b").orderBy("o")
    first = F.lag("o").over(w).isNull()
    marked = blocks.select("*", *[(first | ~F.col(f"v{i}").eqNullSafe(F.lag(f"v{i}").over(w))).cast("long").alias(f"new{i}") for i in names])
    ends = F.struct(*[f"v{i}" for i in names])
    per = marked.groupBy("b").agg(F.min_by(ends, "o").alias("head"), F.max_by(ends, "o").alias("tail"), *[F.sum(f"new{i}").alias(f"n{i}") for i in names])
    on = Window.orderBy("b")  # a row a block
    before = F.lag("tail").over(on)
    joined = per.select(*[(F.col(f"n{i}") - F.coalesce(before[f"v{i}"].eqNullSafe(F.col("head")[f"v{i}"]) & F.lag("b").over(on).isNotNull(), F.lit(False)).cast("long")).alias(f"n{i}") for i in names])
    return joined.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"r{i}") for i in names])


def run_count(df: DataFrame, column: str, order: str, block: int = 1 << 20) -> DataFrame:
    return run_counts(df, [column], order, block).select(F.col("r0").alias("run_count"))


def profile(df: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """column_name, num_values, null_count, cardinality, cardinality_ratio, data_size, and with order max_bit_width (integers), run_count, run_ratio; one pass each over all columns."""
    kinds, names = dict(df.dtypes), range(len(columns))
    sums = df.agg(F.count("*").alias("num_values"), *[F.count_if(F.col(c).isNull()).alias(f"null{i}") for i, c in enumerate(columns)], *[F.count_distinct(c).alias(f"card{i}") for i, c in enumerate(columns)])
    if order:
        sums = sums.join(F.broadcast(run_counts(df, columns, order)))  # a row each
        whole = [i for i in names if kinds[columns[i]] in ("int", "bigint")]
        widths = df.groupBy(F.expr(f"cast(`{order}` div {CHUNK} as bigint)").alias("chunk")).agg(F.lit(0).alias("none"), *[chunk_width(df, columns[i]).alias(f"bits{i}") for i in whole])
        sums = sums.join(F.broadcast(widths.agg(F.max("none").alias("none"), *[F.max(f"bits{i}").alias(f"bits{i}") for i in whole])))
    rows = []
    for i, c in enumerate(columns):
        own = [F.lit(c).alias("column_name"), F.col("num_values"), F.col(f"null{i}").alias("null_count"), F.col(f"card{i}").alias("cardinality"), ratio(f"card{i}").alias("cardinality_ratio")]
        own.append((F.col("num_values") * WIDTHS[kinds[c]] if kinds[c] in WIDTHS else F.lit(None)).cast("long").alias("data_size"))
        if order:
            own += [(F.col(f"bits{i}") if i in whole else F.lit(None)).cast("int").alias("max_bit_width"), F.col(f"r{i}").alias("run_count"), ratio(f"r{i}").alias("run_ratio")]
        rows.append(F.struct(*own))
    return sums.select(F.inline(F.array(*rows)))


def profile_approx(df: DataFrame, columns: list[str], rsd: float = 0.05) -> DataFrame:
    """As the first part of profile, all columns in one pass, with sketched cardinalities."""
    sums = df.agg(F.count("*").alias("n"), *[F.struct(F.count_if(F.col(c).isNull()).alias("null_count"), F.approx_count_distinct(c, rsd).alias("cardinality")).alias(f"s{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("num_values"), F.col(f"s{i}.null_count"), F.col(f"s{i}.cardinality")) for i, c in enumerate(columns)])
    return sums.select(F.inline(rows)).withColumn("cardinality_ratio", ratio("cardinality"))


def ratio(name: str) -> Column:
    """Of num_values; 1 where there are none."""
    return F.when(F.col("num_values") > 0, F.col(name) / F.col("num_values")).otherwise(1.0)


def list_profile(df: DataFrame, column: str) -> DataFrame:
    """num_lists, num_values (flattened), null_count, max_length of an array column."""
    return df.agg(F.count("*").alias("num_lists"), F.coalesce(F.sum(F.size(column)), F.lit(0)).cast("long").alias("num_values"), F.count_if(F.col(column).isNull()).alias("null_count"), F.max(F.size(column)).cast("long").alias("max_length"))


def max_length(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(F.length(column)).cast("long").alias("max_length"))


def byte_entropy(df: DataFrame, column: str) -> DataFrame:
    """position, entropy (bits): of each byte of a float or double column's little-endian form, over all values."""
    kind = dict(df.dtypes)[column]
    width = WIDTHS[kind]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width, 256), np.int64)
        for batch in batches:
            raw = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            parts = np.frombuffer(raw.astype(f"<f{width}").tobytes(), np.uint8).reshape(-1, width)
            for i in range(width):
                sums[i] += np.bincount(parts[:, i], minlength=256)
        at = np.argwhere(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1].astype(np.int32)), pa.array(sums[at[:, 0], at[:, 1]])], names=["position", "byte", "n"])

    counts = df.select(column).mapInArrow(count, "position int, byte int, n long").groupBy("position", "byte").agg(F.sum("n").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("position"))  # 256 rows a position
    return counts.select("position", (-p * F.log2(p)).alias("h")).groupBy("position").agg(F.sum("h").alias("entropy"))


def valid(profiles: DataFrame) -> DataFrame:
    """profiles with ok: counts that can be."""
    ok = (F.col("null_count") <= F.col("num_values")) & (F.col("cardinality") <= 2 * F.col("num_values")) & F.coalesce(F.col("data_size") <= 16 * F.col("num_values"), F.lit(True))
    if "run_count" in profiles.columns:
        ok = ok & (F.col("run_count") <= F.col("num_values"))
    return profiles.withColumn("ok", ok)


@dataclass(frozen=True)
class Thresholds:
    """What encodings are chosen by."""

    # The defaults.
    bit_packing_most: int = 16
    rle: float = 0.5
    dictionary: float = 0.5
    dictionary_most: int = 1 << 20
    dictionary_most_middle: float = 1 << 20  # of columns that only the wider threshold calls few-valued
    byte_stream_entropy: float = 4.0
    few_values: int = 100
    early: float = 0.1  # of runs and of distinct values, before bit width counts


def integer_encoding(num_values, run_ratio, cardinality_ratio, max_bit_width, cardinality=None, by: Thresholds = Thresholds()) -> Column:
    """The encoding that suits integers of such a profile."""
    n, runs, card, bits = (x if isinstance(x, Column) else F.col(x) for x in (num_values, run_ratio, cardinality_ratio, max_bit_width))
    count = F.lit(None).cast("long") if cardinality is None else cardinality if isinstance(cardinality, Column) else F.col(cardinality)
    many = F.coalesce(count > F.when(card < by.early, F.lit(by.dictionary_most)).otherwise(F.lit(by.dictionary_most_middle)), F.lit(False))
    chosen = F.when((n < by.few_values) | runs.isNull() | card.isNull(), "zstd").when(runs < by.early, "rle").when(card < by.early, "dictionary").when(bits <= by.bit_packing_most, "bitpacking")
    chosen = chosen.when(card < by.dictionary, "dictionary").when(runs < by.rle, "rle").otherwise("zstd")
    return F.when((chosen == "dictionary") & many, "zstd").otherwise(chosen)


def float_encoding(average_entropy, by: Thresholds = Thresholds()) -> Column:
    e = average_entropy if isinstance(average_entropy, Column) else F.col(average_entropy)
    return F.when(e < by.byte_stream_entropy, "byte_stream_split+zstd").otherwise("zstd")


#: What Parquet does for an advised encoding: dictionaries (whose indexes are run-length and bit-packed), bytes split by place, or neither.
DICTIONARY, SPLIT = ("rle", "dictionary", "bitpacking"), ("byte_stream_split+zstd",)
ENCODINGS = (*DICTIONARY, *SPLIT, "zstd")


def advise(df: DataFrame, columns: list[str], order: str, by: Thresholds = Thresholds()) -> dict[str, str]:
    """The encoding of each integer, float and double column, by its profile; for sources.columnar.write_encoded."""
    kinds = dict(df.dtypes)
    whole = [c for c in columns if kinds[c] in ("int", "bigint")]
    out = {}
    if whole:
        p = profile(df, whole, order)
        out |= {r[0]: r[1] for r in p.select("column_name", integer_encoding("num_values", "run_ratio", "cardinality_ratio", "max_bit_width", "cardinality", by)).collect()}  # a row a column
    for c in columns:
        if kinds[c] in ("float", "double"):
            out[c] = byte_entropy(df, c).agg(F.avg("entropy").alias("e")).select(float_encoding(F.coalesce("e", F.lit(8.0)), by)).first()[0]
    return out
