"""Exact histogram of encoded lengths, with suffix sums that answer every context limit.

Documents are counted by their number of tokens; from the counts of lengths L or more follow, for any
limit, the documents that fit, quantiles, and the tokens left when texts are cut at the limit. Sums over
lengths are taken in two levels (bins of BIN lengths, then within a bin), so no task gathers all lengths.

Defined cases: a null text has no tokens, as an empty one; repeated rows count each time; an empty table
gives an empty histogram; columns other than the text are ignored.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stellate.llm.common import bounded_batches, checkpointed, vocabulary

BIN = 256


def histogram(docs: DataFrame, vocabulary_file: str = "byte_bpe_50k.tiktoken", text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs: each length that occurs."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        with open(vocabulary(vocabulary_file), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        counts: Counter = Counter()
        for batch in batches:
            counts.update(len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(0).to_pylist())
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["n_tokens", "n_docs"])

    return docs.select(F.col(text_col).alias("t")).mapInArrow(count, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def with_suffix_sums(hist: DataFrame) -> DataFrame:
    """Adds, for the limit n_tokens: docs_at_least, tokens_at_least, docs_fit, share_fit (documents of n_tokens or fewer), tokens_truncated (of all, cut at the limit), tokens_total."""
    hist = checkpointed(hist)  # a row a length, used twice
    own = hist.withColumn("bin", F.expr(f"n_tokens div {BIN}")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    bins = own.groupBy("bin").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each BIN lengths
    bins = bins.select("bin", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in "dt"], F.sum("d").over(Window.partitionBy()).alias("d_all"), F.sum("t").over(Window.partitionBy()).alias("t_all"))
    within = Window.partitionBy("bin").orderBy(F.desc("n_tokens"))
    out = own.join(bins, "bin").withColumns({"docs_at_least": F.sum("n_docs").over(within) + F.col("d_after"), "tokens_at_least": F.sum("tokens").over(within) + F.col("t_after")})
    fit = F.col("d_all") - F.col("docs_at_least") + F.col("n_docs")
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", fit.alias("docs_fit"), (fit / F.col("d_all")).alias("share_fit"),
        (F.col("t_all") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("tokens_truncated"), F.col("t_all").alias("tokens_total"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """n_limit, docs_fit, tokens_truncated for any limits, from the sums of the next length above; one pass, a row a limit."""
    above = [F.min_by(F.struct("docs_at_least", "tokens_at_least"), F.when(F.col("n_tokens") > x, F.col("n_tokens"))) for x in limits]
    one = sums.agg(F.coalesce(F.max("tokens_total"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), *[x.alias(f"above{i}") for i, x in enumerate(above)])
    rows = []
    for i, x in enumerate(limits):
        more = F.coalesce(F.col(f"above{i}.docs_at_least"), F.lit(0))
        cut = F.col("tokens") - F.coalesce(F.col(f"above{i}.tokens_at_least"), F.lit(0)) + F.lit(x).cast("long") * more
        rows.append(F.struct(F.lit(x).cast("long").alias("n_limit"), (F.col("docs") - more).alias("docs_fit"), cut.alias("tokens_truncated")))
    return one.select(F.inline(F.array(*rows)))


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that a share q of the documents doesn't exceed."""
    return sums.where(F.col("share_fit") >= q).agg(F.min("n_tokens")).first()[0]
