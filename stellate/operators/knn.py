"""Exact nearest neighbours.

One query is an ORDER BY with a limit, which Spark runs as a top-k of each partition. A set of queries is
gathered while it is at most QUERIES_MOST and each task ranks its part of the corpus against all of them in
numpy, keeping the best k rows of each query from batch to batch, so k rows a query and task go on to a second
top-k by a window; a larger set goes in blocks. Products of matrices only choose candidates, by a bound of their
rounding error; what is ranked are distances summed row by row. Rows and queries without a vector are left out.
Ties are ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stellate.functions.filters import compile_filter
from stellate.functions.vectors import METRICS, Metric, distance

#: Queries that go to the tasks at once.
QUERIES_MOST = 4_096
#: Over-fetch of filtered search: the last of the batches 2k, 4k, ... that stays below the limit.
OVERFETCH = 16
#: Products in a matrix, about, of queries and rows.
CELLS = 1 << 18


def _checked(k: int) -> None:
    if k < 0:
        raise ValueError("k must not be negative")


def search(corpus: DataFrame, vector: list[float], k: int, metric: Metric = "l2", id_col: str = "id", vector_col: str = "vector", where=None, json: str | None = None) -> DataFrame:
    """The k rows of corpus nearest to a vector, with distance and rank; where: a condition that rows must meet first."""
    _checked(k)
    query = F.array(*[F.lit(float(x)) for x in vector])
    rows = corpus if where is None else corpus.where(compile_filter(where, corpus.schema, json))
    rows = rows.where(F.col(vector_col).isNotNull())
    best = rows.withColumn("distance", distance(metric, F.col(vector_col), query)).orderBy("distance", id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)))  # k rows


def search_post_filtered(corpus: DataFrame, vector: list[float], k: int, where, metric: Metric = "l2", id_col: str = "id", vector_col: str = "vector", json: str | None = None, overfetch: int = OVERFETCH) -> DataFrame:
    """Ranks first: of the overfetch * k nearest rows those that meet the condition, k at most."""
    best = search(corpus, vector, overfetch * k, metric, id_col, vector_col)
    kept = best.where(compile_filter(where, corpus.schema, json)).withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)))
    return kept.where(F.col("rank") <= k)


def distances(name: str, queries: np.ndarray, rows: np.ndarray, squares: np.ndarray | None = None) -> np.ndarray:
    """Distance of each query (a line) and row (a column). squares: of the rows, if known."""
    inner = queries @ rows.T
    if name == "inner_product":
        return -inner
    q, r = (queries**2).sum(axis=1)[:, None], ((rows**2).sum(axis=1) if squares is None else squares)[None, :]
    if name == "cosine":
        norms = np.sqrt(q) * np.sqrt(r)
        return np.where(norms == 0, 1.0, 1.0 - inner / np.where(norms == 0, 1, norms))
    squared = np.maximum(q + r - 2 * inner, 0)
    return squared if name == "l2" else np.sqrt(squared)


def exact_distances(name: str, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """As distances, summed row by row: without cancellation, and the same for equal rows."""
    if name in ("l2", "l2_sqrt"):
        squared = ((rows - query) ** 2).sum(axis=1)
        return squared if name == "l2" else np.sqrt(squared)
    inner = (rows * query).sum(axis=1)
    if name == "inner_product":
        return -inner
    norms = np.sqrt((rows**2).sum(axis=1)) * np.sqrt((query**2).sum())
    return np.where(norms == 0, 1.0, 1.0 - inner / np.where(norms == 0, 1, norms))


def rounding(name: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each query, how far a distance by distances may be from the true one, at any of the rows."""
    eps = 4 * (queries.shape[1] + 4) * np.finfo(np.float64).eps
    q, r = np.sqrt((queries**2).sum(axis=1)), np.sqrt((rows**2).sum(axis=1).max(initial=0))
    if name == "cosine":
        return np.full(len(q), eps)
    return eps * (q * r if name == "inner_product" else (q + r) ** 2)


def nearest(name: str, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the places and distances of its k nearest rows, ties by id. Queries go in parts whose products stay in the cache."""
    squared = "l2" if name == "l2_sqrt" else name  # the root keeps the order, but not the bound
    asked, known, slack = queries, rows, 0.0
    if squared == "l2" and len(rows):  # what vectors have in common would only add to the rounding error
        centre = rows.mean(axis=0)
        asked, known = queries - centre, rows - centre
        off = 4 * np.finfo(np.float64).eps * (np.abs(queries).max(initial=0) + np.abs(rows).max(initial=0)) * np.sqrt(queries.shape[1])  # of the differences
        reach = np.sqrt((asked**2).sum(axis=1)) + np.sqrt((known**2).sum(axis=1).max())
        slack = 2 * reach * off + off**2
    slack = 2 * (rounding(squared, asked, known) + slack)
    step, squares = max(1, CELLS // max(1, len(rows))), (known**2).sum(axis=1)
    for lo in range(0, len(queries), step):
        all_ = distances(squared, asked[lo : lo + step], known, squares)
        bounds = np.partition(all_, k - 1, axis=1)[:, k - 1] if k < len(rows) else np.full(len(all_), np.inf)
        for i, d in enumerate(all_, lo):
            near = np.flatnonzero(d <= bounds[i - lo] + slack[i]) if k < len(rows) else np.arange(len(d))
            exact = exact_distances(name, queries[i], rows[near])
            order = np.lexsort((ids[near], exact))[:k]
            yield i, near[order], exact[order]


def top_k(scored: DataFrame, k: int, query_col: str, id_col: str) -> DataFrame:
    w = Window.partitionBy(query_col).orderBy("distance", id_col)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def blocks(asked: DataFrame) -> Iterator[list]:
    """The rows of asked, QUERIES_MOST at a time."""
    rows = iter(asked.toLocalIterator())
    while block := list(islice(rows, QUERIES_MOST)):
        yield block


def search_batch(corpus: DataFrame, queries: DataFrame, k: int, metric: Metric = "l2", id_col: str = "id", vector_col: str = "vector", query_col: str = "query_id", query_vector_col: str = "vector", where=None, json: str | None = None) -> DataFrame:
    """query_col, id_col, distance and rank of the k nearest rows of every query."""
    _checked(k)
    spark = corpus.sparkSession
    rows = corpus if where is None else corpus.where(compile_filter(where, corpus.schema, json))
    rows = rows.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("__v")).where("__v is not null")
    types = dict(corpus.dtypes)[id_col], dict(queries.dtypes)[query_col]
    kinds = [to_arrow_type(t) for t in (corpus.schema[id_col].dataType, queries.schema[query_col].dataType)]
    schema = f"`{query_col}` {types[1]}, `{id_col}` {types[0]}, distance double"
    asked = queries.select(query_col, F.col(query_vector_col).cast("array<double>").alias("__q")).where("__q is not null")
    if not isinstance(metric, str):
        # any expression: corpus parts against broadcast blocks of queries of bounded size
        def scored(block: list) -> DataFrame:
            pairs = rows.join(F.broadcast(spark.createDataFrame(block, asked.schema)), F.lit(True))
            return pairs.select(query_col, id_col, distance(metric, F.col("__v"), F.col("__q")).alias("distance"))

        return top_k(reduce(DataFrame.unionByName, [scored(block) for block in blocks(asked)] or [scored([])]), k, query_col, id_col)
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")

    def ranked(block: list) -> DataFrame:
        names, matrix = [r[0] for r in block], np.array([r[1] for r in block], np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [(np.empty(0, object), np.empty(0)) for _ in names]  # ids and distances of each query so far
            for batch in batches:
                if not batch.num_rows or not k:
                    continue
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                if len(flat) != batch.num_rows * matrix.shape[1]:
                    raise ValueError("vectors differ in dimension")
                ids = np.array(batch.column(0).to_pylist(), object)
                for i, at, d in nearest(metric, matrix, ids, flat.reshape(batch.num_rows, -1), k):
                    known, far = best[i]
                    if len(far) == k and d[0] > far[-1]:
                        continue
                    known, far = np.concatenate([known, ids[at]]), np.concatenate([far, d])
                    order = np.lexsort((known, far))[:k]
                    best[i] = known[order], far[order]
            sizes = [len(d) for _, d in best]
            if sum(sizes):
                asked_by = pa.array(np.repeat(np.arange(len(names)), sizes))
                found = pa.array(np.concatenate([i for i, _ in best]).tolist(), kinds[0])
                yield pa.RecordBatch.from_arrays([pa.array(names, kinds[1]).take(asked_by), found, pa.array(np.concatenate([d for _, d in best]))], names=[query_col, id_col, "distance"])

        return rows.mapInArrow(run, schema)

    parts = [ranked(block) for block in blocks(asked)]
    if not parts:
        return spark.createDataFrame([], schema + ", rank int")
    return top_k(reduce(DataFrame.unionByName, parts), k, query_col, id_col)


def recall(found: DataFrame, truth: DataFrame, query_col: str = "query_id", id_col: str = "id") -> DataFrame:
    """recall: share of truth that is found, over each query of truth, averaged; 0 for none."""
    hit = truth.select(query_col, id_col).join(found.select(query_col, id_col, F.lit(1.0).alias("hit")).distinct(), [query_col, id_col], "left")
    per = hit.groupBy(query_col).agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("r"))
    return per.agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("recall"))


def latency_percentiles(seconds: list[float]) -> dict[str, float]:
    s = sorted(seconds)
    return {f"p{p}": s[min(len(s) - 1, len(s) * p // 100)] for p in (50, 95, 99)} if s else {}
