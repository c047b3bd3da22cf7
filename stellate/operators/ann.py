"""Approximate nearest neighbours: a layered proximity graph in each shard of a collection.

Vectors are dealt to shards by a hash of their id; each shard builds its graph by itself, and a query
descends all graphs, the best k of all shards being the answer. There are as many shards as keep each at
SHARD_NODES nodes, about; a collection that needs few is dealt to SHARDS_SOON, down to SHARD_LEAST nodes each, as
a shard is built in one task. The index is two tables: graphs (a row a node: shard, node_id, id, vector, level and
links by layer) and a row of parameters a shard, with the metric, so that a loaded index ranks as it was built
to; nodes and edges are views of the graphs. Vectors are added to the graphs that are there (add), which keep
their nodes and change links only.

A search may be told which nodes are alive. Dead ones are passed through, not answered: the search widens until
it has k that are alive, and where a graph has no more to give, the rest is ranked exactly. A search as broad as
a graph has nodes ranks them by matrix products instead of visiting them; if it is as broad as every graph, the
nodes that are alive are ranked where they lie, without their links. Queries go in blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellate.operators.knn import blocks, exact_distances, nearest, search_batch, top_k

LEVEL_MOST = 16
GRAPHS = "shard int, node_id int, id {id}, vector array<float>, level int, links array<struct<layer:int,neighbors:array<int>>>, entry boolean"
FIXED = "m int, ef_construction int, dimension int, metric string, shards int, seed int"
#: Admission to a full candidate set is a little wider than its worst member: by a hundredth of its absolute value (distances may be negative here), and a bit.
WIDEN, WIDEN_BY = 0.01, 1e-5
#: Nodes of a shard, about; shards at least; shards as soon as each has SHARD_LEAST nodes.
SHARD_NODES, SHARDS_LEAST, SHARDS_SOON, SHARD_LEAST = 25_000, 4, 16, 5_000
#: Numbers in a matrix, about, while graphs are built or scanned.
CELLS = 1 << 22


# The thresholds of both parameter rules and of the search breadth.


def adaptive_parameters(dimension: int, expected: int) -> tuple[int, int]:
    """m and ef_construction by dimension and expected number of vectors."""
    m = 16 if dimension <= 128 else 24 if dimension <= 512 else 32 if dimension <= 1024 else 48
    ef = 200
    if expected > 10_000:
        ef = int(200 + 200 * math.log10(expected / 10_000))
    if expected > 50_000:
        ef = int(ef * 1.3)
    if dimension > 512:
        ef = int(ef * 1.5)
    return min(m, 64), min(ef, 800)


def alternate_parameters(dimension: int, expected: int) -> tuple[int, int]:
    """As adaptive_parameters, with a slower growth by size."""
    m = adaptive_parameters(dimension, expected)[0]
    ef = 200
    if expected > 10_000:
        ef = int(200 + 100 * math.log10(expected / 10_000))
    if dimension > 512:
        ef = int(ef * 1.5)
    return m, min(ef, 800)


def default_ef(k: int) -> int:
    return max(200, 2 * k)


def query_ef(k: int, n: int) -> int:
    """Search breadth that grows with the collection."""
    return min(1000, max(2 * k, int(2 * k * (1 + 0.5 * math.log10(n / 1000 + 1)))))


@dataclass(frozen=True)
class IndexConfig:
    dimension: int
    m: int = 0
    ef_construction: int = 0
    metric: str = "l2"
    adaptive: bool = True
    expected_size: int = 10_000
    seed: int = 42
    shards: int = 0  # 0: by the number of vectors

    def resolved(self) -> tuple[int, int]:
        if self.dimension <= 0:
            raise ValueError("dimension must be positive")
        m, ef = adaptive_parameters(self.dimension, self.expected_size) if self.adaptive else (16, 200)
        return (self.m if self.m > 0 else m), (self.ef_construction if self.ef_construction > 0 else ef)


def draw_level(u: float, m: int) -> int:
    return min(LEVEL_MOST, int(-math.log(max(u, 1e-300)) / math.log(m)))


def _chosen(rows: np.ndarray, own: np.ndarray, near: np.ndarray, valid: np.ndarray, most: int, local: bool) -> np.ndarray:
    """Which of its candidates (near, a line a node of own, nearest first, where valid) each node is linked to: near ones in all directions; one that is nearer to a chosen one than to the node waits.

    i is nearer to j than the node v is where (i - v)(j - v) > (i - v)^2 / 2 (local), or by products alone (i - v) j > 0.
    Differences are taken in full and multiplied in single precision, in parts that stay in the cache.
    """
    keep, width = np.empty(near.shape, bool), near.shape[1]
    step, part = max(1, 4 * CELLS // width**2), max(1, CELLS // (8 * width * max(width, rows.shape[1])))
    for lo in range(0, len(near), step):
        some, there = near[lo : lo + step], valid[lo : lo + step]
        closer = np.empty((len(some), width, width), bool)
        for at in range(0, len(some), part):
            x = rows[some[at : at + part]]
            y = (x - rows[own[lo + at : lo + at + len(x)], None]).astype(np.float32)
            x = y if local else x.astype(np.float32)
            half = np.einsum("ijk,ijk->ij", y, y) / 2 if local else np.zeros(y.shape[:2], np.float32)
            np.greater(y @ x.transpose(0, 2, 1), half[:, :, None], out=closer[at : at + part])
        waits, taken, count = ~there, np.zeros(there.shape, bool), np.zeros(len(there), np.int64)
        for c in range(width):
            take = ~waits[:, c] & (count < most)
            count += take
            taken[:, c] = take
            waits |= closer[:, c] & take[:, None]
        waits = there & ~taken
        keep[lo : lo + step] = taken | (waits & (waits.cumsum(axis=1) <= (most - count)[:, None]))
    return keep


class Graph:
    """One shard's graph; vectors is an n x d matrix whose rows are the nodes."""

    def __init__(self, vectors: np.ndarray, levels: list[int], m: int, ef_construction: int, metric: str):
        self.v, self.levels, self.m, self.ef, self.metric = vectors, levels, m, ef_construction, metric
        self.links: list[list[list[int]]] = [[[] for _ in range(level + 1)] for level in levels]
        self.entry, self.top = -1, -1

    def dist(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        return exact_distances(self.metric, q, self.v[nodes])

    def grow(self, start: int = 0) -> Graph:
        """Links the nodes from start on, which have no links yet, and those before them that they choose.

        Each chooses among the ef nodes before it in its layer that are nearest to it, which products of matrices
        find; once all have, the nodes that have been chosen choose among their links and those that came.
        """
        levels = np.array(self.levels)
        if start < len(levels):
            rows, squares = self._prepared()
            for layer in range(int(levels[start:].max()) + 1):
                members = np.flatnonzero(levels >= layer)
                self._grow_layer(layer, members, int(np.searchsorted(members, start)), rows[members], squares[members])
            self.entry = int(levels.argmax())
            self.top = self.levels[self.entry]
        return self

    def _prepared(self) -> tuple[np.ndarray, np.ndarray]:
        """Vectors, none longer than 1, and numbers of each such that a + b - 2xy puts pairs in the order of the metric: what l2 vectors have in common would only add to the rounding error."""
        local = self.metric in ("l2", "l2_sqrt")
        rows = self.v - self.v.mean(axis=0) if local else self.v
        norms = np.sqrt((rows**2).sum(axis=1, keepdims=True))
        norms = norms if self.metric == "cosine" else norms.max()
        rows = rows / np.where(norms == 0, 1.0, norms)
        return rows, (rows**2).sum(axis=1) if local else np.zeros(len(rows))

    def _grow_layer(self, layer: int, members: np.ndarray, first: int, rows: np.ndarray, squares: np.ndarray) -> None:
        """Nodes are places among the members here, of which those from first on are new."""
        most, n, pairs, local = 2 * self.m if layer == 0 else self.m, len(members), [], self.metric in ("l2", "l2_sqrt")
        left, right = np.column_stack([-2 * rows, np.ones(n), squares]), np.column_stack([rows, squares, np.ones(n)])
        lo = first
        while lo < n:
            hi = min(n, lo + max(1, CELLS // n))
            far = left[lo:hi] @ right[:hi].T
            far[:, lo:][np.arange(hi - lo)[:, None] <= np.arange(hi - lo)] = np.inf  # itself and those after it
            width = min(max(self.ef, most), hi)
            near = np.argpartition(far, width - 1, axis=1)[:, :width] if width < hi else np.broadcast_to(np.arange(hi), far.shape)
            far = np.take_along_axis(far, near, axis=1)
            order = np.lexsort((near, far), axis=1)
            near, far = np.take_along_axis(near, order, axis=1), np.take_along_axis(far, order, axis=1)
            keep = _chosen(rows, np.arange(lo, hi), near, np.isfinite(far), most, local)
            pairs.append((np.repeat(np.arange(lo, hi), keep.sum(axis=1)), near[keep], far[keep]))
            lo = hi
        one, other, far = (np.concatenate(x) for x in zip(*pairs))
        known = [(j, x) for j in np.unique(other[other < first]).tolist() for x in self.links[members[j]][layer]]  # of the chosen that were there
        old = np.array([j for j, _ in known], np.int64)
        to = np.searchsorted(members, np.array([x for _, x in known], np.int64))
        apart = squares[old] + squares[to] - 2 * np.einsum("ij,ij->i", rows[old], rows[to])
        one, other, far = np.concatenate([one, other, old]), np.concatenate([other, one, to]), np.concatenate([far, far, apart])
        order = np.lexsort((other, far, one))
        one, other, far = one[order], other[order], far[order]
        at, sizes = np.unique(one, return_index=True, return_counts=True)[1:]
        by_size = np.argsort(sizes, kind="stable")
        lo = 0
        while lo < len(at):
            hi, width = lo + 1, int(min(sizes[by_size[lo]], max(self.ef, most)))
            while hi < len(at) and (hi + 1 - lo) * int(min(sizes[by_size[hi]], max(self.ef, most))) ** 2 <= CELLS:
                hi += 1
            some = by_size[lo:hi]
            width = int(min(sizes[some].max(), max(self.ef, most)))
            there = np.arange(width) < sizes[some][:, None]
            place = np.where(there, at[some][:, None] + np.arange(width), 0)
            near = np.where(there, other[place], 0)
            keep = there if width <= most else _chosen(rows, one[at[some]], near, there, most, local)
            for j, row, kept in zip(one[at[some]].tolist(), members[near], keep):
                self.links[members[j]][layer] = row[kept].tolist()
            lo = hi

    def _far(self, q: np.ndarray, nodes: list[int]) -> list[float]:
        return self.dist(q, nodes).tolist()

    def _descend(self, q: np.ndarray, from_: int, to: int) -> int:
        now, d = self.entry, self._far(q, [self.entry])[0]
        for layer in range(from_, to, -1):
            while layer < len(self.links[now]) and self.links[now][layer]:
                near = self._far(q, self.links[now][layer])
                best = near.index(min(near))
                if near[best] >= d:
                    break
                now, d = self.links[now][layer][best], near[best]
        return now

    def _layer(self, q: np.ndarray, starts: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ef nearest nodes found from starts on, nearest first."""
        seen = set(starts)
        open_ = list(zip(self._far(q, starts), starts))
        heapq.heapify(open_)
        best = [(-d, n) for d, n in open_]
        heapq.heapify(best)
        while open_:
            d, n = heapq.heappop(open_)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = [x for x in self.links[n][layer] if x not in seen] if layer < len(self.links[n]) else []
            if not new:
                continue
            seen.update(new)
            for dx, x in zip(self._far(q, new), new):
                if len(best) < ef or dx < -best[0][0] + abs(best[0][0]) * WIDEN + WIDEN_BY:
                    heapq.heappush(open_, (dx, x))
                    heapq.heappush(best, (-dx, x))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, n) for d, n in best)

    def search(self, q: np.ndarray, k: int, ef: int, alive: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The k nearest nodes found, of those that are alive."""
        if self.entry < 0 or not k:
            return []
        start = [self._descend(q, self.top, 0)]
        if alive is None:
            return self._layer(q, start, ef, 0)[:k]
        there = int(alive.sum())
        while there:
            found = [x for x in self._layer(q, start, ef, 0) if alive[x[1]]]
            if len(found) >= min(k, there):
                return found[:k]
            if ef >= len(self.v):  # nodes that no link leads to
                nodes = np.flatnonzero(alive)
                return sorted(zip(self.dist(q, nodes).tolist(), nodes.tolist()))[:k]
            ef = min(2 * ef, len(self.v))
        return []

    def scan(self, queries: np.ndarray, ids: np.ndarray, k: int, alive: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """As search of the breadth of the whole graph, for all queries at once: places of queries, and ids and distances of the k nearest nodes, ties by id."""
        rows, ids = (self.v, ids) if alive is None else (self.v[alive], ids[alive])
        if not len(rows) or not k:
            return
        step = max(1, CELLS // len(rows))
        for lo in range(0, len(queries), step):
            for i, at, d in nearest(self.metric, queries[lo : lo + step], ids, rows, k):
                yield lo + i, ids[at], d

    @classmethod
    def of(cls, nodes: pd.DataFrame, m: int, ef_construction: int, metric: str) -> Graph:
        """The graph that rows of a shard, in order of node_id, hold."""
        vectors = np.stack(nodes["vector"].to_numpy()).astype(np.float64)
        graph = cls(vectors, nodes["level"].tolist(), m, ef_construction, metric)
        for own, links in zip(graph.links, nodes["links"]):
            for link in links:
                own[link["layer"]] = [int(x) for x in link["neighbors"]]
        graph.entry = int(np.argmax(nodes["entry"].to_numpy()))
        graph.top = graph.levels[graph.entry]
        return graph

    def rows(self, shard: int, ids: list, vectors: list) -> pd.DataFrame:
        n = len(ids)
        return pd.DataFrame({
            "shard": np.full(n, shard, np.int32), "node_id": np.arange(n, dtype=np.int32), "id": ids, "vector": vectors, "level": np.array(self.levels, np.int32),
            "links": [[{"layer": layer, "neighbors": [int(x) for x in own]} for layer, own in enumerate(node)] for node in self.links], "entry": np.arange(n) == self.entry,
        })


def _by_shard(df: DataFrame, shards: int):
    """Groups of shards, each in a task of its own."""
    return df.repartitionById(shards, "shard").groupBy("shard")


def shards_for(n: int) -> int:
    return max(SHARDS_LEAST, min(SHARDS_SOON, n // SHARD_LEAST), -(-n // SHARD_NODES))


def _dealt(docs: DataFrame, shards: int, seed: int, id_col: str, vector_col: str) -> DataFrame:
    """shard, id, vector and a number that draws the level."""
    u = (F.xxhash64(id_col, F.lit(seed)).cast("double") / 2.0**64) + 0.5
    return docs.select(F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int").alias("shard"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector"), u.alias("u"))


def _with_views(graphs: DataFrame, meta: DataFrame, *parameters) -> dict[str, DataFrame]:
    edges = graphs.select("shard", "node_id", F.explode("links").alias("l")).select("shard", "node_id", "l.layer", F.explode("l.neighbors").alias("neighbor_id"))
    names = [x.split() for x in FIXED.split(", ")]
    fixed = {"fixed": graphs.sparkSession.range(1).select(*[F.lit(x).cast(t).alias(c) for x, (c, t) in zip(parameters, names)])} if parameters else {}  # what meta repeats, without a look at the graphs
    return {"graphs": graphs, "nodes": graphs.select("shard", "node_id", "id", "vector", "level"), "edges": edges, "meta": meta} | fixed


def _meta(graphs: DataFrame, m: int, ef: int, dimension: int, metric: str, shards: int, seed: int) -> DataFrame:
    return graphs.groupBy("shard").agg(
        F.lit(m).alias("m"), F.lit(m).alias("m_max"), F.lit(2 * m).alias("m_max0"), F.lit(ef).alias("ef_construction"), F.lit(dimension).alias("dimension"),
        F.max(F.when(F.col("entry"), F.col("node_id"))).alias("entry_point"), F.max("level").alias("max_level"), F.count("*").cast("int").alias("num_nodes"), F.lit(metric).alias("metric"),
        F.lit(shards).alias("shards"), F.lit(seed).alias("seed"),
    )


def build_index(docs: DataFrame, config: IndexConfig, id_col: str = "id", vector_col: str = "vector") -> dict[str, DataFrame]:
    """graphs, with views nodes and edges, and meta. Rows without a vector are left out. Written by save_index the graphs are built once."""
    m, ef = config.resolved()
    kind, metric, dimension, seed = dict(docs.dtypes)[id_col], config.metric, config.dimension, config.seed
    docs = docs.where(F.col(vector_col).isNotNull())
    shards = config.shards or shards_for(docs.count())

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        vectors = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        if vectors.shape[1] != dimension:
            raise ValueError("vectors differ in dimension")
        return Graph(vectors, [draw_level(u, m) for u in pdf["u"]], m, ef, metric).grow().rows(key[0], pdf["id"].tolist(), pdf["vector"].tolist())

    graphs = _by_shard(_dealt(docs, shards, seed, id_col, vector_col), shards).applyInPandas(build, GRAPHS.format(id=kind))
    return _with_views(graphs, _meta(graphs, m, ef, dimension, metric, shards, seed), m, ef, dimension, metric, shards, seed)


def add_to_index(index: dict[str, DataFrame], docs: DataFrame, id_col: str = "id", vector_col: str = "vector") -> dict[str, DataFrame]:
    """index with the vectors of docs inserted into its graphs, shard by shard; ids must be new to it."""
    first = index["meta"].first()
    if first is None:
        raise ValueError("an index without nodes has no parameters; build one")
    m, ef, dimension, metric, shards, seed = (first[c] for c in ("m", "ef_construction", "dimension", "metric", "shards", "seed"))
    new, kind = _dealt(docs.where(F.col(vector_col).isNotNull()), shards, seed, id_col, vector_col), dict(index["graphs"].dtypes)["id"]

    def insert(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        old, new = old.sort_values("node_id"), new.sort_values("id", kind="stable")
        if len(new):
            vectors = np.stack(new["vector"].to_numpy()).astype(np.float64)
            if vectors.shape[1] != dimension:
                raise ValueError("vectors differ in dimension")
            levels = [draw_level(u, m) for u in new["u"]]
            graph = Graph.of(old, m, ef, metric) if len(old) else Graph(np.empty((0, dimension)), [], m, ef, metric)
            graph.v, graph.levels = np.concatenate([graph.v, vectors]), graph.levels + levels
            graph.links += [[[] for _ in range(level + 1)] for level in levels]
            graph.grow(len(old))
        else:
            graph = Graph.of(old, m, ef, metric)
        return graph.rows(key[0], [*old["id"], *new["id"]], [*old["vector"], *new["vector"]])

    graphs = _by_shard(index["graphs"], shards).cogroup(_by_shard(new, shards)).applyInPandas(insert, GRAPHS.format(id=kind))
    return _with_views(graphs, _meta(graphs, m, ef, dimension, metric, shards, seed), m, ef, dimension, metric, shards, seed)


def save_index(index: dict[str, DataFrame], path: str) -> None:
    """Writes the graphs, once, and the parameters from what was written."""
    index["graphs"].write.mode("overwrite").parquet(f"{path}/graphs")
    graphs = index["graphs"].sparkSession.read.schema(index["graphs"].schema).parquet(f"{path}/graphs")
    row = index.get("fixed", index["meta"]).first()
    meta = _meta(graphs, row["m"], row["ef_construction"], row["dimension"], row["metric"], row["shards"], row["seed"]) if row else index["meta"]
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def open_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return _with_views(spark.read.parquet(f"{path}/graphs"), spark.read.parquet(f"{path}/meta"))


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    index = open_index(spark, path)
    problems = index_problems(index).collect()
    if problems:
        from stellate.errors import IndexCorruptedError

        raise IndexCorruptedError("load", "; ".join(f"{r['problem']}: {r['n']}" for r in problems))
    return index


def index_problems(index: dict[str, DataFrame]) -> DataFrame:
    """problem, n: ids that aren't dense, edges to or from missing nodes, edges above a node's level."""
    nodes, edges = index["nodes"], index["edges"]
    dense = nodes.groupBy("shard").agg((F.max("node_id") + 1).alias("top"), F.count("*").alias("n"), F.count_distinct("node_id").alias("d")).where("top <> n or n <> d")
    own = nodes.select("shard", "node_id", "level")
    to = own.select("shard", F.col("node_id").alias("neighbor_id"), F.col("level").alias("to_level"))
    joined = edges.join(own, ["shard", "node_id"], "left").join(to, ["shard", "neighbor_id"], "left")
    of_edges = joined.agg(F.count_if(F.expr("level is null or to_level is null")).alias("missing"), F.count_if(F.expr("layer > level or layer > to_level")).alias("above"))  # edges are read once
    out = dense.agg(F.lit("ids not dense").alias("problem"), F.count("*").alias("n")).unionByName(
        of_edges.select(F.expr("stack(2, 'edges without a node', missing, 'edges above a level', above) as (problem, n)"))
    )
    return out.where("n > 0")


def degrees(index: dict[str, DataFrame]) -> DataFrame:
    """shard, layer, node_id, degree."""
    return index["edges"].groupBy("shard", "layer", "node_id").agg(F.count("*").alias("degree"))


def neighbors(index: dict[str, DataFrame], node_id: int, layer: int = 0) -> DataFrame:
    return index["edges"].where((F.col("node_id") == node_id) & (F.col("layer") == layer)).select("shard", "neighbor_id")


def ann_search(index: dict[str, DataFrame], queries: DataFrame, k: int, ef: int | str = 0, query_col: str = "query_id", vector_col: str = "vector", strict_ef: bool = False, alive: DataFrame | None = None) -> DataFrame:
    """query_col, id, distance and rank. ef 0: max(200, 2k); "adaptive": by k and the number of nodes. alive: ids of the nodes that count; with a vector, those of this vector only."""
    if k < 0:
        raise ValueError("k must not be negative")
    meta = index["meta"].agg(F.first("metric").alias("metric"), F.first("shards").alias("shards"), F.coalesce(F.sum("num_nodes"), F.lit(0)).alias("n"), F.coalesce(F.max("num_nodes"), F.lit(0)).alias("largest")).first()
    metric, breadth = meta["metric"] or "l2", query_ef(k, meta["n"]) if ef == "adaptive" else ef or default_ef(k)
    breadth = breadth if strict_ef else max(breadth, k)
    kind, asked_kind = dict(index["graphs"].dtypes)["id"], dict(queries.dtypes)[query_col]
    graphs, schema = index["graphs"], f"`{query_col}` {asked_kind}, id {kind}, distance double"
    some = alive is not None
    if some:
        own = ["id", "vector"] if "vector" in alive.columns else ["id"]
        alive = alive.select([F.col(c).cast("array<float>").alias(c) if c == "vector" else c for c in own])
    if breadth >= meta["largest"]:
        nodes = graphs.select("id", "vector")
        return search_batch(nodes.join(alive, own, "left_semi") if some else nodes, queries, k, metric, query_col=query_col, query_vector_col=vector_col)
    graphs = graphs.join(alive.distinct().withColumn("alive", F.lit(True)), own, "left") if some else graphs.withColumn("alive", F.lit(True))

    def searched(block: list) -> DataFrame:
        names, matrix = [r[0] for r in block], np.array([r[1] for r in block], np.float64)

        def run(nodes: pd.DataFrame) -> pd.DataFrame:
            nodes = nodes.sort_values("node_id")
            ids, graph = nodes["id"].to_numpy(), Graph.of(nodes, 0, 0, metric)
            live = (nodes["alive"] == True).to_numpy(bool) if some else None  # noqa: E712 (null: not alive)
            if breadth >= len(ids):  # all nodes would be visited, one query after another
                rows = [(names[i], x, d) for i, near, far in graph.scan(matrix, ids, k, live) for x, d in zip(near.tolist(), far.tolist())]
            else:
                rows = [(name, ids[n], d) for name, q in zip(names, matrix) for d, n in graph.search(q, k, breadth, live)]
            return pd.DataFrame(rows, columns=[query_col, "id", "distance"])

        return _by_shard(graphs, meta["shards"] or 1).applyInPandas(run, schema)

    asked = queries.select(query_col, F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    parts = [searched(block) for block in blocks(asked)]
    if not parts:
        return graphs.sparkSession.createDataFrame([], schema + ", rank int")
    return top_k(reduce(DataFrame.unionByName, parts), k, query_col, "id")
