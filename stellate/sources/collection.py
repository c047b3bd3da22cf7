"""Collections of documents: id, vector, ts, metadata columns.

A collection is a versioned table of Parquet. A change is written once when it is made (so that times and ids
given to it stay what they are), beside the table, and read merged with it. save() commits what is staged as a
delta: only changed documents are written, and merged with the others as the table is read; after DELTAS_MOST
deltas a whole version is written. Many staged changes make a long plan, so after STAGED_MOST of them the next
one saves first. A save fails if another writer has committed since this collection was opened or saved.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellate.errors import CollectionClosedError, CollectionNotFoundError, DimensionMismatchError, DocumentNotFoundError, DuplicateIDError, EmptyIndexError, InvalidDocumentError, OperationTimeoutError
from stellate.functions.filters import compile_filter
from stellate.operators import ann, knn
from stellate.sources.storage import GONE, ORDER, Files, VersionedTable, changed, last_of

STAGED_MOST, DELTAS_MOST = 8, 8


@dataclass(frozen=True)
class Config:
    dimension: int = 128
    metric: str = "l2"
    m: int = 0
    ef_construction: int = 0
    adaptive: bool = True
    expected_size: int = 10_000
    seed: int = 42
    shards: int = 0  # of the index; 0: by the number of documents
    parquet: dict = field(default_factory=dict)


def new_id() -> str:
    return str(uuid.uuid4())


def with_new_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Random ids; write the result before using it twice."""
    return df.withColumn(id_col, F.uuid())


def validated(docs: DataFrame, dimension: int) -> Column:
    """True for rows with an id and a vector of the dimension, without null members."""
    return F.coalesce((F.length("id") > 0) & (F.size("vector") == dimension) & ~F.exists("vector", lambda x: x.isNull()), F.lit(False))


def duplicate_ids(docs: DataFrame, there: DataFrame) -> DataFrame:
    """Ids that docs has more than once, or that are there already."""
    twice = docs.groupBy("id").count().where("count > 1").select("id")
    return twice.unionByName(docs.select("id").join(there.select("id"), "id", "left_semi")).distinct()


def latest(changes: DataFrame, keys: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The last row of each key (last writer wins), or the last n."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return changes.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def upserted(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """base with the rows of changes in place of those of equal key."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def _empty(spark: SparkSession, fields: list[T.StructField]) -> DataFrame:
    """No rows, known to the optimizer as such, and made without Python."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).where(F.lit(False))


class Collection:
    def __init__(self, spark: SparkSession, path: str, name: str, config: Config, metadata: T.StructType | None = None):
        self.spark, self.path, self.name, self.config = spark, path, name, config
        self.table, self.files, self.closed, self._changes = VersionedTable(spark, f"{path}/documents"), Files(spark), False, []
        self._at = (self.table.versions() or [0])[-1]
        stored = self.table.read()
        fixed = [T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("ts", T.TimestampType())]
        self._docs = stored if stored is not None else _empty(spark, [*fixed, *(metadata or [])])

    @property
    def staged(self) -> int:
        return len(self._changes)

    def docs(self) -> DataFrame:
        if self.closed:
            raise CollectionClosedError("read", collection=self.name)
        return self._docs

    def view(self, name: str | None = None) -> str:
        """Registers the collection for spark.sql."""
        self.docs().createOrReplaceTempView(name or self.name)
        return name or self.name

    def _ready(self, docs: DataFrame, op: str) -> tuple[DataFrame, str]:
        """docs, checked, and where they have been written."""
        if "ts" not in docs.columns:
            docs = docs.withColumn("ts", F.current_timestamp())
        docs = docs.withColumns({"id": F.col("id").cast("string"), "vector": F.col("vector").cast("array<float>"), "ts": F.coalesce("ts", F.current_timestamp())})
        docs, path = self._written(docs)
        wrong = docs.where(~validated(docs, self.config.dimension)).select("id", F.size("vector").alias("n")).head(1)
        if wrong:
            self.files.delete(path)
            bad = DimensionMismatchError if wrong[0]["id"] and wrong[0]["n"] is not None and wrong[0]["n"] != self.config.dimension else InvalidDocumentError
            raise bad(op, f"dimension {self.config.dimension} is expected, and an id", self.name, wrong[0]["id"] or "")
        return docs, path

    def _written(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.path}/staged/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def _stage(self, change: DataFrame, path: str) -> None:
        """change: documents, or ids with GONE set, one of an id."""
        if self.staged >= STAGED_MOST:
            self.save()
        change = change if GONE in change.columns else change.withColumn(GONE, F.lit(False))
        self._docs = changed(self.docs(), change, "id")
        self._changes.append((change, path))

    def _stage_gone(self, ids: DataFrame) -> None:
        change, path = self._written(ids.select(F.col("id").cast("string").alias("id")).distinct())
        self._stage(change.withColumn(GONE, F.lit(True)), path)

    def insert(self, docs: DataFrame) -> None:
        """All or nothing: an id that is there, or twice in docs, is an error."""
        docs, path = self._ready(docs, "insert")
        bad = duplicate_ids(docs, self.docs()).head(1)
        if bad:
            self.files.delete(path)
            raise DuplicateIDError("insert", collection=self.name, document=bad[0]["id"])
        self._stage(docs, path)

    def update(self, docs: DataFrame) -> None:
        """Replaces whole documents, which must be there."""
        docs, path = self._ready(docs, "update")
        missing = docs.select("id").join(self.docs().select("id"), "id", "left_anti").head(1)
        if missing:
            self.files.delete(path)
            raise DocumentNotFoundError("update", collection=self.name, document=missing[0]["id"])
        self._stage(self._last(docs), path)

    def upsert(self, docs: DataFrame) -> None:
        """Puts documents in place of those of equal id; of several of an id in docs the one of the latest ts."""
        docs, path = self._ready(docs, "upsert")
        self._stage(self._last(docs), path)

    def _last(self, docs: DataFrame) -> DataFrame:
        """The latest document of each id; of equal times the one of the greatest hash, so that any reading gives the same."""
        tie = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns])
        return latest(docs.withColumn("__tie", tie), ["id"], ["ts", "__tie"]).drop("__tie")

    def delete(self, id_: str) -> None:
        if not self.docs().where(F.col("id") == id_).head(1):
            raise DocumentNotFoundError("delete", collection=self.name, document=id_)
        self._stage_gone(self._ids([id_]))

    def delete_batch(self, ids: list[str] | DataFrame) -> None:
        """Ids that aren't there are passed over."""
        self._stage_gone(self._ids(ids))

    def _ids(self, ids: list[str] | DataFrame) -> DataFrame:
        return ids.select("id").distinct() if isinstance(ids, DataFrame) else self.spark.createDataFrame([(x,) for x in dict.fromkeys(ids)], "id string")

    def get(self, id_: str):
        rows = self.docs().where(F.col("id") == id_).head(1)
        if not rows:
            raise DocumentNotFoundError("get", collection=self.name, document=id_)
        return rows[0]

    def get_batch(self, ids: list[str] | DataFrame) -> DataFrame:
        return self.docs().join(self._ids(ids), "id", "left_semi")

    def missing(self, ids: list[str] | DataFrame) -> DataFrame:
        """Those of ids that aren't there."""
        return self._ids(ids).join(self.docs().select("id"), "id", "left_anti")

    def with_documents(self, rows: DataFrame) -> DataFrame:
        """rows, which have an id, with the documents they name; rows without one are left out."""
        return rows.join(self.docs(), "id")

    def find(self, condition, json: str | None = None) -> DataFrame:
        return self.docs().where(compile_filter(condition, self.docs().schema, json))

    def count(self) -> int:
        return self.docs().count()

    def stats(self) -> dict:
        docs = self.docs()
        r = docs.agg(F.count("*").alias("count"), F.max("ts").alias("last_update")).first()
        index = self.load_index(check=False)
        return {"name": self.name, "count": r["count"], "dimension": self.config.dimension, "index_nodes": index["nodes"].count() if index else 0, "orphan_nodes": self.orphans().count(), "last_update": r["last_update"]}

    def orphans(self) -> DataFrame:
        """Ids that the index has and the documents no longer have."""
        index = self.load_index(check=False)
        return index["nodes"].select("id").join(self.docs().select("id"), "id", "left_anti") if index else self.docs().select("id").limit(0)

    def storage_stats(self) -> dict:
        return {"documents": self.count(), "staged_changes": self.staged, "document_bytes": self.files.bytes_under(f"{self.path}/documents"), "index_bytes": self.files.bytes_under(f"{self.path}/index"), "versions": len(self.table.versions())}

    def search(self, vector: list[float], k: int, where=None, mode: str = "pre", json: str | None = None) -> DataFrame:
        """Exact search; a condition is met before ranking (pre) or, of the nearest rows only, after it (post)."""
        self._dimension(len(vector))
        if where is not None and mode == "post":
            return knn.search_post_filtered(self.docs(), vector, k, where, self.config.metric, json=json)
        return knn.search(self.docs(), vector, k, self.config.metric, where=where, json=json)

    def search_batch(self, queries: DataFrame, k: int, where=None, json: str | None = None, query_col: str = "query_id") -> DataFrame:
        """All queries at once, with the documents joined to the hits."""
        hits = knn.search_batch(self.docs(), queries, k, self.config.metric, where=where, json=json, query_col=query_col)
        return self.with_documents(hits)

    def _dimension(self, n: int) -> None:
        if n != self.config.dimension:
            raise DimensionMismatchError("search", f"{n} for {self.config.dimension}", self.name)

    def build_index(self) -> dict[str, DataFrame]:
        c = self.config
        own = ann.IndexConfig(c.dimension, c.m, c.ef_construction, c.metric, c.adaptive, c.expected_size, c.seed, c.shards)
        return self._save_index(ann.build_index(self.docs(), own))

    def load_index(self, check: bool = True) -> dict[str, DataFrame] | None:
        """The newest index; each lies in a folder of its own, so that one being read is never overwritten."""
        path, versions = f"{self.path}/index", self.index_versions()
        if not versions:
            return None
        at = f"{path}/v{versions[-1]}"
        return ann.load_index(self.spark, at) if check else ann.open_index(self.spark, at)

    def index_versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self.files.folders(f"{self.path}/index") if n[1:].isdigit() and self.files.exists(f"{self.path}/index/{n}/meta/_SUCCESS"))

    def _save_index(self, index: dict[str, DataFrame]) -> dict[str, DataFrame]:
        ann.save_index(index, f"{self.path}/index/v{(self.index_versions() or [0])[-1] + 1}")
        return self.load_index()

    def _indexed(self, index: dict[str, DataFrame]) -> DataFrame:
        """Ids whose document has the vector that the index has."""
        live = self.docs().select("id", F.col("vector").alias("__v"))
        return index["nodes"].select("id", "vector").join(live, "id").where("vector = __v").select("id")

    def extend_index(self) -> dict[str, DataFrame]:
        """Inserts documents that the index doesn't have yet into its graphs; a document whose vector has changed needs a new index (until then search ranks it exactly)."""
        index = self.load_index(check=False)
        if index is None:
            return self.build_index()
        new = self.docs().join(index["nodes"].select("id"), "id", "left_anti")
        return self._save_index(ann.add_to_index(index, new)) if not new.isEmpty() else index

    def search_index(self, queries: DataFrame, k: int, ef: int | str = 0, strict_orphans: bool = False, query_col: str = "query_id", where=None, json: str | None = None) -> DataFrame:
        """Approximate search, complete: k hits wherever there are k documents (that meet the condition).

        Nodes whose document has gone, changed or fails the condition are passed through by the graphs; documents that
        the index doesn't have are ranked exactly. strict_orphans: orphans take places among the k, and nothing is added.
        """
        index = self.load_index(check=False)
        if index is None or index["meta"].isEmpty():
            raise EmptyIndexError("search", collection=self.name)
        if strict_orphans:
            return ann.ann_search(index, queries, k, ef, query_col).join(self._indexed(index), "id", "left_semi")
        docs = (self.docs() if where is None else self.find(where, json)).select("id", "vector")
        found = ann.ann_search(index, queries, k, ef, query_col, alive=docs)
        rest = docs.join(index["nodes"].select("id", "vector"), ["id", "vector"], "left_anti")
        exact = knn.search_batch(rest, queries, k, self.config.metric, query_col=query_col)
        return knn.top_k(found.drop("rank").unionByName(exact.drop("rank")), k, query_col, "id")

    def save(self) -> int:
        """The version that holds what is staged. Without staged changes nothing is written, but for a first version."""
        if not self._changes and self._at:
            return self._at
        if self._at and self.table.deltas() < DELTAS_MOST:
            changes = last_of([c.withColumn(ORDER, F.lit(i)) for i, (c, _) in enumerate(self._changes)], "id")
            return self._saved(self.table.commit_changes(changes, self._at, **self.config.parquet))
        return self._saved(self.table.commit(self.docs(), self._at, **self.config.parquet))

    def _saved(self, version: int) -> int:
        self._at, self._docs = version, self.table.read(version)
        for _, path in self._changes:
            self.files.delete(path)
        self._changes = []
        return version

    def compact(self) -> int:
        """Saves everything as one whole version and deletes the earlier ones, whose readers must be done; returns how many."""
        if self._changes or self.table.deltas():
            self._saved(self.table.commit(self.docs(), self._at, **self.config.parquet))
        return self.table.vacuum()

    def within(self, seconds: float, action: Callable):
        """action(), whose jobs are cancelled if it takes longer."""
        tag, late = f"stellate-{uuid.uuid4().hex}", threading.Event()

        def stop():
            late.set()
            self.spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds, stop)
        self.spark.sparkContext.addJobTag(tag)
        timer.start()
        try:
            return action()
        except Exception as e:
            if late.is_set():
                raise OperationTimeoutError("within", f"{seconds} s", self.name) from e
            raise
        finally:
            timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)

    def close(self) -> None:
        if not self.closed:
            if self.staged:
                self.save()
            self.closed = True

    def cancel_group(self, tag: str) -> None:
        """Tags this thread's jobs; spark.sparkContext.cancelJobsWithTag(tag) ends them."""
        self.spark.sparkContext.addJobTag(tag)


class Database:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.path, self.config, self.files, self.open_ = spark, path.rstrip("/"), config or Config(), Files(spark), {}
        self.files.make(self.path)
        for name in self.collections():
            self.collection(name)

    def collection(self, name: str, metadata: T.StructType | None = None) -> Collection:
        """Opened, or made if new. A name is a folder's, and doesn't begin with a dot or an underscore."""
        if not name or name[0] in "._" or "/" in name or "\\" in name:
            raise InvalidDocumentError("collection", f"{name!r} is no name of a collection")
        if name not in self.open_ or self.open_[name].closed:
            self.files.make(f"{self.path}/{name}")
            self.open_[name] = Collection(self.spark, f"{self.path}/{name}", name, self.config, metadata)
        return self.open_[name]

    def collections(self) -> list[str]:
        return [n for n in self.files.folders(self.path) if n[0] not in "._"]

    def drop(self, name: str) -> None:
        if name not in self.collections():
            raise CollectionNotFoundError("drop", collection=name)
        self.files.delete(f"{self.path}/{name}")
        self.open_.pop(name, None)

    def close(self) -> None:
        errors = []
        for c in self.open_.values():
            try:
                c.close()
            except Exception as e:  # all others are still closed
                errors.append(e)
        if errors:
            raise ExceptionGroup("close", errors)
