"""Versioned folders of Parquet, through Hadoop's file system, so on any store Spark writes to.

A commit writes a new version's folder, then claims its number by a file that only one writer can create, and
sets a marker in the folder last; readers take the highest version with a marker. Nothing is overwritten, so a
lost writer leaves at most an unmarked folder and a claim, which vacuum removes.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stellate.errors import VersionConflictError, VersionError

FORMAT_VERSION = (1, 2)
MARKER, CLAIM = "_COMMITTED", "_claim_"
GONE, ORDER = "__gone", "__order"

# Features of the format, each a bit in this order.
FEATURES = ("BasicColumnar", "ZstdCompression", "DictionaryEncoding", "RLE", "BitPacking", "RowIndex", "BlockCache", "AsyncIO", "FullZip", "Checksum", "Encryption")
#: Features that a minor version of format 1 brings, beside those of the ones before it.
BROUGHT = {0: FEATURES[:5], 1: ("RowIndex",), 2: ("BlockCache",)}


def feature_names(flags: int) -> list[str]:
    """Names of the bits set; bits without a name are left out."""
    return [name for i, name in enumerate(FEATURES) if flags >> i & 1]


def feature_flags(version: tuple[int, int] = FORMAT_VERSION) -> int:
    return sum(1 << FEATURES.index(name) for minor, names in BROUGHT.items() if version[0] == 1 and minor <= version[1] for name in names)


def compatible(reader: tuple[int, int], file: tuple[int, int]) -> bool:
    """Same major version, and a minor one no higher than the reader's."""
    return reader[0] == file[0] and reader[1] >= file[1]


def check_version(file: tuple[int, int]) -> None:
    if not compatible(FORMAT_VERSION, file):
        raise VersionError("open", f"{file[0]}.{file[1]}; this reader has {FORMAT_VERSION[0]}.{FORMAT_VERSION[1]}")


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def folders(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def move(self, path: str, to: str) -> bool:
        fs, p = self._at(path)
        return fs.rename(p, self._at(to)[1])

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def touch(self, path: str) -> None:
        fs, p = self._at(path)
        fs.create(p, False).close()

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def claim(self, path: str) -> bool:
        """Creates a file; False if it is there."""
        fs, p = self._at(path)
        try:
            return bool(fs.createNewFile(p))
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise

    def bytes_under(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


class VersionedTable:
    """Versions of a table. A version is whole or a delta: rows that replace those of equal key, or take them away (GONE)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key, self.files = spark, path.rstrip("/"), key, Files(spark)
        self._names: dict[int, str] = {}

    def versions(self) -> list[int]:
        out = []
        for name in self.files.folders(self.path):
            m = re.fullmatch(r"v(\d+)_(\d+)_(\d+)(?:-[0-9a-f]+)?(?:-delta)?", name)
            if m and self.files.exists(f"{self.path}/{name}/{MARKER}"):
                check_version((int(m[2]), int(m[3])))
                out.append((int(m[1]), name))
        self._names = dict(out)
        return sorted(self._names)

    def _chain(self, version: int) -> list[int]:
        """The last whole version up to this one, and the deltas after it."""
        upto = [v for v in sorted(self._names) if v <= version]
        first = max((v for v in upto if not self._names[v].endswith("-delta")), default=None)
        if version not in upto or first is None:
            raise VersionError("read", f"version {version} isn't there")
        return [v for v in upto if v >= first]

    def deltas(self) -> int:
        """How many deltas the newest version consists of."""
        versions = self.versions()
        return len(self._chain(versions[-1])) - 1 if versions else 0

    def read(self, version: int | None = None) -> DataFrame | None:
        """Deltas are merged as it is read."""
        versions = self.versions()
        if not versions:
            return None
        chain = self._chain(versions[-1] if version is None else version)
        out = self.spark.read.parquet(f"{self.path}/{self._names[chain[0]]}")
        if len(chain) > 1:
            parts = [self.spark.read.parquet(f"{self.path}/{self._names[v]}").withColumn(ORDER, F.lit(v)) for v in chain[1:]]
            out = changed(out, last_of(parts, self.key), self.key)
        return out

    def commit(self, df: DataFrame, base: int | None = None, **options: str) -> int:
        """Writes df as the next version, whole. base: the version that df was made from (the newest, if not given)."""
        return self._commit(df, base, "", options)

    def commit_changes(self, changes: DataFrame, base: int | None = None, **options: str) -> int:
        """Writes rows of new or replaced keys, and keys with GONE set, as the next version; a key may occur once."""
        return self._commit(changes, base, "-delta", options)

    def _commit(self, df: DataFrame, base: int | None, kind: str, options: dict) -> int:
        """Of writers that start from one version, the first to claim the next one commits it; the others fail, and leave nothing."""
        version = ((self.versions() or [0])[-1] if base is None else base) + 1
        name = f"v{version}_{FORMAT_VERSION[0]}_{FORMAT_VERSION[1]}-{uuid.uuid4().hex[:8]}{kind}"
        df.write.options(**{"compression": "zstd"} | options).parquet(f"{self.path}/{name}")
        if not self.files.claim(f"{self.path}/{CLAIM}{version}"):
            self.files.delete(f"{self.path}/{name}")
            raise VersionConflictError("commit", f"version {version} has been written or claimed by another writer")
        self.files.touch(f"{self.path}/{name}/{MARKER}")
        self._names[version] = name
        return version

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what the last versions aren't made of, and what writers that failed have left; readers and writers must be done. Returns how many versions."""
        versions = self.versions()
        kept = versions[-keep:] if versions else []
        needed = {v for k in kept for v in self._chain(k)}
        live = {self._names[v] for v in needed}
        for name in self.files.folders(self.path):
            if re.match(r"v\d+_", name) and name not in live:
                self.files.delete(f"{self.path}/{name}")
        for name in self.files.names(self.path):
            if name.startswith(CLAIM) and int(name[len(CLAIM) :]) not in needed:
                self.files.delete(f"{self.path}/{name}")
        return len(set(versions) - needed)


def last_of(parts: list[DataFrame], key: str) -> DataFrame:
    """The row of highest ORDER of each key."""
    changes = parts[0]
    for part in parts[1:]:
        changes = changes.unionByName(part, allowMissingColumns=True)
    if len(parts) > 1:
        at = Window.partitionBy(key).orderBy(F.desc(ORDER))
        changes = changes.withColumn("__n", F.row_number().over(at)).where("__n = 1").drop("__n")
    return changes.drop(ORDER)


def changed(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """df with changes (one a key) applied."""
    gone = F.coalesce(F.col(GONE), F.lit(False))
    return df.join(changes.select(key), key, "left_anti").unionByName(changes.where(~gone).drop(GONE), allowMissingColumns=True)
