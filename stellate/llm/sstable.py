"""Token ids of documents in sorted-string-table shards.

A shard is one file: a magic, data blocks, a sparse index with the last key of each block, a Bloom filter
and a footer of fixed length. Keys in a block store only what differs from the key before. Keys are
order-preserving encodings of identifiers, so shards written from a range-partitioned table are in key
order among themselves, too, and a lookup is a binary search over shards, then blocks.

Defined cases: a null text has the end id only; null identifiers sort first; repeated identifiers are
separate entries side by side, in order of their texts (null first); an empty table gives no shard and an
empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import io
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.llm.common import bounded_batches, partitions, per_worker, scratch, vocabulary

MAGIC = b"STLSST01"
BLOCK_BYTES = 1 << 16
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
FOOTER = "<QQQQQQB7x8s"  # index at, bytes; filter at, bytes; entries; ids; bytes of an id; magic
INDEX_ENTRY = "<QIIQ"  # block at, bytes, entries, ids in earlier blocks
#: Bytes of text in a shard, about, where there are so many.
SHARD_BYTES = 256 << 20
#: Distinct words whose ids a worker remembers, over all its tasks; the memory is emptied beyond that.
WORDS_KEPT = 1_500_000


def key_of(identifier) -> bytes:
    """Bytes that sort as identifiers do: null, then integers, then texts."""
    if identifier is None:
        return b"\x00"
    if isinstance(identifier, int):
        return b"\x01" + struct.pack(">Q", identifier + (1 << 63))
    return b"\x02" + str(identifier).encode()


def identifier_of(key: bytes):
    if key[0] == 0:
        return None
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] == 1 else key[1:].decode()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h & (1 << 64) - 1, h >> 64 | 1


def _bloom_positions(key: bytes, bits: int) -> list[int]:
    a, b = _bloom_hash(key)
    return [(a + i * b & (1 << 64) - 1) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes entries, given in key order, to a file object."""

    def __init__(self, out, id_bytes: int, block_bytes: int = BLOCK_BYTES):
        self.out, self.id_bytes, self.block_bytes = out, id_bytes, block_bytes
        self.at = self.entries = self.ids = self.block_entries = self.block_start_ids = 0
        self.block, self.last, self.index, self.hashes = bytearray(), b"", [], array("Q")
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes) -> None:
        if key < self.last:
            raise ValueError("keys must be given in order")
        shared = 0
        if self.block_entries:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if key != self.last or not self.entries:
            self.hashes.extend(_bloom_hash(key))
        self.last = key
        self.block_entries += 1
        self.entries += 1
        self.ids += len(value) // self.id_bytes
        if len(self.block) >= self.block_bytes:
            self._end_block()

    def _end_block(self) -> None:
        if self.block_entries:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.index.append((self.last, self.at, len(data), self.block_entries, self.block_start_ids))
            self._put(data)
            self.block, self.block_entries, self.block_start_ids = bytearray(), 0, self.ids

    def finish(self) -> None:
        self._end_block()
        index_at = self.at
        self._put(b"".join(_varint(len(k)) + k + struct.pack(INDEX_ENTRY, *rest) for k, *rest in self.index))
        bloom_at = self.at
        bits = max(64, BLOOM_BITS_PER_KEY * len(self.hashes) // 2) // 8 * 8
        bloom = np.zeros(bits // 8, np.uint8)
        a, b = np.array(self.hashes, np.uint64).reshape(-1, 2).T
        for i in range(BLOOM_HASHES):
            p = (a + np.uint64(i) * b) % np.uint64(bits)
            np.bitwise_or.at(bloom, (p >> np.uint64(3)).astype(np.int64), np.left_shift(1, (p & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        self._put(bloom.tobytes())
        self._put(struct.pack(FOOTER, index_at, bloom_at - index_at, bloom_at, bits // 8, self.entries, self.ids, self.id_bytes, MAGIC))


class ShardReader:
    """Random access to a shard; it holds the index and the filter, and one block at a time."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - struct.calcsize(FOOTER))
        index_at, index_bytes, bloom_at, bloom_bytes, self.entries, self.ids, self.id_bytes, magic = struct.unpack(FOOTER, file.read(struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(index_at)
        raw, at, self.index = file.read(index_bytes), 0, []
        while at < index_bytes:
            n, at = _read_varint(raw, at)
            self.index.append((bytes(raw[at : at + n]), *struct.unpack_from(INDEX_ENTRY, raw, at + n)))
            at += n + struct.calcsize(INDEX_ENTRY)
        file.seek(bloom_at)
        self.bloom = file.read(bloom_bytes)

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_positions(key, 8 * len(self.bloom)))

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size, entries, _ = self.index[i]
        self.file.seek(at)
        raw = self.file.read(size)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block is damaged")
        key, at = b"", 0
        for _ in range(entries):
            shared, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            at += own
            yield key, raw[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key; most absent keys read no block."""
        found: list[bytes] = []
        if not self.may_have(key):
            return found
        i = bisect.bisect_left(self.index, key, key=lambda e: e[0])
        while i < len(self.index):
            rows = list(self.block(i))
            found += [v for k, v in rows if k == key]
            if rows[-1][0] != key:
                break
            i += 1
        return found

    def array(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.id_bytes}")


def open_shard(uri: str) -> ShardReader:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return ShardReader(system.open_input_file(path), system.get_file_info(path).size)


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct word once.

    A vocabulary file whose steps are those of word_wise drops white space and never joins what stands on its two
    sides, so the ids of a text are those of its words (runs without ASCII white space), one after another. It also composes characters and
    then folds case, so A-Z are folded here, save in texts that may spell special tokens and in words beyond ASCII of
    texts with a character of U+0300 to U+037F, where all marks are that compose with a capital of A-Z. Words go to the library many at
    a time, parted by MARK, whose single id doesn't stem from any word without a MARK in it. With any other file
    whole texts go to the library.
    """

    MARK = "0"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.by_word = self.word_wise(path)
        if self.by_word:
            (self.mark,) = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def word_wise(path: str) -> bool:
        """Whether the file's steps are: compose, white space to one space, fold case; split, white space removed."""
        import json

        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        first = steps.get("normalizer") or {}
        kinds = [n["type"] for n in first.get("normalizers", [first]) if n]
        space = [n for n in first.get("normalizers", []) if n["type"] == "Replace"]
        pre = steps.get("pre_tokenizer") or {}
        split = next(iter(pre.get("pretokenizers", [])), pre)
        return (
            kinds == ["NFC", "Replace", "Lowercase"] and space[0]["pattern"] == {"Regex": "\\s+"} and space[0]["content"] == " "
            and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
        )

    def _learn(self, new: list[bytes]) -> None:
        kind, known, encode = "H" if self.id_bytes == 2 else "I", self.known, self.tokenizer.encode_batch_fast
        mark = self.MARK.encode()
        alone = [w for w in new if mark in w]
        if alone:
            new = [w for w in new if mark not in w]
        groups = [new[i : i + 64] for i in range(0, len(new), 64)]
        for at in range(0, len(groups), 64):
            part = groups[at : at + 64]
            for ws, e in zip(part, encode([(b" %b " % mark).join(ws).decode() for ws in part], add_special_tokens=False)):
                ids = array(kind, e.ids)
                cuts = [i for i, x in enumerate(ids) if x == self.mark]
                if len(cuts) != len(ws) - 1:
                    alone += ws
                    continue
                raw, begin, size = ids.tobytes(), 0, self.id_bytes
                for w, end in zip(ws, [*cuts, len(ids)]):
                    known[w] = raw[begin : end * size]
                    begin = (end + 1) * size
        for at in range(0, len(alone), 4096):
            part = alone[at : at + 4096]
            for w, e in zip(part, encode([w.decode() for w in part], add_special_tokens=False)):
                known[w] = array(kind, e.ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian integers."""
        if not self.by_word:
            kind = "H" if self.id_bytes == 2 else "I"
            return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        raw = [t.encode() if t else b"" for t in texts]
        words = [r.split() if b"<|" in r else [w.lower() if w.isascii() else w for w in r.split()] if b"\xcc" in r or b"\xcd" in r else r.lower().split() for r in raw]
        self._learn(list(set().union(*words).difference(self.known)))
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in words]


def write_shards(docs: DataFrame, path: str, vocabulary_file: str = "word_bpe_49k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> list[tuple[str, int, int]]:
    """Encodes every text and writes shards under path, in ascending order of identifiers.

    Returns (file, documents, ids before it) of each shard: a row a shard, not a row a document. A file
    carries its task's attempt number and counts only if that attempt is the one that ended well, so
    lost executors and repeated attempts do no harm.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context, encoder, writer = TaskContext.get(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = per_worker(("words", vocabulary_file), lambda: WordEncoder(vocabulary(vocabulary_file)))
                end = np.array([end_id], f"<u{encoder.id_bytes}").tobytes()
                name = f"{path}/shard-{context.partitionId():06d}-{context.taskAttemptId()}.sst"
                system, at = fs.FileSystem.from_uri(name)
                system.create_dir(at.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(at)
                writer = ShardWriter(out, encoder.id_bytes)
            for identifier, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                writer.add(key_of(identifier), ids + end)
        if writer is not None:
            writer.finish()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "file": [name], "entries": [writer.entries], "ids": [writer.ids]})

    own = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    if not shards:
        size = own.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
        shards = max(partitions(spark), -(-size // SHARD_BYTES))
    # by beginnings of texts, too, so that the rows of one identifier needn't share a shard
    parts = own.repartitionByRange(shards, F.col("k"), F.substring("t", 1, 64)).sortWithinPartitions("k", "t")
    rows = sorted(parts.mapInArrow(write, "part long, file string, entries long, ids long").collect())
    out, before = [], 0
    for row in rows:
        out.append((row["file"], row["entries"], before))
        before += row["ids"]
    return out


def read_shards(spark, shards: list[tuple[str, int, int]], id_type: str = "long") -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every entry, read from the files."""
    schema = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = open_shard(name)
                for i in range(len(shard.index)):
                    rows = []
                    for key, value in shard.block(i):
                        ids = shard.array(value)
                        rows.append((identifier_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if j == 0 and id_type == "string" else pa.int64()) for j, c in enumerate(zip(*rows))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame([(f, b) for f, _, b in shards], "file string, before long")
    return files.repartition(len(shards), "file").mapInArrow(read, schema)


def lookup(shards: list[str], identifiers: list) -> dict:
    """Ids of identifiers (a list of arrays each: repeated identifiers have several), from shards in order."""
    readers = [r for r in map(open_shard, shards) if r.index]
    found = {}
    for identifier in identifiers:
        key, values = key_of(identifier), []
        for r in readers[bisect.bisect_left([r.index[-1][0] for r in readers], key) :]:
            values += [r.array(v) for v in r.get(key)]
            if r.index[-1][0] > key:
                break
        found[identifier] = values
    return found


def encode_to_shards(docs: DataFrame) -> DataFrame:
    """Writes documents as shards in the shared folder and reads them back: the digest of every document."""
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, scratch(spark, "sst")), dict(docs.dtypes)["doc_id"].replace("bigint", "long"))


def in_memory(entries: list[tuple[bytes, bytes]], id_bytes: int, block_bytes: int = BLOCK_BYTES) -> ShardReader:
    """A shard without a file, for small data."""
    out = io.BytesIO()
    writer = ShardWriter(out, id_bytes, block_bytes)
    for key, value in entries:
        writer.add(key, value)
    writer.finish()
    return ShardReader(out, len(out.getvalue()))
