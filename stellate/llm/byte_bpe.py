"""Byte-level BPE in numpy: pieces of like length are the padded rows of a matrix.

In each round every row merges its leftmost pair of least rank; pairs are looked up by hash in a table of
open addresses, the merged columns close up, and rows without a further merge leave the matrix. Pieces of
more than LONG bytes, for which a round a merge would take too long, are merged one by one from a heap,
with the same result. Ranks are ids, as in the rank files.

Defined cases: null and empty texts have no tokens; repeated rows each have their row; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.llm.common import bounded_batches, vocabulary

LONG = 256
NONE = np.int32(2**31 - 1)
#: Cells of a matrix; distinct pieces whose ids a task remembers, and their bytes at most.
CELLS, PIECES_KEPT, BYTES_KEPT = 1 << 20, 400_000, 16 << 20


class PairTable:
    """(left id, right id) -> rank of the merged pair, for arrays of pairs."""

    BITS = 20

    def __init__(self, pairs: dict[tuple[int, int], int]):
        size = 1 << max(self.BITS, (2 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.keys, self.values, self.mask = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), size - 1
        if not pairs:
            self.probes = 1
            return
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int32)
        at, self.probes = self._home(keys), 0
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of those that meet in a place, one stays
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], at[~mine] + 1 & self.mask
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where the pair doesn't merge; ids below 0 are padding."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = at[open_] + 1 & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.table = PairTable(self.pairs)

    @classmethod
    def from_file(cls, path: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in pieces]
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = [whole]
            elif len(p) > LONG:
                out[i] = self._long(p)
            elif p:
                width = len(p) if len(p) <= 16 else -(-len(p) // 8) * 8
                buckets.setdefault(width, []).append(i)
        for width, rows in buckets.items():
            most = max(1, CELLS // width)
            for at in range(0, len(rows), most):
                part = rows[at : at + most]
                for where, ids in self._matrix([pieces[i] for i in part], width):
                    for i, own in zip(where.tolist(), ids.tolist()):
                        out[part[i]] = own if own[-1] >= 0 else [x for x in own if x >= 0]
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers and their ids, as rows come to an end."""
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.where(np.arange(width) < sizes[:, None], self.of_byte[raw], np.int32(-1))
        rows = np.arange(len(pieces))
        if width == 1:
            yield rows, ids
            return
        ranks = self.table.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), -1)
        while len(rows):
            at = ranks.argmin(axis=1)  # the leftmost of equal ranks
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                yield rows[done], ids[done]
                rows, ids, ranks, at, best = rows[~done], ids[~done], ranks[~done], at[~done], best[~done]
                if not len(rows):
                    return
            each, n = np.arange(len(rows)), ids.shape[1]
            ids[each, at] = best
            keep = np.arange(n - 1) + (np.arange(n - 1) > at[:, None])  # all but the right half of the pair
            ids = np.take_along_axis(ids, keep, axis=1)
            if n == 2:
                yield rows, ids
                return
            ranks = np.take_along_axis(ranks, np.arange(n - 2) + (np.arange(n - 2) >= at[:, None]), axis=1)
            has = at > 0
            ranks[each[has], at[has] - 1] = self.table.ranks(ids[each[has], at[has] - 1], ids[each[has], at[has]])
            has = at < n - 2
            ranks[each[has], at[has]] = self.table.ranks(ids[each[has], at[has]], ids[each[has], at[has] + 1])

    def _long(self, piece: bytes) -> list[int]:
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n, get = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has merged since
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get((rank, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := get((ids[h], rank))) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])


class TextCoder:
    """Texts by way of their pieces, each distinct piece merged once."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.bpe, self.split, self.known, self.size = ByteBPE.from_file(path), regex.compile(pattern).findall, {}, 0

    def pieces(self, texts: list[str | None]) -> list[list[tuple[list[int], str, bytes]]]:
        """Ids, ids as text and decoded bytes of each piece of each text."""
        if len(self.known) > PIECES_KEPT or self.size > BYTES_KEPT:
            self.known.clear()
            self.size = 0
        known, split = self.known, [self.split(t) if t else [] for t in texts]
        new = list({p for ps in split for p in ps if p not in known})
        for p, ids in zip(new, self.bpe.encode_pieces([p.encode() for p in new])):
            known[p] = (ids, " ".join(map(str, ids)), self.bpe.decode(ids))
            self.size += len(p)
        return [[known[p] for p in ps] for ps in split]


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_file: str = "byte_bpe_50k.tiktoken", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every row; with_ids adds ids (array<int>) and decoded (binary)."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        coder = TextCoder(vocabulary(vocabulary_file), public_tokenizers.PATTERN)
        for batch in batches:
            n, ids_sha, decoded_sha, ids, decoded = [], [], [], [], []
            for at in range(0, batch.num_rows, 64):
                for row in coder.pieces(batch.column(1).slice(at, 64).to_pylist()):
                    n.append(sum([len(p[0]) for p in row]))
                    ids_sha.append(hashlib.sha256(" ".join([p[1] for p in row]).encode()).hexdigest())
                    whole = b"".join([p[2] for p in row])
                    decoded_sha.append(hashlib.sha256(whole).hexdigest())
                    if with_ids:
                        ids.append([i for p in row for i in p[0]])
                        decoded.append(whole)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(encode, schema)
