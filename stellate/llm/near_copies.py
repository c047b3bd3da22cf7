"""Documents that share shingles: a Jaccard join by a MinHash LSH forest.

A document is the set of its runs of SHINGLE words. Documents of equal sets are one node. Every node has a
signature of DEPTH_MOST minimum hashes in each of TREES prefix tries, and is a candidate of those that it
meets in a trie. Tries are kept as sorted signatures, where nodes of a common prefix stand side by side:
first in each chunk of nodes, whose members that meet are joined on the spot, then across chunks, to which
a chunk sends each prefix once, so that no prefix, however common, brings all its nodes to one task.

Nodes meet at full depth first. Candidates are compared exactly, and from the similarities of the links found,
each weighted by how likely that depth finds such a link, follows how many links there are, and so what share
any depth would find. While that share is below RECALL, prefixes are shortened to the longest that should
reach it, and only the pairs that meet there anew are compared.

Pairs are never rows. Nodes that candidates connect form a work unit, to which each node's set goes once,
and which gives each node its number of links and its group. A unit beyond UNIT_NODES or UNIT_SHINGLES is
cut up by trie and prefix, and a prefix beyond that into pairs of blocks, so nothing is left out and no task
takes an unbounded group.

Defined cases: words are runs of letters, digits and all characters beyond ASCII, A-Z in lower case; a text
of fewer than SHINGLE words is one shingle; null and empty texts have none, no links and a group of their own.
Each row is a document, whatever its id: rows of equal or null id are told apart by their text, and identical
rows are copies of each other. A class is named by its least id, null only where all its ids are; a row
without words by its own id. Ids may be of any type that has an order; an empty table gives an empty result;
other columns are ignored by the join and kept by keep_one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellate.llm.common import bounded_batches, checkpointed, few

SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5  # similarity of 4/5 or more
TREES, DEPTH_MOST, RECALL = 16, 8, 0.9995
UNIT_NODES, UNIT_SHINGLES = 4_000, 6_000_000
#: Nodes of a chunk; shingles that are signed at once; bins of similarities from the threshold to 1.
CHUNK_NODES, SIGNED, BINS, LINES = 200_000, 50_000, 20, 256
#: A set of more copies than this, and than the SHARE-th part of all rows (so there are fewer than SHARE such sets), is joined by broadcast.
COPIES, SHARE = 10_000, 100_000
WORDS_KEPT = 1_000_000
#: Lower case for A-Z, a space for every other ASCII character that is no letter or digit.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def found_share(similarity: float | np.ndarray, depth: int, trees: int = TREES):
    """Probability that a pair of a similarity meets in a trie at a depth."""
    return 1 - (1 - similarity**depth) ** trees


def next_depth(links: np.ndarray, depth: int, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix, of depth at most, that should find the share recall of all links; links: how many were found at depth, by bin of similarity.

    Without links to tell by it is the one that finds pairs of the least similarity so surely.
    """
    least = NUMERATOR / DENOMINATOR
    bins = least + (1 - least) * np.arange(len(links)) / len(links)  # lower ends
    there = links / found_share(bins, depth, trees) if links.sum() else np.eye(1, len(links))[0]
    while depth > 1 and (there * found_share(bins, depth, trees)).sum() < recall * there.sum():
        depth -= 1
    return depth


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Shingler:
    def __init__(self):
        self.known = WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        """Hashes of the distinct shingles, in order."""
        words = text.encode().translate(FOLD).split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - SHINGLE + 1)
        out = np.full(n, min(len(h), SHINGLE), np.uint64)
        for i in range(min(len(h), SHINGLE)):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        return np.unique(mixed(out))


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def factors(trees: int) -> np.ndarray:
    return mixed(np.arange(1, trees * DEPTH_MOST + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(sets: list[np.ndarray], trees: int) -> np.ndarray:
    """Signature of each set (none empty): DEPTH_MOST minimum hashes, of 16 bits each, for each trie."""
    flat, starts = np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    out = np.empty((len(sets), trees * DEPTH_MOST), np.uint16)
    for i, f in enumerate(factors(trees)):
        out[:, i] = np.minimum.reduceat(flat * f ^ f >> np.uint64(7), starts) & np.uint64(0xFFFF)
    return out.reshape(len(sets), trees, DEPTH_MOST)


def signature_of(raw: list[bytes], trees: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), ">u2").reshape(len(raw), trees, DEPTH_MOST)


def prefixes(signed: np.ndarray, depth: int) -> np.ndarray:
    """A number for the prefix of each node (a line) in each trie (a column)."""
    out = np.zeros(signed.shape[:2], np.uint64)
    for level in range(depth):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + signed[:, :, level] + np.uint64(1))
    return out.view(np.int64)


def similar(common, a, b):
    """Whether sets of sizes a and b with so many common members reach the threshold."""
    return (NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (a + b)


def common_counts(rows: list[np.ndarray], columns: list[np.ndarray], cells: int = 1 << 23) -> np.ndarray:
    """Sizes of the intersections of each set of rows with each of columns."""
    same = rows is columns
    sets = rows if same else rows + columns
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts > 1
    use = shared[at]
    column, member = (np.cumsum(shared) - 1)[at[use]], member[use]
    out = np.zeros((len(rows), len(columns)), np.float32)
    width = max(1, cells // len(sets))
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (low, low + width))
        part = np.zeros((len(sets), width), np.float32)
        part[member[a:b], column[a:b] - low] = 1
        out += part @ part.T if same else part[: len(rows)] @ part[len(rows) :].T
    return out


class Groups:
    """Union-find over 0 to n - 1, the least member leading."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def link(sets: list[np.ndarray], keys: np.ndarray, done: np.ndarray | None, copies: np.ndarray, tries: list[int], block: np.ndarray | None = None) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Links of each set (weighted by copies), its group's first member, and links by bin of similarity, over pairs that meet first in one of tries.

    done: longer prefixes, whose pairs have been compared before; block: only pairs of members of different blocks.
    """
    sizes, links, groups, bins = np.array([len(s) for s in sets]), np.zeros(len(sets), np.int64), Groups(len(sets)), np.zeros(BINS, np.int64)

    def count(common, a, b):
        least = NUMERATOR / DENOMINATOR
        at = np.asarray((common / (a + b - common) - least) / (1 - least) * BINS)
        bins[:] += np.bincount(np.clip(at.astype(int).ravel(), 0, BINS - 1), minlength=BINS)

    for t in tries:
        order = np.argsort(keys[:, t], kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order, t])) + 1
        for bucket in np.split(order, cuts):
            if len(bucket) < 2:
                continue
            bucket = np.sort(bucket)
            new = np.triu(np.ones((len(bucket), len(bucket)), bool), 1)
            for earlier in range(t):
                k = keys[bucket, earlier]
                new &= k[:, None] != k[None, :]
            for k in done[bucket].T if done is not None and new.any() else ():
                new &= k[:, None] != k[None, :]
            if block is not None:
                new &= block[bucket][:, None] != block[bucket][None, :]
            pairs = np.argwhere(new) if new.any() else ()
            if not len(pairs):
                continue
            if len(pairs) <= 4 * len(bucket):
                for i, j in pairs.tolist():
                    i, j = bucket[i], bucket[j]
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if similar(common, sizes[i], sizes[j]):
                        links[i] += copies[j]
                        links[j] += copies[i]
                        groups.join(int(i), int(j))
                        count(common, sizes[i], sizes[j])
                continue
            own = [sets[i] for i in bucket]
            common = common_counts(own, own)
            good, n = new, sizes[bucket]
            for low in range(0, len(bucket), LINES):  # lines of the matrices, so that what is made of them stays small
                part = slice(low, low + LINES)
                good[part] &= similar(common[part], n[part, None], n[None, :])
                at = np.nonzero(good[part])
                count(common[part][at], n[part][at[0]], n[at[1]])
            del common
            good |= good.T
            links[bucket] += good @ copies[bucket]
            left = good.any(axis=1)
            while left.any():  # groups within the bucket, each from its first member on
                reached = np.zeros(len(bucket), bool)
                reached[np.argmax(left)] = True
                front = reached.copy()
                while front.any():
                    front = good[front].any(axis=0) & ~reached
                    reached |= front
                members = bucket[reached].tolist()
                for i in members[1:]:
                    groups.join(members[0], i)
                left &= ~reached
    return links, [groups.find(i) for i in range(len(sets))], bins


def row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits that tell an id with a text."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("r1"), F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col)).alias("r2")]


def sign(docs: DataFrame, id_col: str, text_col: str, trees: int) -> DataFrame:
    """id, r1 and r2 (the row's key), s1 and s2 (the set's key), n (its size), signed (its signature; all of them null or 0 without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            n, s1, s2, signed = (np.zeros(batch.num_rows, np.int64) for _ in range(4))
            signed, held, size = [None] * batch.num_rows, {}, 0

            def flush():
                if held:
                    for i, row in zip(held, signatures(list(held.values()), trees)):
                        signed[i] = row.astype(">u2").tobytes()

            for i, text in enumerate(batch.column(3).to_pylist()):
                s = shingles(text)
                if len(s):
                    n[i], (s1[i], s2[i]), held[i] = len(s), set_key(s), s
                    size += len(s)
                    if size >= SIGNED:
                        flush()
                        held, size = {}, 0
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, (s1, s2, n)), pa.array(signed, pa.binary())], names=["id", "r1", "r2", "s1", "s2", "n", "signed"])

    own = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), F.col(text_col).alias("t"))
    return own.mapInArrow(run, f"id {dict(own.dtypes)['id']}, r1 long, r2 long, s1 long, s2 long, n long, signed binary")


def components(edges: DataFrame) -> DataFrame:
    """node, group (its least node) of the nodes of edges (a, b), by alternating large and small stars; checkpointed."""
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        edges = checkpointed(small.where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("group")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("group")).distinct())


def met(nodes: DataFrame, trees: int, depth: int) -> DataFrame:
    """node, root: the group of each node among those of its chunk, and what connects groups, as edges (a, b), in one table: a, b, edge.

    In each chunk the signatures are sorted trie by trie, and neighbours of a common prefix are joined. A prefix
    goes on to the other chunks once, with the root of its nodes.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_pylist()))
            n += batch.num_rows
            if n >= CHUNK_NODES:
                yield from tries_of(held)
                held, n = [], 0
        if n:
            yield from tries_of(held)

    def tries_of(held) -> Iterator[pa.RecordBatch]:
        node = np.concatenate([h[0] for h in held])
        keys = prefixes(signature_of([x for h in held for x in h[1]], trees), depth)
        groups, firsts = Groups(len(node)), []
        for t in range(trees):
            order = np.argsort(keys[:, t], kind="stable")
            same = np.r_[False, keys[order[1:], t] == keys[order[:-1], t]]
            for i in np.flatnonzero(same).tolist():
                groups.join(int(order[i - 1]), int(order[i]))
            firsts.append(order[~same])
        root = np.array([groups.find(i) for i in range(len(node))])
        yield as_batch([node], [node[root]], [np.full(len(node), -1)])
        for t, at in enumerate(firsts):
            yield as_batch([node[root[at]]], [keys[at, t]], [np.full(len(at), t)])

    def as_batch(*cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], names=["a", "b", "trie"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, key, lead = None, None, None
        for batch in batches:
            edges = set()
            for t, k, root in zip(*[c.to_pylist() for c in batch.columns]):
                if (t, k) != (trie, key):
                    trie, key, lead = t, k, root
                elif root != lead:
                    edges.add((root, lead))
            a, b = zip(*edges) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    first = checkpointed(nodes.select("node", "signed").mapInArrow(chunks, "a long, b long, trie long"))
    shared = first.where("trie >= 0").select("trie", F.col("b").alias("key"), F.col("a").alias("root"))
    edges = components(shared.repartition("trie", "key").sortWithinPartitions("trie", "key", "root").mapInArrow(across, "a long, b long"))
    own = first.where("trie < 0").select(F.col("a").alias("node"), F.col("b").alias("root"))
    moved = edges.select(F.col("node").alias("root"), "group")
    return own.join(few(moved), "root", "left").select("node", F.coalesce("group", "root").alias("group"))


def compared(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, trees: int, depth: int, before: int | None, unit_nodes: int, unit_shingles: int) -> DataFrame:
    """node, links, lead: of the pairs that meet at depth, but not at the depth before; node below 0: links by bin of similarity (-1 - bin)."""
    group_of = checkpointed(met(nodes, trees, depth))
    sizes = checkpointed(group_of.join(nodes.select("node", "n"), "node").groupBy("group").agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles")).where("nodes > 1"))
    large = (F.col("nodes") > unit_nodes) | (F.col("shingles") > unit_shingles)
    members = group_of.join(few(sizes.select("group", large.alias("large"))), "group").join(nodes.select("node", "r1", "r2", "copies", "signed"), "node")
    whole = F.array(F.struct(F.concat(F.lit("g"), F.col("group").cast("string")).alias("unit"), F.lit(-1).alias("trie"), F.lit(0).alias("block"), F.lit(False).alias("across")))
    has_large = not sizes.where(large).isEmpty()
    if has_large:
        # each prefix of such a group; blocks of half a unit, and pairs of blocks
        members = checkpointed(members)
        prefix = F.expr(f"substring(signed, {2 * DEPTH_MOST} * trie + 1, {2 * depth})").alias("key")
        exploded = members.where("large").select("node", "signed", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("trie")).select("node", "trie", prefix)
        exploded = exploded.join(nodes.select("node", "n"), "node")
        parts = exploded.groupBy("trie", "key").agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles")).where("nodes > 1")
        blocks = F.ceil(F.greatest(2 * F.col("nodes") / unit_nodes, 2 * F.col("shingles") / unit_shingles)).cast("int")
        parts = parts.withColumn("blocks", F.when(large, blocks).otherwise(1)).select("trie", "key", "blocks")
        cut = exploded.select("node", "trie", "key").join(few(parts), ["trie", "key"])
        cut = cut.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        name = F.concat_ws(":", F.lit("b"), "trie", F.hex("key"))
        cut = cut.withColumn("units", F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
            F.concat_ws(":", name, F.least(o, F.col("block")).cast("string"), F.greatest(o, F.col("block")).cast("string")).alias("unit"),
            F.col("trie").cast("int").alias("trie"), F.col("block").alias("block"), (o != F.col("block")).alias("across"))))
        units = cut.groupBy("node").agg(F.flatten(F.collect_list("units")).alias("units"))
        members = members.where("not large").withColumn("units", whole).drop("large", "group").unionByName(members.where("large").join(units, "node").drop("large", "group"))
    else:
        members = members.withColumn("units", whole).drop("large", "group")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last = Shingler(), None
        for batch in batches:
            own, good = [], []
            for text, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                good.append(node != last)  # identical rows follow one another; the rest is found when units are read
                own.append(shingles(text).tobytes() if node != last else b"")
                last = node
            out = pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(own, pa.binary())], names=["node", "copies", "signed", "units", "own"])
            yield out.filter(pa.array(good, pa.bool_()))

    members = checkpointed(members)
    texts = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("t")).join(few(members.select("r1", "r2")), ["r1", "r2"], "left_semi")  # few: other texts aren't shuffled
    texts = texts.join(members, ["r1", "r2"]).select("t", "node", "copies", "signed", "units")
    dealt = texts.mapInArrow(sets, "node long, copies long, signed binary, units array<struct<unit:string,trie:int,block:int,across:boolean>>, own binary")
    dealt = dealt.select("node", "copies", "signed", "own", F.explode("units").alias("u")).select("u.unit", "u.trie", "u.block", "u.across", "node", "copies", "signed", "own")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(BINS, np.int64)

        def done(rows):
            rows = sorted({r[4]: r for r in rows}.values(), key=lambda r: r[4])
            if len(rows) > 1:
                node, (_, trie, _, across) = [r[4] for r in rows], rows[0][:4]
                signed = signature_of([r[6] for r in rows], trees)
                earlier = prefixes(signed, before) if before else None
                links, lead, more = link(
                    [np.frombuffer(r[7], np.uint64) for r in rows], prefixes(signed, depth), earlier, np.array([r[5] for r in rows]),
                    list(range(trees)) if trie < 0 else [trie], np.array([r[2] for r in rows]) if across else None,
                )
                bins[:] += more
                found.extend((x, int(n), node[i]) for x, n, i in zip(node, links, lead) if n)

        held, found = [], []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[-1][0] != row[0]:
                    done(held)
                    held = []
                held.append(row)
            if len(found) > 1000:
                yield as_batch(found)
                found = []
        if held:
            done(held)
        yield as_batch(found + [(-1 - i, int(n), 0) for i, n in enumerate(bins) if n])

    def as_batch(found):
        cols = list(zip(*found)) if found else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "links", "lead"])

    return checkpointed(dealt.repartition("unit").sortWithinPartitions("unit").mapInArrow(verify, "node long, links long, lead long"))


def classes(docs: DataFrame, id_col: str, text_col: str, trees: int, recall: float, unit_nodes: int, unit_shingles: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and of each set: s1, s2, copies, copy_id, class_id, n_links, and at (r1 and r2 of the row that its class keeps)."""
    bounded_batches(docs.sparkSession)
    base = checkpointed(sign(docs, id_col, text_col, trees))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "r1", "r2")).alias("first")
    nodes = base.where("n > 0").groupBy("s1", "s2").agg(first, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("signed").alias("signed"))
    nodes = checkpointed(nodes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "first", "first.r1", "first.r2", "copies", "n", "signed"))
    depth, before, found = DEPTH_MOST, None, []
    while True:
        found.append(compared(docs, nodes, id_col, text_col, trees, depth, before, unit_nodes, unit_shingles))
        bins = np.zeros(BINS, np.int64)
        for part in found:
            for r in part.where("node < 0").groupBy("node").agg(F.sum("links").alias("n")).collect():  # a row a bin
                bins[-1 - r["node"]] += r["n"]
        shorter = next_depth(bins, depth, trees, recall)
        if shorter == depth:
            break
        depth, before = shorter, depth
    links = found[0]
    for part in found[1:]:
        links = links.unionByName(part)
    links = links.where("node >= 0")
    group = components(links.select(F.col("node").alias("a"), F.col("lead").alias("b")))
    per = links.groupBy("node").agg(F.sum("links").alias("links"))
    members = checkpointed(nodes.drop("signed", "n").join(per, "node", "left").join(group, "node", "left").withColumn("group", F.coalesce("group", "node")))
    leads = members.groupBy("group").agg(F.min("first").alias("lead"))
    joined = members.join(leads, "group")
    return base, joined.select("s1", "s2", "copies", F.col("first.id").alias("copy_id"), F.col("lead.id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.struct("lead.r1", "lead.r2").alias("at"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, recall: float = RECALL, unit_nodes: int = UNIT_NODES, unit_shingles: int = UNIT_SHINGLES) -> DataFrame:
    """id, class_id (least id of those it is linked to directly or by way of others), copy_id (least id of an equal set), n_links (other rows of the threshold's similarity or more)."""
    base, sets = classes(docs, id_col, text_col, trees, recall, unit_nodes, unit_shingles)
    sets = checkpointed(sets.drop("at"))
    hot = F.col("copies") > max(COPIES, base.count() // SHARE)
    rows, alone = base.where("n > 0").select("id", "s1", "s2"), base.where("n = 0")
    held = F.broadcast(sets.where(hot))  # fewer than SHARE rows
    out = rows.join(held, ["s1", "s2"]).unionByName(rows.join(held.select("s1", "s2"), ["s1", "s2"], "left_anti").join(sets.where(~hot), ["s1", "s2"]))
    out = out.select("id", "class_id", "copy_id", "n_links").unionByName(alone.select("id", F.col("id").alias("class_id"), F.col("id").alias("copy_id"), F.lit(0).cast("long").alias("n_links")))
    return out.withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that of the least id (null last), and all rows without words."""
    base, sets = classes(docs, id_col, text_col, TREES, RECALL, UNIT_NODES, UNIT_SHINGLES)
    stay = sets.select("at.r1", "at.r2", F.lit(True).alias("stay"))
    keys = base.where("n > 0").groupBy("r1", "r2").count().join(stay, ["r1", "r2"], "left")
    some = checkpointed(keys.where("stay is null or count > 1"))  # of rows that go, and of rows identical in id and text
    row = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), *row_key(id_col, text_col))
    kept = row.join(few(some.select("r1", "r2")), ["r1", "r2"], "left_anti")
    same = checkpointed(some.where("stay").select("r1", "r2"))
    if not same.isEmpty():
        one = row.join(few(same), ["r1", "r2"], "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("r1", "r2").orderBy("r1"))).where("k = 1").drop("k")
        kept = kept.unionByName(one)
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
