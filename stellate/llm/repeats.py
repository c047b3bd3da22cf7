"""Removal of repeated 100-byte strings by prefix-free parsing.

Triggers, GRAM bytes whose rolling hash is divisible by MODULUS, end the phrases of every text. A string of
LENGTH bytes is told by its first trigger: what comes before it, back to the string's start, is a suffix of the
phrase that the trigger ends, and what follows it is the beginning of the parse's next phrases. (A string
without any trigger takes its gram of least hash, the leftmost of equals, so no phrase is longer than a
string sees.) What is chosen depends on the string's bytes only: equal strings have equal triggers at equal
places. Of a phrase that occurs again with all that its strings see, every string but those of the first
occurrence has an earlier copy, whatever its length: highly repetitive text collapses here.

The distinct phrases are dealt out by trigger. Those of a trigger have two suffix arrays with longest common
prefixes: of the dictionary (the phrases, read back from the trigger, as equal suffixes end alike) and of the
parse (what follows the trigger, as far as strings see). The two are combined into the order of the corpus's
strings: of equal dictionary suffixes those with equal parse beginnings stand together, in corpus order (id,
then place), and all but the first of them are marked. The hash decides where phrases are cut, never whether
strings are equal, save for phrases of equal trigger and context, which are told apart by two hashes of 64
bits, and for the strings of hot triggers (128 bits).

A hot trigger is thinned before the shuffle: within a task only the first of equal phrases goes on. After it,
phrases are sorted by Spark, which spills, and read as a stream. A trigger of more than HOT distinct phrases is
dealt out string by string instead, thinned and sorted the same way, so no task holds more of one trigger.

Defined cases: a null text is empty; null ids are first, ids other than integers count by their order; rows of
equal (or null) id are told apart by 80 bits of hashes of their texts, and have the order of these; identical
rows are one occurrence, with the same result each; an empty table gives an empty result; other columns are
ignored by the query and kept by drop_repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellate.llm.common import bounded_batches, checkpointed, few, scratch, write_scratch
from stellate.llm.near_copies import mixed

LENGTH, GRAM, MODULUS = 100, 32, 32
SPAN, REST = LENGTH - GRAM + 1, LENGTH - GRAM
#: Bytes that are cut at once; phrases that a task gathers before it thins them.
CHUNK, GATHERED = 1 << 21, 1_000_000
#: pack: 16 bits of a hash of the text, 34 of the first string's place, 7 of the bytes from there to the trigger, 7 of the number of strings (0: a mark).
PLACE_BITS, SMALL_BITS = 34, 7
#: Phrases ranked at once; a trigger of more than HOT distinct phrases is spread by its strings instead.
RANKED, HOT = 50_000, 2_000
BYTE_HASHES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on."""
    h, size, factor = BYTE_HASHES[raw], 1, np.uint64(0x9E3779B97F4A7C15)
    while size < GRAM:
        h = h[:-size] * factor + h[size:]
        factor, size = factor * factor, 2 * size
    return h


def least_in_span(h: np.ndarray) -> np.ndarray:
    """Place of the least of each SPAN hashes, the leftmost of equals."""
    low, size = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * size <= SPAN:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    low = np.minimum(low[: len(low) - (SPAN - size)], low[SPAN - size :])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def triggers(h: np.ndarray) -> np.ndarray:
    """Place of the trigger of each string, from the hashes of all grams: the first that is divisible, else the least."""
    n = len(h) - SPAN + 1
    ends = np.flatnonzero(h & np.uint64(MODULUS - 1) == 0)
    at = np.repeat(np.r_[ends, 2 * len(h)], np.diff(np.r_[-1, ends, len(h) - 1]))[:n]
    lack = at >= np.arange(n) + SPAN
    first, last = np.flatnonzero(lack & np.r_[True, ~lack[:-1]]), np.flatnonzero(lack & np.r_[~lack[1:], True])
    if len(first):
        # the grams of strings without a trigger, one stretch after another
        size = last - first + SPAN
        offset = np.r_[0, np.cumsum(size)[:-1]]
        grams = np.arange(size.sum()) + np.repeat(first - offset, size)
        least = least_in_span(h[grams])
        inside = np.arange((last - first + 1).sum()) + np.repeat(offset - np.r_[0, np.cumsum(last - first + 1)[:-1]], last - first + 1)
        at[lack] = grams[least[inside]]
    return at


def phrases(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Trigger's hash and place, place of the first string and number of strings of each phrase; raw holds texts that end at ends."""
    if len(raw) < LENGTH:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    with np.errstate(over="ignore"):
        h = mixed(gram_hashes(raw))
    at = triggers(h)  # of each string
    fits = np.ones(len(at), bool)
    for end in ends.tolist():
        fits[max(0, end - LENGTH + 1) : end] = False
    first = fits & np.r_[True, (at[1:] != at[:-1]) | ~fits[:-1]]
    begin = np.flatnonzero(first)
    stop = np.flatnonzero(fits & np.r_[(at[1:] != at[:-1]) | ~fits[1:], True])
    return h[at[begin]], at[begin], begin, stop - begin + 1


def merged(owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of the intervals of each owner, where they overlap or touch; owners are 0 to n - 1."""
    if not len(low):
        return owner, low, high
    order = np.lexsort((low, owner))
    owner, low, high = owner[order], low[order], high[order]
    span = int(high.max()) + 2
    reach = np.maximum.accumulate(owner * span + high)  # the next owner's bounds are above all of this one's
    first = np.r_[True, owner[1:] * span + low[1:] > reach[:-1]]
    begin = np.flatnonzero(first)
    return owner[begin], low[begin], (reach - owner * span)[np.r_[begin[1:] - 1, len(low) - 1]]


def repeated_rows(keys: list[np.ndarray], doc: np.ndarray, tie: np.ndarray, pack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by keys, doc, tie and pack; in that order, whether a row comes after another occurrence of equal keys."""
    order = np.lexsort((pack.view(np.uint64), tie, doc, *keys[::-1]))
    equal = np.r_[False, np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])] if len(order) else np.empty(0, bool)
    begin = np.maximum.accumulate(np.where(~equal, np.arange(len(order)), 0))
    d, t, p = doc[order], tie[order], pack[order]
    return order, equal & ((d != d[begin]) | (t != t[begin]) | (p != p[begin]))


def unpacked(pack: np.ndarray) -> tuple[np.ndarray, ...]:
    """More, place, before and count."""
    u, small = pack.view(np.uint64), np.uint64(SMALL_BITS)
    return tuple(x.astype(np.int64) for x in (u >> np.uint64(48), u >> 2 * small & np.uint64((1 << PLACE_BITS) - 1), u >> small & np.uint64(127), u & np.uint64(127)))


def packed(more, place, before, count) -> np.ndarray:
    return (more << 48 | place << 2 * SMALL_BITS | before << SMALL_BITS | count).astype(np.int64)


def owners(*who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text of each row (told by doc, tie and more), and a row of each text."""
    order = np.lexsort(who[::-1])
    new = np.r_[True, np.logical_or.reduce([w[order][1:] != w[order][:-1] for w in who])]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def thinned(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """(trigger, context, doc, tie, pack) without those that occur earlier among them, which become marks."""
    trigger, context, doc, tie, pack = (np.concatenate(c) for c in zip(*held))
    order, again = repeated_rows([trigger, context], doc, tie, pack)
    keep, lose = order[~again], order[again]
    out = [trigger[keep].view(np.int64), context[keep].view(np.int64), doc[keep], tie[keep], pack[keep]]
    if len(lose):
        more, place, _, count = unpacked(pack[lose])
        number, of = owners(doc[lose], tie[lose], more)
        number, low, high = merged(number, place, place + count + LENGTH - 1)
        whose, none = of[number], np.zeros(len(low), np.int64)
        marks = [mixed((doc[lose][whose] + low).astype(np.uint64)).view(np.int64), high, doc[lose][whose], tie[lose][whose], packed(more[whose], low, none, none)]
        out = [np.concatenate(x) for x in zip(out, marks)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["trigger", "context", "doc", "tie", "pack"])


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, tie, more, text -> trigger, context, doc, tie, pack: the phrases of all texts, but marks of those that occur earlier in the task."""
    held, gathered = [], 0
    for batch in batches:
        docs, ties, mores = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
        texts = [t.encode() if t else b"" for t in batch.column(3).to_pylist()]
        at = 0
        while at < len(texts):
            size, upto = 0, at
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= CHUNK):
                size += len(texts[upto])
                upto += 1
            raw = b"".join(texts[at:upto])
            ends = np.cumsum([len(t) for t in texts[at:upto]])
            for low in range(0, max(1, len(raw)), CHUNK):  # a longer text in parts; strings that begin in a part are the part's
                part = raw[low : low + CHUNK + LENGTH - 1] if len(raw) > CHUNK else raw
                trigger, at_trigger, begin, count = phrases(np.frombuffer(part, np.uint8), np.minimum(ends - low, len(part)))
                context = np.fromiter(map(xxhash.xxh3_64_intdigest, [part[i:j] for i, j in zip(begin.tolist(), (begin + count + LENGTH - 1).tolist())]), np.uint64, len(begin))
                text = np.searchsorted(ends, begin + low, "right")
                held.append((trigger, context, docs[at:upto][text], ties[at:upto][text], packed(mores[at:upto][text], begin + low - np.r_[0, ends][text], at_trigger - begin, count)))
                gathered += len(begin)
            at = upto
        if gathered >= GATHERED:
            yield thinned(held)
            held, gathered = [], 0
    if gathered:
        yield thinned(held)


def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases sorted by trigger, context and corpus order -> doc, tie, more, low, high, before, trigger: marks (trigger 0) and, of triggers with several phrases, each one's first place.

    Batch by batch: all that is kept of a trigger, however many phrases it has, is the first place of its last phrase.
    """
    last = [np.empty(0, np.int64) for _ in range(5)]  # trigger, context, doc, tie and pack of that place
    waits = False  # it is its trigger's only phrase so far, and so isn't given out yet
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        trigger, context, doc, tie, pack = columns
        more, place, _, count = unpacked(pack)
        marks, keep = np.flatnonzero(count == 0), np.flatnonzero(count)
        out = [(doc[marks], tie[marks], more[marks], place[marks], context[marks], 0 * place[marks], 0 * place[marks])]
        if len(keep):
            carried = len(last[0])
            trigger, context, doc, tie, pack = (np.r_[x, c[keep]] for x, c in zip(last, columns))
            more, place, before, count = unpacked(pack)
            fresh = np.r_[True, (trigger[1:] != trigger[:-1]) | (context[1:] != context[:-1])]
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
            lose = np.flatnonzero((doc != doc[begin]) | (tie != tie[begin]) | (pack != pack[begin]))  # identical rows are one occurrence
            none = 0 * lose
            out.append((doc[lose], tie[lose], more[lose], place[lose], (place + count + LENGTH - 1)[lose], none, none))
            first = np.flatnonzero(fresh)
            same = trigger[first][1:] == trigger[first][:-1]
            several = np.r_[False, same] | np.r_[same, False]
            if carried:
                several[0] &= waits
            give = first[several]
            out.append((doc[give], tie[give], more[give], place[give], (place + count)[give], before[give], np.where(trigger[give] == 0, 1, trigger[give])))
            # only a phrase that stands alone in its trigger waits; one that was carried over after being given out doesn't wait again
            waits = bool(waits and not several[0]) if carried and len(first) == 1 else not (len(same) and same[-1])
            last = [c[first[-1:]] for c in (trigger, context, doc, tie, pack)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["doc", "tie", "more", "low", "high", "before", "trigger"])


def placed(batches: Iterator[pa.RecordBatch], hot: bool) -> Iterator[list[tuple]]:
    """doc, tie, more, text, places -> (trigger, doc, tie, more, low, before, the phrase with all that its strings see); of identical rows that follow one another only the first's."""
    last = None
    for batch in batches:
        rows = []
        for doc, tie, more, text, places in zip(*[batch.column(i).to_pylist() for i in range(5)]):
            if last == (doc, tie, more):
                continue
            last = doc, tie, more
            raw = text.encode() if text else b""
            rows += [(p["trigger"], doc, tie, more, p["low"], p["before"], raw[p["low"] : p["high"] + LENGTH - 1]) for p in places if p["hot"] == hot]
        yield rows


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases of triggers that aren't hot."""
    for rows in placed(batches, False):
        cols = list(zip(*rows)) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.binary())], names=["trigger", "doc", "tie", "more", "low", "before", "what"])


def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of hot triggers, each as a phrase of its own (trigger and context: its hash), thinned as by cut."""
    held, gathered = [], 0
    for rows in placed(batches, True):
        if rows:
            _, doc, tie, more, low, _, what = zip(*rows)
            count = np.array([len(w) - LENGTH + 1 for w in what])
            hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w[i : i + LENGTH]) for w in what for i in range(len(w) - LENGTH + 1)]), np.uint64).reshape(-1, 2)
            place = np.repeat(np.array(low), count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            none = np.zeros(len(place), np.int64)
            held.append((hashes[:, 0], hashes[:, 1], np.repeat(np.array(doc), count), np.repeat(np.array(tie), count), packed(np.repeat(np.array(more), count), place, none, none + 1)))
            gathered += len(place)
        if gathered >= GATHERED:
            yield thinned(held)
            held, gathered = [], 0
    if gathered:
        yield thinned(held)


def suffix_array(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by group and bytes, and how many bytes each has in common with the one before it there (-1: none, of another group)."""
    width = -(-REST // 8) * 8
    words = np.zeros((len(rows), width), np.uint8)
    words[:, :REST] = rows
    order = np.lexsort((*words.view(">u8").T[::-1], group))
    s, g = rows[order], group[order]
    same = s[1:] == s[:-1]
    common = np.where(same.all(axis=1), REST, same.argmin(axis=1))
    common[g[1:] != g[:-1]] = -1
    return order, np.r_[-1, common]


def classes(order: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """Class of each row by group and its first so many bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < length)
    return out


def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct phrases of each trigger, sorted by trigger -> doc, tie, more, low, high: marks of their strings that have an earlier copy.

    A stream: whole triggers, some RANKED phrases of them at a time, are held.
    """
    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)])
        n += batch.num_rows
        if n >= RANKED:
            columns = [np.concatenate(c) for c in zip(*held)]
            upto = int(np.searchsorted(columns[0], columns[0][-1]))  # the last trigger may go on
            if upto:
                yield from combined(*(c[:upto] for c in columns))
            held = [[c[upto:] for c in columns]]
            n = len(held[0][0])
    if n:
        yield from combined(*(np.concatenate(c) for c in zip(*held)))


def combined(trigger, doc, tie, more, low, before, what) -> Iterator[pa.RecordBatch]:
    """Marks, from the suffix arrays of the dictionary and of the parse, combined into corpus order."""
    order = np.lexsort((low, more, tie, doc, trigger))
    trigger, doc, tie, more, low, before, what = (c[order] for c in (trigger, doc, tie, more, low, before, what))
    fresh = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in (trigger, doc, tie, more, low, what)])]  # identical rows are one occurrence
    doc, tie, more, low, before, what = (c[fresh] for c in (doc, tie, more, low, before, what))
    n = len(doc)
    phrase, parse, after = np.zeros((n, REST), np.uint8), np.zeros((n, REST), np.uint8), np.empty(n, np.int64)
    for i in range(n):
        raw, k = what[i], int(before[i])
        phrase[i, :k] = np.frombuffer(raw[:k][::-1], np.uint8)
        tail = raw[k + GRAM :]
        parse[i, : len(tail)] = np.frombuffer(tail, np.uint8)
        after[i] = len(tail)
    grams = np.unique(np.array([w[int(k) : int(k) + GRAM].hex() for w, k in zip(what, before)]), return_inverse=True)[1]  # the trigger itself, not its hash
    dictionary, following = suffix_array(phrase, grams), suffix_array(parse, grams)
    who, where = [], []
    for x in range(REST + 1):  # strings with x bytes before the trigger
        has = np.flatnonzero((before >= x) & (after >= REST - x))
        if len(has) < 2:
            continue
        pair = classes(*dictionary, x)[has] * (n + 1) + classes(*following, REST - x)[has]
        by = np.argsort(pair, kind="stable")  # equal strings side by side, in corpus order
        again = np.r_[False, pair[by][1:] == pair[by][:-1]]
        who.append(has[by[again]])
        where.append(before[has[by[again]]] - x + low[has[by[again]]])
    if not who:
        return
    who, where = np.concatenate(who), np.concatenate(where)
    who, begin, end = merged(who.astype(np.int64), where.astype(np.int64), where.astype(np.int64) + LENGTH)
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc[who], tie[who], more[who], begin, end)], names=["doc", "tie", "more", "low", "high"])


def with_order(docs: DataFrame, id_col: str) -> tuple[DataFrame, Column]:
    """docs, and a number that orders its rows as their ids; ids that aren't integers are numbered by a range sort and joined."""
    kind, lowest = dict(docs.dtypes)[id_col], F.lit(-(1 << 63)).cast("long")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return docs, F.coalesce(F.col(f"`{id_col}`").cast("long"), lowest)
    names = {c.lower() for c in docs.columns}
    key, number = ("_" * (1 + max(map(len, names))) + x for x in ("key", "number"))  # longer than any column's name
    ids = docs.select(F.col(f"`{id_col}`").alias(key)).where(F.col(key).isNotNull()).distinct().repartitionByRange(key)
    ids = checkpointed(ids.withColumn("p", F.spark_partition_id()))
    before = ids.groupBy("p").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    within = F.row_number().over(Window.partitionBy("p").orderBy(key))
    numbered = ids.withColumn("n", within).join(F.broadcast(before.select("p", "before")), "p").select(key, (F.col("n") + F.col("before")).alias(number))
    return docs.join(numbered, F.col(f"`{id_col}`") == F.col(key), "left"), F.coalesce(F.col(number), lowest)


def with_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """text, marks (intervals of bytes to remove; null: none) and a struct rest of the id and the other columns (c0, c1, ...) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ordered, doc = with_order(docs, id_col)
    row = ["doc", "tie", "more"]
    own = ordered.select(
        doc.alias("doc"), F.xxhash64(text_col).alias("tie"), F.pmod(F.xxhash64(F.lit(1), F.col(text_col)), F.lit(65536)).alias("more"), F.col(text_col).alias("text"),
        F.struct(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("rest"),
    )
    cut_schema, schema = "trigger long, context long, doc long, tie long, pack long", "doc long, tie long, more long, low long, high long, before long, trigger long"
    in_order = ["trigger", "context", "doc", "tie", F.shiftrightunsigned("pack", 48), "pack"]

    def matched(cut_up: DataFrame) -> DataFrame:
        path = scratch(spark, "repeats")
        write_scratch(cut_up.repartition("trigger").sortWithinPartitions(*in_order).mapInArrow(match, schema), path)
        return spark.read.schema(schema).parquet(path)

    found = matched(own.select(*row, "text").mapInArrow(cut, cut_schema))
    counts = found.where("trigger <> 0").groupBy("trigger").count().where(F.col("count") > hot).select("trigger", F.lit(True).alias("hot"))
    counts = checkpointed(counts)
    has_hot = not counts.isEmpty()
    at = found.where("trigger <> 0")
    at = at.join(few(counts), "trigger", "left").withColumn("hot", F.coalesce("hot", F.lit(False))) if has_hot else at.withColumn("hot", F.lit(False))
    places = at.groupBy(*row).agg(F.collect_list(F.struct("low", "high", "before", "trigger", "hot")).alias("places"))
    # rest isn't needed here; with it this shuffle of the texts is the one of the last join, and is done once
    placed_texts = own.join(places, row).select(*row, "text", "places", "rest")
    phrases_of = placed_texts.mapInArrow(contexts, "trigger long, doc long, tie long, more long, low long, before long, what binary")
    marks = found.where("trigger = 0").select(*row, "low", "high")
    if has_hot:
        marks = marks.unionByName(matched(placed_texts.mapInArrow(strings, cut_schema)).where("trigger = 0").select(*row, "low", "high"))
    marks = marks.unionByName(phrases_of.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(rank, "doc long, tie long, more long, low long, high long"))
    marks = marks.groupBy(*row).agg(F.collect_list(F.struct("low", "high")).alias("marks"))
    return own.join(marks, row, "left").select("rest", "text", "marks")


def spans(marks: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Maximal removed runs."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((m["low"], min(m["high"], size)) for m in marks or ()):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def kept_bytes(raw: bytes, removed: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for low, high in removed:
        out.append(raw[at:low])
        at = high
    return b"".join([*out, raw[at:]])


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode() if text else b""
                removed = spans(marks, len(raw))
                rows.append((len(raw), sum(b - a for a, b in removed), len(removed), hashlib.sha256(kept_bytes(raw, removed)).hexdigest()))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=names)

    kind = dict(docs.dtypes)[id_col]
    return with_marks(docs, id_col, text_col, (), hot).select("rest.id", "text", "marks").mapInArrow(digest, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the bytes of repeats taken out of the texts, and characters that lost some of their bytes; all rows and columns stay."""
    others = tuple(c for c in docs.columns if c not in (id_col, text_col))
    marked = with_marks(docs, id_col, text_col, others).select("rest", "text", "marks")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode() if text else b""
                texts.append(text if not marks else kept_bytes(raw, spans(marks, len(raw))).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["rest", "text"])

    out = marked.mapInArrow(strip, marked.select("rest", "text").schema)
    return out.select(*[F.col("text").alias(text_col) if c == text_col else F.col("rest.id").alias(id_col) if c == id_col else F.col("rest")[f"c{others.index(c)}"].alias(c) for c in docs.columns])
