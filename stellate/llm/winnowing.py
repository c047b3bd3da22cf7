"""Benchmark passages in documents by winnowing, in DataFrame operations only.

Every GRAM consecutive words have a hash; of each SPAN consecutive hashes the least is kept as a
fingerprint. A passage shared by an item and a document that has GRAM + SPAN - 1 = WINDOW words or more
holds a whole such run of hashes, so both keep the same fingerprint of it: no shared window is missed.
Around the places of a document where a fingerprint of an item stands, whole windows are compared as text,
so hash collisions add nothing. Items of fewer than WINDOW words are one window each; they are anchored by
their first word instead.

The fingerprints of the benchmark are part of the plan while there are LITERALS_MOST or fewer, and its
windows are broadcast while there are WINDOWS_MOST or fewer, of WINDOW_BYTES_MOST or less; beyond, both are
joined by shuffle.

Defined cases: null or empty texts have no words and no hits; null item ids read ``null``; items of equal id
count once; repeated rows are kept, each with its own result; empty tables give empty or clean results;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellate.llm.common import checkpointed, of_other_texts, text_key
from stellate.llm.urls import LOWER, UPPER

#: with_hashes builds just these lengths.
GRAM, SPAN = 6, 5
WINDOW = GRAM + SPAN - 1
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LITERALS_MOST, WINDOWS_MOST, WINDOW_BYTES_MOST = 20_000, 200_000, 64 << 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _ahead(one: str, other: str, by: int, value: str) -> Column:
    """value of each element a of one and the element b of other that stands by places further; what has no partner is cut off later."""
    return F.expr(f"zip_with({one}, slice({other}, {by + 1}, greatest(0, size({other}) - {by})), (a, b) -> {value})")


def with_hashes(df: DataFrame) -> DataFrame:
    """Adds hashes (of all grams of words, in order) and prints (the distinct fingerprints).

    Grams and spans are put together from ones half as long, so the time is linear in the text.
    """
    hash_, least = "xxhash64(a, b)", "least(a, b)"
    df = df.withColumn("h1", F.expr("transform(words, w -> xxhash64(w))")).withColumn("h2", _ahead("h1", "h1", 1, hash_)).withColumn("h4", _ahead("h2", "h2", 2, hash_))
    df = df.withColumn("h6", _ahead("h4", "h2", 4, hash_)).withColumn("hashes", F.expr(f"slice(h6, 1, greatest(0, size(words) - {GRAM - 1}))"))
    df = df.withColumn("m2", _ahead("hashes", "hashes", 1, least)).withColumn("m4", _ahead("m2", "m2", 2, least)).withColumn("m5", _ahead("m4", "hashes", 4, least))
    df = df.withColumn("prints", F.expr(f"array_distinct(slice(m5, 1, greatest(0, size(hashes) - {SPAN - 1})))"))
    return df.drop("h1", "h2", "h4", "h6", "m2", "m4", "m5")


def _joined(size: int) -> str:
    """SQL for the size words from place i on, joined."""
    return f"concat_ws(' ', {', '.join(f'words[i + {k - 1}]' for k in range(size))})"


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, window: the distinct windows of every item, as text."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0")
    starts = F.expr(f"transform(sequence(1, greatest(1, size(words) - {WINDOW - 1})), i -> array_join(slice(words, i, {WINDOW}), ' '))")
    return words.select("item", F.explode(starts).alias("window")).distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", literals_most: int = LITERALS_MOST, windows_most: int = WINDOWS_MOST) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated and items (their ids, sorted) of every row of docs."""
    windows = checkpointed(item_windows(items))
    n_windows, window_bytes = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item")), F.lit(0))).first()
    prints = with_hashes(items.select(words_of(F.col("text")).alias("words"))).select(F.explode("prints").alias("print")).distinct()
    short = windows.where(f"size(split(window, ' ')) < {WINDOW}").select(F.expr("size(split(window, ' '))").alias("size"), F.substring_index("window", " ", 1).alias("anchor")).distinct()
    n_short = short.count()

    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    literals = [r[0] for r in prints.limit(literals_most + 1).collect()]
    if len(literals) <= literals_most:
        known = f"in ({', '.join(map(str, literals or [0]))})"
        work = with_hashes(base.select("rid", "id", words_of(F.col("text")).alias("words")))
        work = work.withColumn("found", F.expr(f"filter(prints, x -> x {known})"))
        is_found = f"hashes[i - 1] {known}"
    else:
        is_found = "array_contains(found, hashes[i - 1])"
        base = checkpointed(base)
        one = with_hashes(base.select("rid", words_of(F.col("text")).alias("words"))).select("rid", F.explode("prints").alias("print"))
        found = one.join(prints, "print").groupBy("rid").agg(F.collect_set("print").alias("found"))
        work = with_hashes(base.join(found, "rid", "left").select("rid", "id", words_of(F.col("text")).alias("words"), F.coalesce("found", F.expr("cast(array() as array<bigint>)")).alias("found")))

    # starts of the windows that hold a gram found at i: from i - SPAN + 1 to i, where a whole window fits
    near = f"""case when size(found) > 0 and size(words) >= {WINDOW} then transform(array_distinct(flatten(transform(
        filter(sequence(1, size(hashes)), i -> {is_found}),
        i -> sequence(greatest(1, least(i, size(words) - {WINDOW - 1}) - {SPAN - 1}), least(i, size(words) - {WINDOW - 1}))))),
        i -> struct(i as at, {WINDOW} as size, {_joined(WINDOW)} as window)) end"""
    empty = "cast(array() as array<struct<at:int,size:int,window:string>>)"
    places = [f"coalesce({near}, {empty})"]
    if n_short:
        if n_short <= literals_most:
            sizes: dict[int, list[str]] = {}
            for r in short.collect():
                sizes.setdefault(r["size"], []).append(r["anchor"])
            anchors = [(n, " and words[i - 1] in (" + ", ".join(f"'{a}'" for a in firsts) + ")") for n, firsts in sizes.items()]
        else:
            anchors = [(r["size"], "") for r in short.select("size").distinct().collect()]
        places += [f"transform(filter(sequence(1, size(words)), i -> size(words) > 0 and i + {n - 1} <= size(words){also}), i -> struct(i as at, {n} as size, {_joined(n)} as window))" for n, also in anchors]
    work = work.select("rid", "id", F.size("words").cast("long").alias("n_words"), F.explode_outer(F.expr(f"concat({', '.join(places)})")).alias("place"))
    work = work.select("rid", "id", "n_words", "place.at", "place.size", F.coalesce("place.window", F.concat(F.lit("\x01"), F.col("rid").cast("string"))).alias("window"))
    joined = work.join(F.broadcast(windows) if n_windows <= windows_most and window_bytes <= WINDOW_BYTES_MOST else windows, "window", "left")
    hit = F.col("item").isNotNull()
    per = joined.groupBy("rid").agg(
        F.first("id").alias(id_col), F.first("n_words").alias("n_words"),
        F.collect_set(F.when(hit, F.struct("at", "size"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"),
    )
    covered = F.expr("cast(size(array_distinct(flatten(transform(spans, s -> sequence(s.at, s.at + s.size - 1))))) as long)")
    return per.select(
        id_col, "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"), "items",
    )


def clean_documents(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs without a benchmark passage, with all their columns.

    What a row holds depends on its text alone, so the texts found are told by two hashes of theirs, whatever the ids.
    """
    key = text_key(text_col)
    found = contamination(docs.select(key.alias("key"), F.col(text_col).alias("text")), items, "key", "text").where("contaminated").select("key")
    return of_other_texts(docs, found, key)


ORACLE = r"""
WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
h AS (SELECT doc_id, i, dw.size, item FROM dw JOIN iw USING (win)),
c AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
