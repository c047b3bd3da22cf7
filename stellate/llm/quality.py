"""Quality rules by distribution divergence.

Two histograms of each document are compared with references of its language: classes of characters, and
shares of common words. The distance is Jensen-Shannon's (the root of the divergence in bits, 0 to 1). A
language's references come from all its documents that pass the base rules: the median share of each class,
which junk among them hardly moves, and the summed counts of the words. The words counted are the fixed
lists below, those of all languages for every document. Small samples stray from any reference, so the limit of
characters is widened by a term that falls with the root of the number of words. The limit of words comes from
the documents of the language and of like length (a band of lengths up to twice the least): the distance times
that root has the same median at all lengths, and its lower quartile tells the spread, so that junk, which is
above the median, hardly moves the limit. Where a text as long is sure to hold common words, the limit is below
the distance of a text without any, whatever the documents reach. A document shorter than MIN_WORDS, or of a
language that has fewer than MIN_REFERENCE words in all, isn't judged by divergence.

Each row carries its own judgement: rows of equal or null id are judged apart, and no join by id is made.
The rows are written once with their counts, so that references and limits are taken from the counts alone.

Defined cases: a null text has no words, and so fails the base rules; a null language is one of its own;
repeated rows each have their row; an empty table gives an empty result; other columns are ignored by the
query and kept by keep_documents, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellate.llm.common import bounded_batches, checkpointed, scratch, write_scratch

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Limit of the characters' distance for long texts, and what it widens by at one word (falling with the root).
CHARS_LIMIT, CHARS_SLACK = 0.10, 0.2
#: Limit of the words' distance times the root of n_words: so many times median less lower quartile above the median of a band, of the
#: language where a band has fewer than MIN_BAND documents, and DEFAULT where that has, too; the least such limit, and the least of the distance.
WORDS_SPREADS, MIN_BAND, WORDS_DEFAULT, WORDS_LEAST, WORDS_FLOOR = 8, 30, 4.0, 2.0, 0.15
#: A text that should hold EXPECTED common words may reach this share of the distance of a text without any.
EXPECTED, WITHOUT_SHARE = 10, 0.95
MIN_REFERENCE = 1_000
#: Languages whose references (a KB each) are broadcast; keys that a language is spread over beyond.
BROADCAST_MOST, SALTS = 2_000, 64

# Common words by language.
COMMON_WORDS = {
    "en": "the of and to in is that for was with are this as on be by it or at from an not a have which",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an aus er",
    "fr": "de la le et les des en un du une est que pour qui dans sur au par avec il ne pas se plus ce",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
}
VOCABULARY = sorted({w for ws in COMMON_WORDS.values() for w in ws.split()})
#: Classes of characters: lower case with digits and all beyond ASCII, upper case, white space, marks, symbols, control.
CLASSES = 6
SYMBOLS = b"#*$%&|<>"


def byte_classes() -> np.ndarray:
    """Class of the character that a byte begins; CLASSES for bytes that go on with one, so that each character counts once."""
    out = np.full(256, 5, np.uint8)
    letters = b"abcdefghijklmnopqrstuvwxyz0123456789" + bytes(range(192, 256))
    for cls, members in enumerate((letters, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" \t\n\r\x0b\x0c", b".,;:!?'\"()-+=/@_[]{}~^`\\", SYMBOLS)):
        out[list(members)] = cls
    out[128:192] = CLASSES
    return out


def text_counts(raw: bytes) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words of a text."""
    words = raw.split()  # of bytes: at the six ASCII white spaces
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeated = 0
    if len(words) > 3:
        seen = Counter(zip(words, words[1:], words[2:]))
        if len(seen) < len(words) - 2:
            upto = 0  # words before it are counted or done
            for i, w in enumerate(zip(words, words[1:], words[2:])):
                if seen[w] > 1:
                    repeated += i + 3 - max(i, upto)
                    upto = i + 3
    return len(words), chars, symbols, dup, repeated, words


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Distance of two histograms, 0 to 1; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = [np.where(x > 0, x * np.log2(x / m), 0.0).sum() for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(kl) / 2)))


def chars_failed(n_words: int, chars: np.ndarray, ref_chars: np.ndarray) -> bool:
    return jensen_shannon(chars, ref_chars) > CHARS_LIMIT + CHARS_SLACK / np.sqrt(n_words)


def words_most(n_words: int, ref_words: np.ndarray) -> float | None:
    """What the words' distance may reach at most, by that of a text without a common word; None if such a text can be clean."""
    if n_words * (1 - ref_words[-1] / ref_words.sum()) < EXPECTED:
        return None
    without = np.zeros(len(ref_words))
    without[-1] = 1
    return WITHOUT_SHARE * jensen_shannon(without, ref_words)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = pa.struct([*[(c, pa.int64()) for c in COUNTS], ("chars", pa.list_(pa.int32())), ("words", pa.list_(pa.int32()))])
#: distance: of words (null: not judged); most: what it may reach at most (null: no bound).
MEASURES = pa.struct([("base_failed", pa.bool_()), ("chars_failed", pa.bool_()), ("distance", pa.float64()), ("most", pa.float64()), ("band", pa.int32())])
SQL_OF_STATS = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,chars:array<int>,words:array<int>>"
SQL_OF_MEASURES = "struct<base_failed:boolean,chars_failed:boolean,distance:double,most:double,band:int>"


def counted(text: Column) -> Column:
    """Counts and both histograms of a text; the last bin of words is all others."""
    fold = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalpha() else b for b in range(256))

    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classes, at = byte_classes(), {w.encode(): i for i, w in enumerate(VOCABULARY)}
        for batch in texts:
            rows = []
            for text in batch.to_pylist():
                raw = text.encode() if text else b""
                n, chars, symbols, dup, repeated, _ = text_counts(raw)
                hist = [0] * (len(at) + 1)
                for w, c in Counter(raw.translate(fold).split()).items():
                    hist[at.get(w, -1)] += c
                rows.append((n, chars, symbols, dup, repeated, np.bincount(classes[np.frombuffer(raw, np.uint8)], minlength=CLASSES)[:CLASSES].astype(np.int32), hist))
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, STATS)], fields=list(STATS))

    return F.arrow_udf(count, SQL_OF_STATS)(text)


def measured(*columns: str) -> Column:
    """MEASURES of n_words, n_repeat_words, chars, words, ref_chars, ref_words."""

    def measure(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            rows, bounds = [], {}
            n, repeated = batch[0].to_pylist(), batch[1].to_pylist()
            for a, b, chars, words, ref_chars, ref_words in zip(n, repeated, *(c.to_numpy(zero_copy_only=False) for c in batch[2:])):
                if base_failed(a, b) or ref_words is None or ref_words.sum() < MIN_REFERENCE:
                    rows.append((base_failed(a, b), False, None, None, None))
                    continue
                key = a, ref_words.tobytes()
                if key not in bounds:
                    bounds[key] = words_most(a, ref_words)
                rows.append((False, chars_failed(a, chars, ref_chars), jensen_shannon(words, ref_words), bounds[key], (a // MIN_WORDS).bit_length() - 1))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, MEASURES)], fields=list(MEASURES))

    return F.arrow_udf(measure, SQL_OF_MEASURES)(*columns)


def references(stats: DataFrame) -> DataFrame:
    """lang, ref_chars, ref_words: a row for each language with documents that pass the base rules."""
    good = stats.where((F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words")))
    total = F.aggregate("chars", F.lit(0), lambda a, x: a + x)
    shares = good.select("lang", "words", F.transform("chars", lambda x: x / total).alias("shares"))
    return shares.groupBy("lang").agg(
        F.array(*[F.percentile_approx(F.col("shares")[i], 0.5) for i in range(CLASSES)]).alias("ref_chars"),
        F.array(*[F.sum(F.col("words")[i]) for i in range(len(VOCABULARY) + 1)]).alias("ref_words"),
    )


def with_references(stats: DataFrame, refs: DataFrame, broadcast_most: int = BROADCAST_MOST) -> DataFrame:
    """stats with the references of their language; beyond a number of languages by a join that spreads each language over SALTS keys."""
    if refs.count() <= broadcast_most:
        return stats.join(F.broadcast(refs), "lang", "left")
    spread = refs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return stats.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(spread, ["lang", "salt"], "left").drop("salt")


def word_limits(measures: DataFrame) -> DataFrame:
    """lang, limits: for each band of lengths (-1: all) with MIN_BAND documents or more, what the words' distance times the root of n_words may reach."""
    scaled = measures.where("not base_failed and distance is not null").select("lang", F.explode(F.array("band", F.lit(-1))).alias("band"), F.round(F.col("distance") * F.sqrt("n_words"), 2).alias("z"))
    q = scaled.groupBy("lang", "band").agg(F.count("*").alias("n"), F.percentile("z", [0.25, 0.5]).alias("q")).where(F.col("n") >= MIN_BAND)
    limit = F.greatest(F.lit(WORDS_LEAST), F.col("q")[1] + WORDS_SPREADS * (F.col("q")[1] - F.col("q")[0]))
    return q.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("band", limit))).alias("limits"))


def judged(docs: DataFrame, columns: list[str], text_col: str, lang_col: str) -> DataFrame:
    """c0, c1, ... (the columns), the base counts, base_failed and kept of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    row = [f"c{i}" for i in range(len(columns))]
    path = scratch(spark, "quality")
    own = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(columns, row)], F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), counted(F.col(text_col)).alias("stats")).select(*row, "lang", "stats.*")
    write_scratch(own, path)
    stats = spark.read.schema(own.schema).parquet(path)
    refs = checkpointed(references(stats))
    measures = with_references(stats, refs).withColumn("m", measured("n_words", "n_repeat_words", "chars", "words", "ref_chars", "ref_words")).select(*row, "lang", *COUNTS, "m.*")
    joined = with_references(measures, checkpointed(word_limits(measures.drop(*row))))
    scaled = F.coalesce(F.try_element_at("limits", F.col("band")), F.try_element_at("limits", F.lit(-1)), F.lit(WORDS_DEFAULT))
    limit = F.least("most", F.greatest(F.lit(WORDS_FLOOR), scaled / F.sqrt("n_words")))  # least: of those that aren't null
    kept = ~F.col("base_failed") & ~F.col("chars_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))
    return joined.select(*row, *COUNTS, "base_failed", kept.alias("kept"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, the base counts, base_failed and kept of every row."""
    return judged(docs, [id_col], text_col, lang_col).select(F.col("c0").alias(id_col), *COUNTS, "base_failed", "kept")


def keep_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    kept = judged(docs, docs.columns, text_col, lang_col).where("kept")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
