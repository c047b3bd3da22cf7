"""Toxicity by compression distance.

Two zstandard dictionaries are trained on texts, one on ordinary and one on toxic ones. The ordinary
dictionary is part of both sides, so what is ordinary costs the same on both, and the toxic side has the
toxic dictionary's content beside it. A window is WINDOW_WORDS words of running text; its gain is how many
bytes shorter it becomes with the toxic side. A document's score is a logistic function of its windows' gains
(how many and what share reach each of LEVELS, mean and largest), calibrated on labelled documents that no
dictionary has seen.

Much of a toxic text is ordinary. So the toxic dictionary is trained in ROUNDS of two halves: windows of each
half that gain with the dictionary of the other half make up the text for the next training.

Fitting takes at most SAMPLE_ROWS labelled documents of each class and SAMPLE_BYTES of their text, those of
least hashed id, each of LONGEST bytes at most; exact copies among them count once, of rows of equal id the
least text. The constant of the logistic function is set right for the shares of both classes among all
labels. Scoring reads every whole text.

Defined cases: null and empty texts have no windows and score as such; rows with a null label are not used, of
several labels of an id the highest holds; without both labels among the rows the score is 0; repeated rows
each have their row; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stellate.llm.common import bounded_batches

SAMPLE_ROWS, SAMPLE_BYTES, LONGEST = 5_000, 12_000_000, 20_000
THRESHOLD, FOLDS, HELD_OUT, CALIBRATION = 0.3, 4, 2, 1
#: Bytes of a word at most; longer runs are cut.
WINDOW_WORDS, WORD_MOST = 7, 64
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, GRAM = 110 << 10, 8 << 10, 32, 6
ROUNDS, MIN_GAIN, LEVELS = 3, 2, (2, 3, 4)
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def windows(raw: bytes) -> list[bytes]:
    """Windows of a text, one after another, in lower case (A-Z)."""
    words = raw.translate(FOLD).split()
    if max(map(len, words), default=0) > WORD_MOST:
        words = [w[i : i + WORD_MOST] for w in words for i in range(0, len(w), WORD_MOST)]
    return [b" %b " % b" ".join(words[i : i + WINDOW_WORDS]) for i in range(0, len(words), WINDOW_WORDS)]


def fold_of(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def train(texts: list[bytes], size: int) -> tuple[bytes, bytes]:
    """Header (entropy tables) and content of a dictionary trained on texts; few texts are themselves the content, without a header."""
    import zstandard as z

    total = sum(map(len, texts))
    if total <= size:
        return b"", b"".join(texts)
    try:
        made = z.train_dictionary(min(size, total // 4), texts, k=SEGMENT, d=GRAM).as_bytes()
    except z.ZstdError:  # texts are too few or too short for training
        return b"", b"".join(texts)[:size]
    end = made.find(struct.pack("<III", 1, 4, 8)) + 12  # the offsets that end the header
    return made[:end], made[end:]


class Gains:
    """How many bytes shorter windows become with the toxic dictionary beside the ordinary one."""

    def __init__(self, header: bytes, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = self._compressor(header, ordinary), self._compressor(header, toxic + ordinary)

    @staticmethod
    def _compressor(header: bytes, content: bytes):
        import zstandard as z

        kind = z.DICT_TYPE_FULLDICT if header and len(content) >= 8 else z.DICT_TYPE_RAWCONTENT
        made = z.ZstdCompressionDict(header + content if kind == z.DICT_TYPE_FULLDICT else content.ljust(8), dict_type=kind)
        how = z.ZstdCompressionParameters(
            window_log=20, chain_log=20, hash_log=20, search_log=8, min_match=3, target_length=256, strategy=z.STRATEGY_BTOPT,
            format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        made.precompute_compress(compression_params=how)
        return z.ZstdCompressor(dict_data=made, compression_params=how).compress

    def __call__(self, parts: list[bytes]) -> np.ndarray:
        ordinary, toxic = self.ordinary, self.toxic
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in parts], np.int64)

    def features(self, raw: bytes) -> list[float]:
        gains = self(windows(raw))
        if not len(gains):
            gains = np.zeros(1, np.int64)
        hits = [int((gains >= level).sum()) for level in LEVELS]
        return [*np.log2(1 + np.array(hits)).tolist(), *[min(1.0, 10 * n / len(gains)) for n in hits], float(gains.mean()), min(int(gains.max()), 10) / 8]


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Header, ordinary and toxic content."""
    header, common = train([t.translate(FOLD) for t in ordinary], ORDINARY_BYTES)
    halves = [[windows(t) for t in toxic[i::2]] for i in (0, 1)]
    chosen = [[b"".join(w) for w in half] for half in halves]
    for _ in range(ROUNDS):
        gains = [Gains(header, common, train(half, TOXIC_BYTES)[1]) for half in chosen]
        now = [[b"".join(w for w, g in zip(ws, other(ws)) if g >= MIN_GAIN) for ws in half] for half, other in zip(halves, gains[::-1])]
        now = [[t for t in half if t] for half in now]
        if not all(now):
            break  # too few texts for one half to tell of the other
        chosen = now
    return header, common, train(chosen[0] + chosen[1], TOXIC_BYTES)[1]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.2) -> np.ndarray:
    """Weights, the last one constant, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


Model = tuple[bytes, bytes, bytes, list[float]]


def sample(docs: DataFrame, labels: DataFrame, rows: int, size: int) -> tuple[list[tuple[int, int, bytes]], dict[int, int]]:
    """(id, label, text) of the labelled rows outside the held-out fold, of bounded number and bytes; the number of all such labels by class."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("y"))
    marked = marked.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT).groupBy("doc_id").agg(F.max("y").alias("y")).where("y in (0, 1)")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = marked.where("y = 1").orderBy(*order).limit(rows).union(marked.where("y = 0").orderBy(*order).limit(rows))
    texts = docs.select("doc_id", "text").where(f"octet_length(text) between 1 and {LONGEST}").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over 2 * rows documents at most
    found = texts.withColumn("upto", upto).where(F.col("upto") <= size).select("doc_id", "y", "text").collect()  # 2 * size bytes at most
    return [(r["doc_id"], r["y"], r["text"].encode()) for r in found], {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Header, dictionaries and weights, from labelled rows outside the held-out fold."""
    rows, counts = sample(docs, labels, sample_rows, sample_bytes)
    texts: dict[bytes, tuple[int, int]] = {}
    for i, y, text in sorted(rows):
        texts.setdefault(text, (i, y))
    parts = {(c, y): [t for t, (i, label) in texts.items() if label == y and (fold_of(i) == CALIBRATION) == c] for c in (False, True) for y in (0, 1)}
    if not parts[False, 0] or not parts[False, 1]:
        return None
    model = train_dictionaries(parts[False, 1], parts[False, 0])
    gains, use = Gains(*model), bool(parts[True, 0] and parts[True, 1])
    x = np.array([gains.features(t) for y in (0, 1) for t in parts[use, y]])
    taken = [len(parts[use, y]) for y in (0, 1)]
    weights = fit_logistic(x, np.repeat([0, 1], taken))
    weights[-1] += np.log(counts[1] / taken[1]) - np.log(counts[0] / taken[0])  # classes were sampled apart
    return *model, weights.tolist()


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    return scored(docs, fit(docs, labels, sample_rows, sample_bytes))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """score by a fitted model."""
    bounded_batches(docs.sparkSession)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(*model[:3]) if model else None
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            if gains:
                for i, text in enumerate(batch.column(2).to_pylist()):
                    scores[i] = np.dot(gains.features(text.encode() if text else b""), model[3][:-1]) + model[3][-1]
                scores = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(predict, f"doc_id {kind}, held_out boolean, score double, predicted int")
