"""Quality classifier: supervised subword embeddings.

A text is the mean of learned vectors of its hashed words and character n-grams; a
softmax over that mean gives the class. Vectors and softmax are trained with
plain numpy stochastic gradient descent on a bounded sample of labelled rows.
A word that repeats the one before it also counts as the feature "repeat".

Since the softmax is linear in the mean, a trained model is one number per
feature (the log-odds it contributes), 1 MB in all, whatever the corpus.

Nulls and odd cases: a null or empty text has no features and gets the prior of
the sample; rows with a null label are not learned from; a null doc_id counts
as empty text in the hold-out rule and is not learned from; rows that repeat a
labelled id are learned from once, with the least of their texts; repeated rows are
scored each; with no labelled rows every score is 0.5. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, flat_text, fold, mix, small_batches, steps, trimmed, word_hashes, words

BITS = 16
SLOTS = 4  # tables: words, 2-, 3- and 4-grams
REPEAT = SLOTS << BITS
SIZE = REPEAT + 1


def _grams(points: np.ndarray, n: int) -> np.ndarray:
    """The slot of each n-gram of characters, by its first one."""
    if len(points) < n:
        return np.zeros(0, np.uint32)
    x = points[: len(points) - n + 1].astype(np.uint32)
    for k in range(1, n):
        x = x * np.uint32(0x9E3779B1) + points[k : len(points) - n + 1 + k]
    x *= np.uint32(2654435761)
    x ^= x >> np.uint32(15)
    x *= np.uint32(2246822519)
    return (x >> np.uint32(32 - BITS)) + np.uint32((n - 1) << BITS)


def _word_slots(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of words, first word by document, and whether a word repeats the one before it."""
    starts, ends, first = words(buf, offs)
    h = word_hashes(buf, starts, ends, lower=False)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][first[:-1] < len(h)]] = False
    return (h >> np.uint64(64 - BITS)).astype(np.int64), first, same


@dataclass
class QualityModel:
    weight: np.ndarray  # log-odds of label 1 by feature
    bias: float

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        total, count = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1)
        for i, j in steps(offs):
            b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            at, points = code_points(b)
            q = o if at is None else np.searchsorted(at, o)  # where texts begin, in characters
            for n in (2, 3, 4):
                c = np.concatenate([[0.0], np.cumsum(self.weight[_grams(points, n)], dtype=np.float64)])
                end = np.maximum(q[1:] - n + 1, q[:-1])
                total[i:j] += c[np.minimum(end, len(c) - 1)] - c[np.minimum(q[:-1], len(c) - 1)]
                count[i:j] += end - q[:-1]
            slots, first, same = _word_slots(b, o)
            c = np.concatenate([[0.0], np.cumsum(self.weight[slots] + same * self.weight[REPEAT], dtype=np.float64)])
            r = np.concatenate([[0], np.cumsum(same)])
            total[i:j] += c[first[1:]] - c[first[:-1]]
            count[i:j] += np.diff(first) + r[first[1:]] - r[first[:-1]]
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -700, 700)))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of one text and their shares."""
    buf = np.frombuffer(text.encode(), np.uint8)
    points = code_points(buf)[1]
    slots, _, same = _word_slots(buf, np.array([0, len(buf)]))
    ids = np.concatenate([*(_grams(points, n).astype(np.int64) for n in (2, 3, 4)), slots, np.full(same.sum(), REPEAT)])
    ids, c = np.unique(ids, return_counts=True)
    return ids, (c / max(1, c.sum())).astype(np.float32)


def train(texts: list[str], y: np.ndarray, dim: int = 16, epochs: int = 5, rate: float = 0.5, seed: int = 7) -> QualityModel:
    """Softmax regression over mean feature vectors, one document a step.

    The step for a document's vectors is scaled so that its mean moves by the
    plain gradient step; without that, long texts would hardly learn.
    """
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (SIZE, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    docs = [features(t) for t in texts]
    at, all_steps = 0, max(1, epochs * len(docs))
    for _ in range(epochs):
        for d in rng.permutation(len(docs)):
            ids, share = docs[d]
            lr, at = rate * (1 - at / all_steps), at + 1
            v = emb[ids]
            h = share @ v if len(ids) else np.zeros(dim, np.float32)
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[d]] -= 1
            back = out @ p
            out -= lr * np.outer(h, p)
            bias -= lr * 0.1 * p
            if len(ids):
                v -= np.outer(share * (lr / float(share @ share)), back)
                emb[ids] = v
    return QualityModel((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit_quality(documents: DataFrame, labels: DataFrame, max_rows: int = 2000, label: str = "quality") -> QualityModel:
    """Train on at most ``max_rows`` labelled ids outside the held-out fold, taken by a hash of their id."""
    picked = (
        labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", 4) != 2))
        .distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    )
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    return train(rows["text"].to_pylist(), rows["y"].to_numpy().astype(np.int64))


def score_quality(documents: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """All columns of ``documents`` needed to name a row, its score and prediction."""
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score(*flat_text(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    scored = documents.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(documents: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold."""
    spark = documents.sparkSession
    small_batches(spark)
    shared, at = spark.sparkContext.broadcast(model), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score(*flat_text(b.column(at))) >= threshold))

    return documents.mapInArrow(trimmed(run), documents.schema)
