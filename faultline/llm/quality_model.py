"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs of letters and digits, and runs of other characters that aren't white space. Single words and pairs fall into DIM
buckets (a pair of equal words into one bucket of its own); a feature's value is SCALE times its share of the text's n-grams, so
a score is a sparse dot product that doesn't depend on length. FTRL-proximal keeps most weights at zero.

The model is fitted in one task to a bounded sample of labelled documents (TRAIN_ROWS, those with the smallest hashes of their
ids); one document in four, by crc32 of its id, is held out and never seen. Labels, lang, source and doc_id are no features.

Defined results: a null or empty text has no features and gets the score of the bias alone. Without any label all scores are
0.5. Repeated rows give repeated results, also without id (which counts as not held out). An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import common

DIM = 1 << 18
#: Bucket of pairs of equal words.
TWICE = 0
SCALE = 20.0
TRAIN_ROWS = 12_000
PASSES = 2
#: Step sizes and penalties of the updates.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
#: Least score that predicts label 1.
PREDICT = 0.7


def features(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of each n-gram, and how many n-grams each text has."""
    data = np.frombuffer(b"\n".join([*rows, b""]), np.uint8)
    word = ((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    kind = np.where(gap, 0, np.where(word, 1, 2)).astype(np.int8)
    edge = np.diff(kind, prepend=np.int8(0)) != 0
    start = np.flatnonzero(edge & (kind > 0))
    end = np.flatnonzero(np.append(edge[1:], False) & (kind > 0)) + 1
    begin = np.cumsum([0, *(len(r) + 1 for r in rows)])
    first = np.searchsorted(start, begin)
    text = np.repeat(np.arange(len(rows)), np.diff(first))
    power, inverse = common.Words.powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
        one = common.mix((sums[end] - sums[start]) * inverse[start] ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        inner = text[1:] == text[:-1]
        two = common.mix(one[:-1] * np.uint64(0x2545F4914F6CDD1D) + one[1:])
    bucket = lambda h: (h % np.uint64(DIM - 1)).astype(np.int64) + 1
    pairs = np.where(one[:-1] == one[1:], TWICE, bucket(two))[inner]
    texts = np.concatenate([text, text[1:][inner]])
    return texts, np.concatenate([bucket(one), pairs]), np.bincount(texts, minlength=len(rows))


class Ftrl:
    """FTRL-proximal; place DIM is the bias."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(DIM + 1), np.zeros(DIM + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(rows: list[tuple[bytes, int]]) -> np.ndarray:
    """Weights after PASSES over the rows in their order."""
    model = Ftrl()
    examples = []
    for raw, label in rows:
        _, buckets, size = features([raw])
        at, count = np.unique(buckets, return_counts=True)
        examples.append((np.append(at, DIM), np.append(SCALE * count / max(size[0], 1), 1.0), label))
    for _ in range(PASSES):
        for example in examples:
            model.learn(*example)
    return model.weights()


def scores(rows: list[bytes], weights: np.ndarray) -> np.ndarray:
    text, bucket, size = features(rows)
    dot = np.bincount(text, weights=weights[bucket], minlength=len(rows)) * SCALE / np.maximum(size, 1)
    return 1 / (1 + np.exp(-np.clip(dot + weights[DIM], -35, 35)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The fitted weights: DIM + 1 numbers, whatever the size of the corpus."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).dropDuplicates(["doc_id"])
    order = F.xxhash64("doc_id")
    sample = known.orderBy(order, "doc_id").limit(TRAIN_ROWS)
    rows = common.texts(docs).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).orderBy(order, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(common.raw_bytes(batch.column("text")), batch.column("label").to_pylist(), strict=True)
        yield pa.RecordBatch.from_pydict({"weights": [fit(rows).tobytes()]})

    found = rows.select("text", "label").coalesce(1).mapInArrow(run, "weights binary").collect()
    return np.frombuffer(found[0]["weights"], np.float64) if found else np.zeros(DIM + 1)


def quality_scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            found = scores(common.raw_bytes(part.column("text")), weights)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    return common.texts(docs).mapInArrow(run, "doc_id long, score double")


def op6_ftrl_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents")
    found = quality_scores(docs, train(docs, common.read(spark, folder, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
