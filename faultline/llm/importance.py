"""Importance resampling of documents towards the distribution of a target table.

Features are all runs of one to three consecutive words, hashed by crc32 into a fixed number of buckets. The crc of a run is
put together from the crcs of its words, so a slice of texts is scored by arrays alone. Weights are sums of whole-number gains
of buckets; a seeded Gumbel term makes drawing the highest scores a draw without replacement. The lowest key drawn is found by a
distributed quickselect: random pivot keys, an exact count of the rows before, at and between them, and the one interval that
holds the wanted place goes on. Only the rows drawn are sorted and ranked.

Defined results: a null or empty text has no words, weight 0 and is never drawn, but keeps its row. Equal scores go by doc_id (a
null id first, its Gumbel term that of an empty id), then by number of features; what is still equal is equal in all columns.
Repeated rows are rows of their own. Empty tables give an empty result, or gains against no target. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from faultline.llm import common
from faultline.operators.skew import global_rank

BUCKETS = 10_000
WIDTH = 3
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
#: Pivot keys of a round of the quickselect.
PIVOTS = 31
#: Words up to this many bytes are hashed together, a byte of each at a time.
TOGETHER = 48

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IN_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])


class Crc:
    """crc32 of many strings at once. With `ahead`, a crc moves over the bytes that follow: crc(a + b) = ahead(crc(a), len(b)) ^ crc(b)."""

    def __init__(self) -> None:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
        self.step = step
        # what each byte of a crc becomes after 0, 1, 2, ... further bytes, and after 1, 2, 4, 8, ...
        now = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        near = [now]
        for _ in range(TOGETHER + 1):
            near.append(step[near[-1] & 255] ^ (near[-1] >> 8))
        self.near = np.stack(near)
        self.far = [near[1]]
        for _ in range(40):
            self.far.append(self.moved(self.far[-1], self.far[-1]))
        self.space = np.uint32(zlib.crc32(b" "))

    @staticmethod
    def moved(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]

    def ahead(self, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
        near = np.minimum(size, TOGETHER + 1)
        out = self.near[near, 0, crc & 255] ^ self.near[near, 1, (crc >> 8) & 255]
        out ^= self.near[near, 2, (crc >> 16) & 255] ^ self.near[near, 3, crc >> 24]
        for i in np.flatnonzero(size > TOGETHER + 1):
            value, rest, k = crc[i], int(size[i]), 0
            while rest:
                value = self.moved(self.far[k], value) if rest & 1 else value
                rest, k = rest >> 1, k + 1
            out[i] = value
        return out

    def of(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.uint32)
        short = np.flatnonzero(size <= TOGETHER)
        short = short[np.argsort(-size[short], kind="stable")]
        begin, state = start[short], np.full(len(short), 0xFFFFFFFF, np.uint32)
        longer = np.searchsorted(-size[short], -np.arange(TOGETHER), "left")  # how many words have a byte at each place
        for place in range(TOGETHER):
            n = longer[place]
            if not n:
                break
            state[:n] = self.step[(state[:n] ^ data[begin[:n] + place]) & 255] ^ (state[:n] >> 8)
        out[short] = state ^ np.uint32(0xFFFFFFFF)
        for i in np.flatnonzero(size > TOGETHER):
            out[i] = zlib.crc32(data[start[i] : start[i] + size[i]])
        return out


_crc: list[Crc] = []


def features(rows: list[bytes], width: int = WIDTH, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, bucket of each feature)."""
    if not _crc:
        _crc.append(Crc())
    crc = _crc[0]
    data = np.frombuffer(b"\n".join([*rows, b""]).translate(_LOWER), np.uint8)
    edge = np.flatnonzero(np.diff(_IN_WORD[data].view(np.int8), prepend=0, append=0))
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    begin = np.cumsum([0, *(len(r) + 1 for r in rows)])
    n_words = np.diff(np.searchsorted(start, begin))
    text = np.repeat(np.arange(len(rows)), n_words)
    word = crc.of(data, start, size)
    spaced = crc.ahead(np.full(len(word), crc.space), size) ^ word  # the crc of a space and the word
    run, texts, values = word, [text], [word % np.uint32(buckets)]
    for extra in range(1, width):
        inside = np.flatnonzero(text[extra:] == text[:-extra])
        run = crc.ahead(run[: len(size[extra:])], size[extra:] + 1) ^ spaced[extra:]
        texts.append(text[inside])
        values.append(run[inside] % np.uint32(buckets))
    return n_words, np.concatenate(texts), np.concatenate(values).astype(np.int64)


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) over all texts of the column `text`; each task adds up its own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for part in common.slices(batches):
            total += np.bincount(features(common.raw_bytes(part.column("text")))[2], minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket: a fixed number of rows, so they may come to the driver."""
    spark = raw.sparkSession
    both = (
        spark.range(BUCKETS).withColumnRenamed("id", "bucket")
        .join(bucket_counts(raw).withColumnRenamed("n", "s"), "bucket", "left")
        .join(bucket_counts(target).withColumnRenamed("n", "t"), "bucket", "left")
        .select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
        .toArrow().sort_by("bucket")
    )
    s, t = (both[c].to_numpy().astype(np.float64) for c in ("s", "t"))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weights(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight)."""
    kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            n_words, text, bucket = features(common.raw_bytes(part.column("text")))
            n = np.bincount(text, minlength=part.num_rows)
            weight = np.zeros(part.num_rows, np.int64)
            np.add.at(weight, text, gains[bucket])
            columns = [part.column("doc_id"), pa.array(n_words), pa.array(n), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(kinds))

    return common.texts(docs).mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: str, seed: int) -> Column:
    """A whole-number Gumbel term from a seeded hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def kth_key(rows: DataFrame, order: list[str], k: int, pivots: int = PIVOTS, seed: int = SEED) -> Row:
    """The k-th smallest key (from 1) by the columns `order`, which hold no nulls; repeated keys count as often as they occur.

    Every round reads the table once for pivots (a bounded number from each task) and once for the counts around them.
    """
    key = F.struct(*order)
    kinds = dict(rows.dtypes)
    at = lambda p: F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, p, strict=True)))
    inside = rows.select(*order)
    while True:
        drawn = inside.orderBy(F.rand(seed)).limit(pivots).collect()
        if not drawn:
            raise ValueError(f"fewer than {k} rows")
        keys = sorted({tuple(r) for r in drawn})
        # slot 2i lies before key i, slot 2i + 1 is key i
        slot = sum((F.when(key > at(p), 2).when(key == at(p), 1).otherwise(0) for p in keys), F.lit(0))
        counts = {r["slot"]: r["count"] for r in inside.groupBy(slot.alias("slot")).count().collect()}
        for s in range(2 * len(keys) + 1):
            if k <= counts.get(s, 0):
                break
            k -= counts.get(s, 0)
        else:
            raise ValueError("fewer rows than asked for")
        if s % 2:
            return Row(*order)(*keys[s // 2])
        if s:
            low = keys[s // 2 - 1]
            inside = inside.where(F.col(order[0]) >= F.lit(low[0])).where(key > at(low))
        if s < 2 * len(keys):
            high = keys[s // 2]
            inside = inside.where(F.col(order[0]) <= F.lit(high[0])).where(key < at(high))
        seed += 1


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): rank 1, 2, 3, ... of the documents drawn, null for the others.

    Of the documents with at least `least_words` words, `percent` in a hundred are drawn, highest scores first.
    """
    gains = bucket_gains(docs, target)
    scored = weights(docs, gains).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    scored = scored.withColumn("_down", -F.col("score")).withColumn("_id", F.coalesce("doc_id", F.lit(-(2**63))))
    scored = common.store(scored, "scored")
    may = F.col("n_words") >= least_words
    order = ["_down", "_id", "n_features"]
    k = scored.where(may).count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(*columns)
    last = kth_key(scored.where(may), order, k, seed=seed)
    drawn = may & (F.struct(*order) <= F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip(order, last, strict=True))))
    ranked = global_rank(scored.where(drawn), [F.col(c) for c in order], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))  # of rows equal to the last, as many as fit
    return ranked.select(*columns).unionByName(
        scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")).select(*columns)
    )


def op12_target_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(common.read(spark, folder, "documents"), common.read(spark, folder, "benchmark"))
