"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

1. Every text becomes the set of its distinct word shingles (64-bit hashes) and a SuperMinHash signature: all ranks of one
   random permutation per element, taken level by level and stopped as soon as no bin can still change.
2. Documents with equal sets form a class. Only its smallest document goes on.
3. Bands of the signature give buckets. In a bucket, members are first compared with one leader only, chosen anew in every
   bucket. Small digests rule out pairs that can't be linked before any set is moved; the rest are confirmed on full sets.
4. Confirmed links are grouped by union-find inside partitions and by smallest-label rounds with pointer jumping across them.
5. Where a bucket still holds several groups, every member outside its largest group meets the members of other groups,
   inside a join on the bucket that passes only pairs whose digests allow a link. So each pair that shares a bucket is in one
   group, or has been compared, or can't be linked, and a large group of copies costs stars instead of all pairs.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing. A document without
id is linked with nothing and kept. Repeated rows share their id and give a row each. Empty tables give empty ones. Other
columns are not read by `components`, and `deduplicate` passes them on untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, sqrt
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import common
from faultline.llm.common import mix

#: Bins of a signature.
BINS = 128
#: A pair at the threshold is missed by all bands with at most this probability.
MISS = 1e-6
#: Up to so many ids (8 bytes each) are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000
SLICE = 1 << 20
SLICE_ROWS = 2000
PLANES = ["p0", "p1", "p2", "p3"]
#: Bits of a parity sketch: bit h of a set's sketch is the parity of the number of its shingles that hash to h.
PARITY_BITS = 1024
PARITY = [f"o{i}" for i in range(PARITY_BITS // 64)]


@dataclass(frozen=True)
class Rule:
    """Two sets are near when 100 * intersection >= percent * union, over shingles of `width` words."""

    width: int = 5
    percent: int = 80

    @property
    def rows(self) -> int:
        """Rows of a band: as many as the probability of a miss allows."""
        near = self.percent / 100
        return max(r for r in range(1, 9) if (1 - near**r) ** (BINS // r) <= MISS or r == 1)

    @property
    def bands(self) -> int:
        return BINS // self.rows

    @property
    def differing(self) -> int:
        """So many of the bins' two-bit digests may differ: 5.5 standard deviations above the mean at the threshold."""
        p = 0.75 * (1 - self.percent / 100)
        return ceil(BINS * p + 5.5 * sqrt(BINS * p * (1 - p)))


def super_minhash(text: np.ndarray, value: np.ndarray, texts: int, bins: int = BINS) -> np.ndarray:
    """Signatures (texts x bins, uint64) of sets given as distinct (text, value) pairs; a text without elements keeps the maximum.

    Level j draws, for each element, the j-th place of a Fisher-Yates shuffle of the bins and a random fraction; the bin there
    takes the minimum of j + fraction. When all bins of a text are filled at level j, later levels can't lower any, so the
    text's elements stop.
    """
    with np.errstate(over="ignore"):
        empty = np.iinfo(np.uint64).max
        out = np.full(texts * bins, empty, np.uint64)
        places = None
        for j in range(bins):
            draw = mix(value + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            k = j + ((draw >> np.uint64(32)) * np.uint64(bins - j) >> np.uint64(32)).astype(np.int64)
            rank = (np.uint64(j) << np.uint64(32)) | (draw & np.uint64(0xFFFFFFFF))
            if j == 0:
                chosen = k
            else:
                row = np.arange(len(value))
                chosen = places[row, k].astype(np.int64)
                places[row, k] = places[:, j]
                places[:, j] = chosen
            np.minimum.at(out, text * bins + chosen, rank)
            open_text = (out.reshape(texts, bins) == empty).any(axis=1)
            go_on = open_text[text]
            if not go_on.any():
                break
            if j == 0:
                k = k[go_on]
                places = np.tile(np.arange(bins, dtype=np.uint8 if bins <= 256 else np.int32), (len(k), 1))
                row = np.arange(len(k))
                places[row, k] = 0
                places[:, 0] = k
            elif not go_on.all():
                places = places[go_on]
            text, value = text[go_on], value[go_on]
        return out.reshape(texts, bins)


def shingle_sets(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle) pairs of texts, A-Z lower-cased."""
    words = common.Words([r.lower() for r in rows])
    return common.distinct(*common.shingles(words, words.hashes(), width))


def sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """Of each document: size of its set, a 128-bit fingerprint of it, band keys, two bits of each bin, and a parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, limit=SLICE, rows=SLICE_ROWS):
            n = part.num_rows
            text, value = shingle_sets(common.raw_bytes(part.column("text")), rule.width)
            size = np.bincount(text, minlength=n)
            with np.errstate(over="ignore"):
                prints = []
                for salt in (0x6A09E667F3BCC909, 0xBB67AE8584CAA73B):
                    sums = np.zeros(len(value) + 1, np.uint64)
                    np.cumsum(mix(value ^ np.uint64(salt)), out=sums[1:])
                    ends = np.cumsum(size)
                    prints.append((sums[ends] - sums[ends - size]).view(np.int64))
                signature = super_minhash(text, value, n)
                keys = []
                for b in range(rule.bands):
                    key = np.full(n, np.uint64(b + 1))
                    for i in range(b * rule.rows, (b + 1) * rule.rows):
                        key = mix(key * np.uint64(0x2545F4914F6CDD1D) + signature[:, i])
                    keys.append(key.view(np.int64))
                digest = mix(signature)
            planes = []
            for bit in (0, 1):
                packed = np.packbits((digest >> np.uint64(bit) & np.uint64(1)).astype(np.uint8), axis=1)
                planes += [np.ascontiguousarray(packed[:, :8]).view(np.int64)[:, 0], np.ascontiguousarray(packed[:, 8:]).view(np.int64)[:, 0]]
            with np.errstate(over="ignore"):
                bit = (mix(value ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(PARITY_BITS)).astype(np.int64)
            odd = np.bincount(text * PARITY_BITS + bit, minlength=n * PARITY_BITS).reshape(n, PARITY_BITS) & 1
            parity = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
            bands = pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1) * rule.bands, pa.int32()), pa.array(np.stack(keys, axis=1).reshape(-1))
            )
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(size.astype(np.int64)), *map(pa.array, prints), bands, *map(pa.array, planes)]
                + [pa.array(np.ascontiguousarray(parity[:, i])) for i in range(len(PARITY))],
                names=["doc_id", "n_shingles", "f0", "f1", "bands", *PLANES, *PARITY],
            )

    longs = ", ".join(f"{c} long" for c in [*PLANES, *PARITY])
    schema = f"doc_id long, n_shingles long, f0 long, f1 long, bands array<long>, {longs}"
    return common.texts(docs).mapInArrow(run, schema)


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the documents whose ids are given: sorted 64-bit hashes as bytes. ids: a stored table with column id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            text, value = shingle_sets(common.raw_bytes(part.column("text")), width)
            ends = np.searchsorted(text, np.arange(part.num_rows + 1))
            sets = [value[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], names=["id", "shingles"])

    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = common.texts(docs).filter(F.col("doc_id").isNotNull())
    return texts.join(wanted, texts["doc_id"] == wanted["id"], "left_semi").mapInArrow(run, "id long, shingles binary")


def confirm(docs: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose full sets are near. Repeated ids with other texts are the same document: any of its rows counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(a, b), max(len(a) - 1, 0))
                common_size = int((a[at] == b).sum()) if len(a) else 0
                union = len(a) + len(b) - common_size
                near.append(union > 0 and 100 * common_size >= rule.percent * union)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    ids = common.store(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = common.store(full_sets(docs, ids, rule.width).dropDuplicates(["id"]), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def union_find(edges: DataFrame) -> DataFrame:
    """Union-find inside each partition: the same groups from one edge per node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
        found = [(x, root(x)) for x in parent]
        yield pd.DataFrame([p for p in found if p[0] != p[1]], columns=["a", "b"], dtype="int64")

    return edges.mapInPandas(run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(id, label) of every node: label is the smallest id of its group. Rounds of smallest neighbour and pointer jumping."""
    edges = common.store(union_find(edges.select("a", "b")), "edges")
    both = common.store(
        edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = common.store(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        step = common.store(step, "labels")
        up = step.select(F.col("id").alias("label"), F.col("label").alias("top"))
        jumped = step.join(up, "label", "left").select("id", "was", F.least("label", "top").alias("label"))
        jumped = common.store(jumped, "labels")
        labels = jumped.select("id", "label")
        if not jumped.filter(F.col("was") != F.col("label")).head(1):
            return labels


def apart(left: str, right: str) -> Column:
    """At least so many shingles are in one of two sets only: the differing bits of their parity sketches."""
    return reduce(add, (F.bit_count(F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}"))) for c in PARITY))


def can_link(left: str, right: str, rule: Rule) -> Column:
    """Whether two rows' digests allow a link. Parity sketches give a strict bound; where large sets fill them, two bits of
    each bin of the signatures decide, 5.5 standard deviations beyond the threshold."""
    c = lambda side, i: F.col(f"{side}.p{i}")
    unlike = [F.bit_count(c(left, i).bitwiseXOR(c(right, i)).bitwiseOR(c(left, i + 2).bitwiseXOR(c(right, i + 2)))) for i in (0, 1)]
    both = F.col(f"{left}.n_shingles") + F.col(f"{right}.n_shingles")
    # intersection >= percent / (100 + percent) of both sizes, so at most the rest is in one set only
    strict = (100 + rule.percent) * apart(left, right) <= (100 - rule.percent) * both
    return (unlike[0] + unlike[1] <= rule.differing) & strict


def components(docs: DataFrame, rule: Rule) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable over links, itself included), kept."""
    sketch = common.store(sketches(docs, rule), "sketch")
    with_words = sketch.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = common.store(
        with_words.groupBy("f0", "f1", "n_shingles")
        .agg(F.min("doc_id").alias("id"), F.min_by(F.struct("bands", *PLANES, *PARITY), "doc_id").alias("s"))
        .select("f0", "f1", "n_shingles", "id", "s.*"),
        "classes",
    )
    members = classes.select("id", F.explode("bands").alias("key"))
    leaders = (
        members.groupBy("key")
        .agg(F.count("*").alias("n"), F.min(F.col("id").bitwiseXOR(F.col("key"))).alias("least"))
        .filter("n > 1")
        .select("key", F.col("least").bitwiseXOR(F.col("key")).alias("leader"))
    )
    shared = common.store(members.join(leaders, "key"), "shared")  # only buckets with several classes
    digests = classes.select("id", "n_shingles", *PLANES, *PARITY)

    def possible(pairs: DataFrame) -> DataFrame:
        """Distinct pairs whose digests allow a link, with the least distance of their sets."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        x, y = digests.alias("x"), digests.alias("y")
        out = pairs.join(x, F.col("a") == F.col("x.id")).join(y, (F.col("b") == F.col("y.id")) & can_link("x", "y", rule))
        size = F.col("x.n_shingles") + F.col("y.n_shingles")
        return common.store(out.select("a", "b", (apart("x", "y") / size).alias("d")), "pairs")

    stars = possible(shared.filter("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")))
    # each class with its most alike leader first: as a rule that links all there is to link
    ends = stars.select("a", "b", "d", F.explode(F.array("a", "b")).alias("id"))
    best = ends.groupBy("id").agg(F.min_by(F.struct("a", "b"), F.struct("d", "a", "b")).alias("p")).select("p.*").distinct()
    first = common.store(best, "first")
    edges = common.store(confirm(docs, first, rule), "links")
    labels = connected(edges)

    def label_of(df: DataFrame, name: str, out: str) -> DataFrame:
        known = labels.select(F.col("id").alias(name), F.col("label").alias(out))
        return df.join(known, name, "left").withColumn(out, F.coalesce(out, name))

    # the other stars that still connect two groups
    rest = label_of(label_of(stars.select("a", "b"), "a", "la"), "b", "lb").filter("la <> lb").select("a", "b")
    rest = common.store(rest.join(first, ["a", "b"], "left_anti"), "rest")
    edges = common.store(edges.union(confirm(docs, rest, rule)), "links")
    labels = connected(edges)

    # buckets with several groups: all members outside the largest group against the members of the others
    held = common.store(label_of(shared.select("key", "id"), "id", "label"), "held")
    sizes = held.groupBy("key", "label").agg(F.count("*").alias("n"))
    top = sizes.groupBy("key").agg(F.count("*").alias("groups"), F.max_by("label", F.struct("n", "label")).alias("top"))
    mixed = common.store(held.join(top.filter("groups > 1"), "key").join(digests, "id").drop("groups"), "mixed")
    x, y = mixed.filter("label <> top").alias("x"), mixed.alias("y")
    others = (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label"))
    open_pairs = x.join(y, others & can_link("x", "y", rule)).select(
        F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")
    )
    open_pairs = common.store(open_pairs.distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti"), "open")
    edges = common.store(edges.union(confirm(docs, open_pairs, rule)), "links")
    labels = connected(edges)

    class_of = label_of(classes.select("f0", "f1", "n_shingles", "id"), "id", "component_id")
    rows = sketch.select("doc_id", "n_shingles", "f0", "f1")
    linked = rows.join(class_of.drop("id"), ["f0", "f1", "n_shingles"], "left")
    # a text without words, or a row without id, is a component by itself
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    linked = linked.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
    return linked.select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def deduplicate(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """The rows of one document of each group, with all their columns. Of repeated rows of an id one stays."""
    found = components(docs, rule or Rule())
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    with_id = left.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return with_id.unionByName(left.filter(F.col("doc_id").isNull()))


def op4_superminhash(spark: SparkSession, folder: str) -> DataFrame:
    return components(common.read(spark, folder, "documents"), Rule(width=3, percent=85))
