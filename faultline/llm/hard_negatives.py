"""Hard negatives of anchors: rows of another label whose score lies just below that of a positive.

Scores are inner products of whole-number vectors. Anchors are ordered by label and by the signs of fixed random projections, cut
into groups of fixed size, and each group is joined by a spanning tree of short edges. A task walks the trees over blocks of rows:
a root is scored in full, and below it a parent's score, plus and minus the length of the edge times the row's norm, bounds the
child's. Only rows whose bounds meet the child's window are scored; for the others the widened bounds go on to the next edge.
First the windows are open upwards, from the worst positive that a task keeps; then they are those of the positives found, from
the worst negative that a task keeps. Both times a task gives a few rows for each anchor, and these are merged by a shuffle.

Anchors go through the executors in passes of bounded size, which are broadcast; the rows are read in place and never shuffled.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part. Shorter vectors end in
zeros. Repeated rows are rows of their own: each may be an anchor, a positive or a negative, only an anchor itself is left out of its
positives. Scores are exact up to 2^53 of summed magnitudes, beyond that exact until they leave the range of long, where they
stop at its ends. An anchor without positives, and a positive without negatives, gives no rows; so does an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm import common
from faultline.operators.skew import first_per_group, global_rank

POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these hundredths of its positive's.
WINDOW = (30, 90)
#: Anchors of one spanning tree.
TREE = 256
#: Anchors that are broadcast at once, and bytes of their vectors.
PASS = 16_384
PASS_BYTES = 32 << 20
#: Rows that a task scores at a time.
BLOCK = 8_192
_EXACT = float(1 << 53)
_LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(floor(scale * x) of each vector as doubles, which vectors are whole): a null or non-finite component spoils a vector."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64())
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = vectors.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(row[~np.isfinite(values)], minlength=len(sizes)) == 0)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    with np.errstate(invalid="ignore", over="ignore"):
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(scale * values)
    return out, good & np.isfinite(out).all(axis=1)


def padded(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def lengths(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((vectors * vectors).sum(axis=1))


@dataclass
class Block:
    """Some rows with whole vectors."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray

    def part(self, at: np.ndarray) -> Block:
        return Block(self.ids[at], self.labels[at], self.vectors[at], self.norms[at])

    def scores(self, anchor: np.ndarray, norm: float) -> np.ndarray:
        """Whole-number inner products: as doubles where these are exact, else as long, from exact sums."""
        if not len(self.ids):
            return np.zeros(0)
        if norm * float(self.norms.max()) < _EXACT:  # bounds the sum of magnitudes
            return self.vectors @ anchor
        big = [int(x) for x in anchor]
        sums = [sum(int(x) * a for x, a in zip(row, big, strict=True)) for row in self.vectors]
        return np.array([min(max(s, _LONG[0]), _LONG[1]) for s in sums], np.int64)


def blocks(batches: Iterator[pa.RecordBatch], scale: float, width: int) -> Iterator[Block]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            vectors, good = quantised(part.column("vector"), scale)
            vectors = padded(vectors[good], width)
            keep = pa.array(good)
            ids, labels = (part.column(c).filter(keep).to_numpy() for c in ("vec_id", "label"))
            yield Block(ids, labels, vectors, lengths(vectors))


def spanning_tree(vectors: np.ndarray) -> tuple[list[int], list[int], list[float]]:
    """Places in the order of a walk from place 0 down, each one's parent (itself at the root), and the edge between them.

    The tree is that of least total length; the walk ends a branch before it takes the next.
    """
    n = len(vectors)
    near = lengths(vectors - vectors[0])
    parent, waiting, edges = np.zeros(n, int), np.ones(n, bool), np.zeros(n)
    waiting[0] = False
    below: list[list[int]] = [[] for _ in range(n)]
    for _ in range(n - 1):
        rest = np.flatnonzero(waiting)
        i = int(rest[np.argmin(near[rest])])
        waiting[i] = False
        edges[i] = near[i]
        below[parent[i]].append(i)
        length = lengths(vectors - vectors[i])
        closer = waiting & (length < near)
        near[closer], parent[closer] = length[closer], i
    order, stack = [], [0] if n else []
    while stack:
        i = stack.pop()
        order.append(i)
        stack += below[i]
    return order, parent[order].tolist(), edges[order].tolist()


@dataclass
class Anchors:
    """One pass of anchors, in the order of their trees."""

    number: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    parents: np.ndarray  # place in the pass; a root is its own
    edges: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray

    def walk(self, trees: list[range], block: Block, window) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, places in the block, their scores) of the rows whose bounds meet window(anchor) = (low, high, chosen places)."""
        for tree in trees:
            held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            last = {int(self.parents[a]): a for a in tree}  # the last child that needs a parent's bounds
            for a in tree:
                up = int(self.parents[a])
                low, high, chosen = window(a)
                if up == a:
                    at = np.arange(len(block.ids))
                    floor, ceiling = np.full(len(at), -np.inf), np.full(len(at), np.inf)
                else:
                    slack = np.nan_to_num(self.edges[a] * block.norms * (1 + 1e-9) + 1, nan=np.inf)  # magnitudes beyond doubles
                    floor, ceiling = held[up][0] - slack, held[up][1] + slack
                    at = np.flatnonzero(chosen & (ceiling >= low) & (floor <= high))
                some = block if len(at) == len(block.ids) else block.part(at)
                scores = some.scores(self.vectors[a], self.norms[a])
                if last.get(a, a) != a:
                    floor[at] = ceiling[at] = scores
                    wide = np.abs(scores) * 1e-15  # scores beyond 2^53 are rounded here
                    floor[at] -= wide
                    ceiling[at] += wide
                    held[a] = floor, ceiling
                if last.get(up) == a:
                    held.pop(up, None)
                if up == a:
                    keep = np.flatnonzero(chosen & (scores >= low) & (scores <= high))
                    at, scores = keep, scores[keep]
                yield a, at, scores


class Best:
    """The `size` best (score, id) of each of n lists: larger scores first, then smaller ids."""

    def __init__(self, n: int, size: int):
        self.size = size
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.worst = np.full(n, _LONG[0], np.int64)  # scores below it change nothing more

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.size:  # all that are not worse than the last place
            least = np.partition(scores, len(scores) - self.size)[len(scores) - self.size]
            keep = scores >= least
            scores, ids = scores[keep], ids[keep]
        scores = np.concatenate([self.scores[i], scores.astype(np.int64)])
        ids = np.concatenate([self.ids[i], ids])
        first = np.lexsort((ids, ~scores))[: self.size]
        self.scores[i], self.ids[i] = scores[first], ids[first]
        if len(first) == self.size:
            self.worst[i] = scores[first[-1]]

    def rows(self, keys: list[np.ndarray]) -> pa.RecordBatch:
        n = [len(x) for x in self.scores]
        columns = [*(np.repeat(k, n) for k in keys), joined(self.scores), joined(self.ids)]
        names = ["anchor", "place", "score", "vec_id"]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *parts])


_FOUND = "anchor long, place long, score long, vec_id long"


def trees_of(anchors: Anchors) -> list[range]:
    roots = np.flatnonzero(anchors.parents == np.arange(len(anchors.parents))).tolist()
    return [range(a, b) for a, b in zip(roots, [*roots[1:], len(anchors.parents)], strict=True)]


def best_positives(rows: DataFrame, anchors: Anchors, scale: float, size: int) -> DataFrame:
    """For each anchor and task the best rows of its label, itself included."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        trees, best = trees_of(a), Best(len(a.ids), size)
        for block in blocks(batches, scale, a.vectors.shape[1]):
            for tree in trees:
                labels = np.unique(a.labels[tree.start : tree.stop])
                own = block.part(np.flatnonzero(np.isin(block.labels, labels)))
                several = len(labels) > 1
                same = np.ones(len(own.ids), bool)

                def window(i, own=own, several=several, same=same):
                    return int(best.worst[i]), np.inf, own.labels == a.labels[i] if several else same

                for i, at, scores in a.walk([tree], own, window):
                    if len(at):
                        best.add(i, scores, own.ids[at])
        yield best.rows([a.number, np.zeros(len(a.ids))])

    return rows.mapInArrow(run, _FOUND)


def best_negatives(
    rows: DataFrame, anchors: Anchors, positives: list[np.ndarray], scale: float, size: int, share: tuple[int, int]
) -> DataFrame:
    """For each anchor, positive and task the best rows of another label in the positive's window."""
    sent = rows.sparkSession.sparkContext.broadcast((anchors, positives))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, positive = sent.value
        # of each positive: the least and largest score of a negative; a negative positive has none
        bounds = [[(-(-share[0] * int(p) // 100), share[1] * int(p) // 100) for p in some] for some in positive]
        bounds = [[(max(low, _LONG[0]), min(high, _LONG[1])) for low, high in some] for some in bounds]
        begin = np.cumsum([0, *map(len, bounds)])
        trees, best = trees_of(a), Best(int(begin[-1]), size)

        def least(i: int) -> int | float:
            return min((max(low, int(best.worst[k])) for k, (low, _) in enumerate(bounds[i], begin[i])), default=np.inf)

        for block in blocks(batches, scale, a.vectors.shape[1]):
            other = {x: block.labels != x for x in np.unique(a.labels)}

            def window(i, other=other):
                return least(i), max((high for _, high in bounds[i]), default=-np.inf), other[a.labels[i]]

            for i, at, scores in a.walk(trees, block, window):
                for k, (low, high) in enumerate(bounds[i], begin[i]):
                    inside = np.flatnonzero((scores >= max(low, int(best.worst[k]))) & (scores <= high))
                    if len(inside):
                        best.add(k, scores[inside], block.ids[at[inside]])
        anchor = np.repeat(a.number, np.diff(begin))
        yield best.rows([anchor, np.arange(begin[-1]) - np.repeat(begin[:-1], np.diff(begin))])

    return rows.mapInArrow(run, _FOUND)


_TREE = (
    "number long, vec_id long, label int, tree long, place int, parent int, edge double, vector array<double>"
)


def anchor_trees(rows: DataFrame, is_anchor: Column, scale: float, size: int) -> DataFrame:
    """The anchors, numbered from 1, with their places in spanning trees of at most `size` anchors."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, scale, 0):
            planes = np.random.default_rng(1).standard_normal((block.vectors.shape[1], 24))
            signs = (block.vectors @ planes > 0) @ (1 << np.arange(24))
            vectors = pa.array(list(block.vectors), pa.list_(pa.float64()))
            columns = [pa.array(block.ids), pa.array(block.labels), pa.array(signs.astype(np.int64)), vectors]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "signs", "vector"])

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        vectors, _ = quantised(table["vector"].combine_chunks(), 1)
        order, parents, edges = spanning_tree(vectors)
        place = np.argsort(order)  # of each row in the walk
        table = table.take(order).select(["number", "vec_id", "label", "tree", "vector"])
        made = [pa.array(np.arange(len(order)), pa.int32()), pa.array(place[parents], pa.int32()), pa.array(edges, pa.float64())]
        for k, (name, column) in enumerate(zip(("place", "parent", "edge"), made, strict=True)):
            table = table.add_column(4 + k, name, column)
        return table

    chosen = rows.where(is_anchor).mapInArrow(signed, "vec_id long, label int, signs long, vector array<double>")
    numbered = global_rank(chosen, [F.col(c) for c in ("label", "signs", "vec_id", "vector")], "number")
    numbered = numbered.withColumn("tree", F.floor((F.col("number") - 1) / F.lit(size)).cast("long"))
    return common.store(numbered.groupBy("tree").applyInArrow(grow, _TREE), "anchors")


def one_pass(anchors: DataFrame, width: int) -> Anchors:
    """A bounded number of anchors, brought to the driver to be broadcast."""
    t = anchors.toArrow().sort_by([("tree", "ascending"), ("place", "ascending")])
    number, ids, labels, tree, place, parent, edge = (t[c].to_numpy() for c in ("number", "vec_id", "label", "tree", "place", "parent", "edge"))
    vectors = padded(quantised(t["vector"].combine_chunks(), 1)[0], width)
    parents = np.arange(len(ids)) - place + parent
    return Anchors(number, ids, labels, parents, edge, vectors, lengths(vectors))


def mine(
    rows: DataFrame,
    is_anchor: Column,
    scale: float = 256.0,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
    tree: int = TREE,
    most: int = PASS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, label, vector).

    `most` anchors, fewer if their vectors are long, go through the executors at a time.
    """
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("vector").cast("array<double>"))
    rows = rows.where("vec_id is not null and label is not null and vector is not null")
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    anchors = anchor_trees(rows, is_anchor, scale, tree)
    trees = anchors.agg(F.max("tree")).first()[0]
    step = max(1, min(most, PASS_BYTES // (8 * max(width, 1))) // tree)
    results = []
    for first in range(0, -1 if trees is None else trees + 1, step):
        here = anchors.where((F.col("tree") >= first) & (F.col("tree") < first + step))
        some = one_pass(here, width)
        # one more than asked for: the anchor is its own best row, or is beaten by that many others
        found = first_per_group(best_positives(rows, some, scale, positives + 1), ["anchor"], [F.desc("score"), "vec_id"], positives + 1)
        found = found.toArrow().sort_by([("anchor", "ascending"), ("score", "descending"), ("vec_id", "ascending")])
        chosen = without_self(some, found, positives)
        lists = [s for s, _ in chosen]
        hits = best_negatives(rows, some, lists, scale, negatives, window)
        hits = first_per_group(hits, ["anchor", "place"], [F.desc("score"), "vec_id"], negatives)
        rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id"))
        hits = hits.withColumn("rank", rank)
        known = pa.table(
            {
                "anchor": np.repeat(some.number, [len(s) for s in lists]),
                "anchor_id": np.repeat(some.ids, [len(s) for s in lists]),
                "place": joined([np.arange(len(s)) for s in lists]),
                "positive_id": joined([i for _, i in chosen]),
                "positive_score": joined(lists),
            }
        )
        known = rows.sparkSession.createDataFrame(known)
        results.append(
            common.store(
                hits.join(known, ["anchor", "place"]).select(
                    "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score"),
                ),
                "negatives",
            )
        )
    if not results:
        return rows.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def without_self(anchors: Anchors, found: pa.Table, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(scores, ids) of each anchor's positives: of its best rows, one that looks like the anchor itself is the anchor."""
    numbers, scores, ids = (found[c].to_numpy() for c in ("anchor", "score", "vec_id"))
    out = []
    for k, number in enumerate(anchors.number.tolist()):
        a, b = np.searchsorted(numbers, [number, number + 1])
        own = Block(anchors.ids[k : k + 1], anchors.labels[k : k + 1], anchors.vectors[k : k + 1], anchors.norms[k : k + 1])
        self_score = int(own.scores(anchors.vectors[k], anchors.norms[k])[0])
        s, i = scores[a:b], ids[a:b]
        me = np.flatnonzero((s == self_score) & (i == anchors.ids[k]))[:1]
        out.append((np.delete(s, me)[:size], np.delete(i, me)[:size]))
    return out


def op13_anchor_trees(spark: SparkSession, folder: str) -> DataFrame:
    rows = common.read(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return mine(rows, F.col("vec_id") % 100 == 0)


#: The same rows in SQL.
ORACLE = """
WITH given AS (
  SELECT row_number() OVER () AS r, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS vec_id, a.label = b.label AS same,
    list_dot_product(a.v, b.v)::BIGINT AS score
  FROM given a, given b WHERE a.vec_id % 100 = 0 AND a.r <> b.r
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) AS n
  FROM scored WHERE same QUALIFY n <= 5
), found AS (
  SELECT p.anchor_id, p.vec_id AS positive_id,
    row_number() OVER (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.vec_id, s.b)::INTEGER AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM positives p JOIN scored s ON s.a = p.a AND NOT s.same
    AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT * FROM found WHERE rank <= 10
"""
