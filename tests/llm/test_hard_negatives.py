import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from faultline.llm import hard_negatives as hn


def plain(rows, every, scale=256.0, positives=5, negatives=10):
    ok = []
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((vec_id, label, [math.floor(scale * x) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, (vec_id, label, v) in enumerate(ok):
        if vec_id % every:
            continue
        best = lambda some: sorted((-dot(v, w), j) for j, w in some)
        same = best((j, w) for i, (j, m, w) in enumerate(ok) if i != k and m == label)[:positives]
        other = best((j, w) for j, m, w in ok if m != label)
        for s, j in same:
            hits = [(t, n) for t, n in other if 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(vec_id, j, r, n, -s, -t) for r, (t, n) in enumerate(hits, 1)]
    return sorted(out)


def table(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>").repartition(parts)
    return df.select("*", F.lit("x").alias("anchor"), F.lit(1).alias("score"), F.lit(2).alias("number"), F.lit(3).alias("a.b"))


def found(spark, rows, every, **more):
    return sorted(map(tuple, hn.mine(table(spark, rows), F.col("vec_id") % every == 0, **more).collect()))


def clouds(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    return [(i, int(rng.integers(3)), (centres[i % 6] + spread * rng.standard_normal(dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_against_all_pairs(spark, spread):
    rows = clouds(1, 300, 5, spread)
    assert found(spark, rows, 10, tree=7, most=14) == plain(rows, 10)


def test_nulls_ties_repeats_and_odd_vectors(spark):
    rng = random.Random(2)
    rows = [(i % 40, rng.choice([0, 1, None]), [float(rng.randrange(3)) for _ in range(rng.randrange(4))]) for i in range(160)]
    rows += [(0, 1, None), (None, 1, [1.0]), (10, 0, [float("nan"), 1.0]), (10, 0, [None, 1.0]), (10, 0, [float("inf")])]
    rows += [(20, 1, [1.0, 2.0])] * 9 + [(30, 1, [1e300, 1e300])]
    assert found(spark, rows[:-1], 10, tree=4) == plain(rows[:-1], 10)
    assert found(spark, [], 10) == [] and found(spark, [(1, 1, [1.0])], 10) == [] and found(spark, [(10, 1, [1.0])], 10) == []
    assert found(spark, rows, 10, tree=4)  # products beyond long stop at its ends


def test_exact_beyond_doubles(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [float(rng.randrange(-(2**28), 2**28)) for _ in range(3)]) for i in range(60)]
    assert found(spark, rows, 5, scale=1.0) == plain(rows, 5, scale=1.0)


def test_bounds_spare_scores(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = 10 * rng.standard_normal((40, 8))
    vectors = np.round(100 * np.repeat(centres, 50, axis=0) + rng.standard_normal((2000, 8)))
    block = hn.Block(np.arange(2000), np.zeros(2000, int), vectors, np.sqrt((vectors**2).sum(axis=1)))
    own = vectors[:100:2]
    order, parents, edges = hn.spanning_tree(own)
    place = np.argsort(order)
    norms = np.sqrt((own[order] ** 2).sum(axis=1))
    a = hn.Anchors(np.arange(50), np.arange(50), np.zeros(50, int), place[parents], np.array(edges), own[order], norms)
    seen = []
    monkeypatch.setattr(hn.Block, "scores", lambda self, v, n, real=hn.Block.scores: seen.append(len(self.ids)) or real(self, v, n))
    all_rows = np.ones(2000, bool)
    for i, at, scores in a.walk(hn.trees_of(a), block, lambda i: (0.9 * norms[i] ** 2, np.inf, all_rows)):
        exact = vectors @ own[order[i]]
        want = np.flatnonzero(exact >= 0.9 * norms[i] ** 2)
        assert set(want) <= set(at.tolist()) and np.array_equal(scores, exact[at])
    assert sum(seen) < 0.4 * 50 * 2000
    lengths = np.sqrt(((own[:, None] - own[None]) ** 2).sum(axis=2))
    assert all(abs(lengths[i, p] - e) < 1e-6 for i, p, e in zip(order, parents, edges, strict=True))
