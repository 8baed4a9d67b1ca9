import math
import random
import zlib

import numpy as np

from faultline.llm import quality_model as qm


def rows_of(n, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("th", "on", "er", "re") for b in ("an", "is", "ed", "ou")]
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        kind = i % 10
        if kind == 0:
            text = [w.upper() + "!!" for w in text]
        elif kind == 5:
            text = [w for w in text for _ in range(10)]
        out.append((i, " ".join(text), int(kind not in (0, 5))))
    return out


def test_updates_match_a_plain_version():
    rows = [(t.encode(), y) for _, t, y in rows_of(40)]
    z, n = {}, {}

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= qm.L1 else -(zi - math.copysign(qm.L1, zi)) / ((qm.BETA + math.sqrt(ni)) / qm.ALPHA + qm.L2)

    for _ in range(qm.PASSES):
        for raw, y in rows:
            _, buckets, size = qm.features([raw])
            x = {qm.DIM: 1.0}
            for b in buckets.tolist():
                x[b] = x.get(b, 0.0) + qm.SCALE / int(size[0])
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
            for i, v in x.items():
                g, w = (p - y) * v, weight(i)
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / qm.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w
                n[i] = n.get(i, 0.0) + g * g
    found = qm.fit(rows)
    assert np.allclose(found[list(z)], [weight(i) for i in z], atol=1e-9)
    assert np.count_nonzero(found) <= len(z)


def test_features():
    text, bucket, size = qm.features([b"", b"a a  b!!", "é é".encode(), b" "])
    assert size.tolist() == [0, 7, 3, 0] and (bucket == qm.TWICE).sum() == 2
    again = qm.features([b"x", b"a a  b!!"])
    assert sorted(again[1][again[0] == 1]) == sorted(bucket[text == 1])


def test_held_out_accuracy(spark, make_docs):
    rows = rows_of(400)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = make_docs([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, "thon !!"), (3, rows[3][1]), (1002, "w " * 40000)])
    weights = qm.train(docs, labels)
    found = qm.quality_scores(docs, weights).withColumn("held_out", qm.held_out()).collect()
    assert len(found) == 405 and all(0 <= r.score <= 1 for r in found)
    label = {i: y for i, _, y in rows}
    held = [r for r in found if r.doc_id in label and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)
    assert len(held) > 60 and np.mean([(r.score >= qm.PREDICT) == label[r.doc_id] for r in held]) > 0.95
    # held-out labels don't matter
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    assert np.array_equal(weights, qm.train(docs, other))


def test_no_labels_and_empty_table(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    weights = qm.train(make_docs([(1, "a")]), none)
    assert [r.score for r in qm.quality_scores(make_docs([(1, "a"), (2, None)]), weights).collect()] == [0.5, 0.5]
    assert qm.quality_scores(make_docs([]), weights).count() == 0
