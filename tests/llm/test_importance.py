import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from faultline.llm import importance as im

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def plain(docs, bench):
    feats = [(i, *plain_features(t)) for i, t in docs]
    s = Counter(b for _, _, f in feats for b in f)
    t = Counter(b for _, x in bench for b in plain_features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000))))
    rows = []
    for i, n, f in feats:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        rows.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((-r[4], -(2**63) if r[0] is None else r[0], r[2]) for r in rows if r[1] >= 20)
    k = 5 * len(may) // 100
    drawn = Counter(may[:k])
    place = {key: may.index(key) for key in drawn}
    out = []
    for i, n, f, w, score in rows:
        key = (-score, -(2**63) if i is None else i, f)
        rank = None
        if n >= 20 and drawn[key]:
            drawn[key] -= 1
            place[key] += 1
            rank = place[key]
        out.append((i, f, w, score, rank))
    return out


def some_docs(seed, n):
    rng = random.Random(seed)
    words = ["The", "été", "a", "x1", "日本語", "B-c", "long" * 20, "z" * 49, "Über,ß", "q"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(n)]
    return [*docs, (n, None), (n + 1, ""), (None, "no id " * 30), (3, docs[3][1]), (3, docs[3][1]), (7, "word " * 20000), (n + 2, "k" * 70000)]


def test_crc_of_runs():
    texts = ["", "a", "A b C d", "x" * 5000 + " y " + "é" * 30, "n\x00m k 0Z"] + [t or "" for _, t in some_docs(4, 30)]
    n_words, text, bucket = im.features([t.encode() for t in texts])
    for i, t in enumerate(texts):
        n, want = plain_features(t)
        assert n_words[i] == n and sorted(bucket[text == i].tolist()) == sorted(want), i


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_draw(make_docs, seed):
    docs, bench = some_docs(seed, 400), some_docs(seed + 10, 20)
    key = lambda r: tuple((x is not None, x) for x in r)
    found = im.resample(make_docs(docs), make_docs(bench))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain(docs, bench), key=key)


def test_hot_key_and_empty_tables(make_docs):
    docs = [(5, "same words in a row " * 8)] * 300 + some_docs(5, 100)
    found = im.resample(make_docs(docs), make_docs([]))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain(docs, []), key=key)
    assert im.resample(make_docs([]), make_docs([])).count() == 0


def test_kth_key(spark):
    rng = np.random.default_rng(1)
    values = [(int(a), int(b)) for a, b in zip(rng.integers(0, 9, 500), rng.integers(0, 50, 500), strict=True)]
    rows = spark.createDataFrame(values, "a long, b long").repartition(7)
    for k in (1, 2, 250, 499, 500):
        assert tuple(im.kth_key(rows, ["a", "b"], k, pivots=3)) == sorted(values)[k - 1]
    with pytest.raises(ValueError):
        im.kth_key(rows, ["a", "b"], 501)
