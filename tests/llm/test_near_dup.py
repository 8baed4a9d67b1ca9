import random

import numpy as np
import pytest

from faultline.llm import common, near_dup
from faultline.llm.near_dup import Rule


def shingle_set(text, width):
    words = ("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).encode().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, rule):
    """Expected {doc_id: (set size, component)} from all pairs."""
    sets = {i: shingle_set(t, rule.width) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            inter = len(sets[a] & sets[b])
            union = len(sets[a] | sets[b])
            if union and 100 * inter >= rule.percent * union:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one TWO"), (5, "one"), (6, "x " * 4000), (7, "x y"), (None, "one two")]
    i = 10
    for size in (1, 2, 3, 30, 80):
        for _ in range(3):
            base = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([20, 60, 200]))]
            for _ in range(size):
                rows.append((i, edited(rng, base, rng.randrange(1 + len(base) // 12))))
                i += 1
    rows += [(i + k, "same text for everyone here") for k in range(40)]
    rows += [(3, "One two"), (3, "One two")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rule", [Rule(3, 85), Rule()])
def test_components_match_all_pairs(spark, make_docs, rule):
    rows = corpus(rule.width)
    expected = brute(rows, rule)
    found = near_dup.components(make_docs(rows), rule).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
    left = near_dup.deduplicate(make_docs(rows), rule)
    assert left.columns == make_docs(rows).columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (_, c) in expected.items() if i == c) and ids.count(None) == 1


def test_empty_table(make_docs):
    assert near_dup.components(make_docs([]), Rule()).count() == 0
    assert near_dup.deduplicate(make_docs([])).count() == 0


def test_long_chain_is_one_component(spark, make_docs):
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 5 : i * 5 + 100])) for i in range(60)]
    found = near_dup.components(make_docs(rows), Rule(3, 85)).collect()
    assert {r.component_id for r in found} == {c for _, c in brute(rows, Rule(3, 85)).values()}


def test_signature_estimates_similarity_and_stops_early():
    rng = np.random.default_rng(5)
    for n, shared in ((40, 30), (400, 300), (3000, 2400), (1, 1)):
        both = rng.integers(0, 2**63, size=2 * n, dtype=np.int64).view(np.uint64)
        a, b = both[:n], np.concatenate([both[:shared], both[n : 2 * n - shared]])
        true = shared / len(set(a.tolist()) | set(b.tolist()))
        text = np.repeat([0, 1], [len(a), len(b)])
        sig = near_dup.super_minhash(text, np.concatenate([a, b]), 2, 1024)
        assert abs((sig[0] == sig[1]).mean() - true) < 0.06
        assert len(set((sig[0] >> np.uint64(32)).tolist())) <= 1024 and (sig < np.iinfo(np.uint64).max).all()


def test_words_match_split():
    rows = [b"", b" a bb\x0bccc ", "é　ü x\x00y".encode(), b"\n", b"abc" * 1000]
    words = common.Words(rows)
    got = [bytes(words.data[a:b]) for a, b in zip(words.start, words.end)]
    assert got == [w for r in rows for w in r.split()] and words.count.tolist() == [len(r.split()) for r in rows]
    again = common.Words([b"x ccc abc", b"abc"])
    assert again.hashes()[2] == again.hashes()[3] and again.hashes()[1] == words.hashes()[2]
    assert len(set(words.hashes().tolist())) == len(set(got))
