import math
import random
import re

import numpy as np

from faultline.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def share(wanted, passage):
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {(x,) for x in w}
    want = grams(wanted)
    if not want:
        return 1.0
    have = {tuple(passage[i : i + 3]) for i in range(len(passage) - 2)} | {(x,) for x in passage}
    return len(want & have) / len(want)


def brute(rows, items):
    """Scores every passage against every item."""
    items = [(i, t, words_of(t)) for i, t in items if i is not None and words_of(t)]
    n, mean = len(items), sum(len(w) for _, _, w in items) / len(items)
    df = {}
    for _, _, w in items:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    stride = max(dc.LEAST_STRIDE, max(len(w) for _, _, w in items))
    found = set()
    for k, (_, text) in enumerate(rows):
        w = words_of(text)
        for start in range(0, max(1, len(w)), stride):
            passage = w[start : start + 2 * stride]
            for i, t, iw in items:
                impact = {}
                for x in set(iw):
                    tf = iw.count(x)
                    idf = math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5))
                    impact[x] = idf * tf * (dc.K1 + 1) / (tf + dc.K1 * (1 - dc.B + dc.B * len(iw) / mean))
                score = sum(v for x, v in impact.items() if x in set(passage)) / sum(impact.values())
                q, a = map(words_of, dc.question_and_answer(t))
                if score >= dc.THRESHOLD and share(q, passage) >= dc.OVERLAP and share(a, passage) >= dc.OVERLAP:
                    found.add((k, i))
    return found


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["été", "Über"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(12, 70)) + ("\n" + text(8) if i % 2 else "")) for i in range(60)]
    items += [(100, None), (101, ""), (102, "one"), (None, "lost item"), (103, "two words"), (5, items[5][1])]
    rows = []
    for k in range(120):
        item = items[rng.randrange(60)][1]
        w = item.split(" ")
        kind = k % 6
        if kind == 1:
            w = [x.upper() + "," for x in w]
        elif kind == 2:
            w = [x if rng.random() > 0.1 else "zzz" for x in w]
        elif kind == 3:
            w = w[: len(w) // 2]
        elif kind == 4:
            rng.shuffle(w)
        elif kind == 5:
            w = []
        rows.append((k, " ".join([text(rng.randrange(300)), *w, text(rng.randrange(300))])))
    rows += [(200, None), (201, ""), (202, "one"), (203, "x y z"), (None, items[3][1]), (204, text(6000) + " " + items[7][1]), (204, items[8][1]), (204, items[8][1])]
    return rows, items


def test_matches_brute_force(spark, make_docs):
    rows, items = corpus()
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(rows, items)
    key = lambda x: tuple((y is not None, y) for y in x)
    found = sorted(((r.doc_id, r.item_id) for r in dc.leaks(make_docs(rows), table).collect()), key=key)
    assert found == sorted(((rows[k][0], i) for k, i in expected), key=key) and len(found) > 40
    left = dc.drop_leaks(make_docs(rows), table)
    assert left.columns == make_docs(rows).columns
    assert sorted(((r.doc_id, r.text) for r in left.select("doc_id", "text").collect()), key=lambda x: key((x[0], x[1]))) == sorted(
        (r for k, r in enumerate(rows) if not any(k == x for x, _ in expected)), key=lambda x: key((x[0], x[1]))
    )


def test_shards_give_the_same(spark, make_docs, monkeypatch):
    rows, items = corpus()
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted((str(r.doc_id), r.item_id, round(r.score, 9)) for r in dc.leaks(make_docs(rows), table).collect())
    monkeypatch.setattr(dc, "SHARD_ITEMS", 25)
    assert len(list(dc.shards(table))) == 3
    assert whole == sorted((str(r.doc_id), r.item_id, round(r.score, 9)) for r in dc.leaks(make_docs(rows), table).collect())


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.leaks(make_docs([(1, "a b")]), none).count() == 0 and dc.drop_leaks(make_docs([(1, "a b")]), none).count() == 1
    one = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert dc.leaks(make_docs([]), one).count() == 0
    assert np.array_equal(dc.grams(np.array([3, 3, 1], np.uint64)[:2]), np.array([3], np.uint64))


def test_edited_answers_and_items_without_id(spark, make_docs):
    """One and two changed words in answers of each length; items without id."""
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(900)]
    text = lambda n: " ".join(rng.sample(vocabulary, n))
    items, rows, expected = [], [], set()
    for n in range(1, 21):
        question, answer = text(20), text(n).split()
        items.append((n, f"{question}\n{' '.join(answer)}"))
        edits = [(i,) for i in range(n)] + [(i, k) for i in range(n) for k in range(i)][:40]
        for edit in edits:
            changed = " ".join("zzz" if i in edit else w for i, w in enumerate(answer))
            expected.add((len(rows), n))
            rows.append((len(rows), f"{text(30)} {question} {changed} {text(30)}"))
    items += [(None, text(15)), (None, text(18)), (50, text(30) + "\n" + text(20))]
    expected |= {(len(rows), "hash 0"), (len(rows) + 1, "hash 1")}
    rows += [(len(rows), f"{text(9)} {items[20][1]}"), (len(rows) + 1, items[21][1])]
    # half of a question and an answer whose words are far apart are no leak
    far = " ".join(f"{w} {text(5)}" for w in items[7][1].split("\n")[1].split())
    rows += [(len(rows), f"{' '.join(items[7][1].split()[:12])} {far}"), (len(rows) + 1, text(400))]
    table = spark.createDataFrame(items, "item_id long, text string")
    keys = {r.h: f"hash {r.k}" for r in spark.createDataFrame([(i, t) for i, (_, t) in enumerate(items[20:22])], "k int, t string").selectExpr("k", "xxhash64(t) AS h").collect()}
    found = {(r.doc_id, keys.get(r.item_id, r.item_id)) for r in dc.leaks(make_docs(rows), table, edited=True).collect()}
    assert found == expected
    assert dc.drop_leaks(make_docs(rows), table, edited=True).count() == 2
    plain = {(r.doc_id, keys.get(r.item_id, r.item_id)) for r in dc.leaks(make_docs(rows), table).collect()}
    assert plain < expected
