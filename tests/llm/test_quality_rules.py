import collections
import hashlib
import math
import random
import re

from faultline.llm import quality_rules as qr

WORD = re.compile(qr.WORD)


def tokens(text):
    out, kind = [], None
    for c in text:
        now = "gap" if c in " \t\n\x0b\x0c\r" else "word" if c.isalpha() or c.isdigit() else "other"
        if now == "gap":
            kind = None
            continue
        if now == kind:
            out[-1] += c
        else:
            out.append(c)
        kind = now
    return out


def grams(text):
    t = tokens(text)
    return [hashlib.md5(g.encode()).hexdigest()[: qr.DIGITS] for g in [*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))]]


def brute_base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in qr.SYMBOLS for c in text), dup, len(covered), failed


def brute(rows, trusted):
    raw, target = collections.Counter(), collections.Counter()
    for i, text in rows:
        for g in grams(text or ""):
            raw[g] += 1
            target[g] += i in trusted
    a, b = sum(raw.values()), sum(target.values())
    weight = {
        g: round(1e6 * (math.log((target[g] + 1) / (b + qr.BUCKETS)) - math.log((raw[g] + 1) / (a + qr.BUCKETS)))) if b else 0 for g in raw
    }
    out = []
    for i, text in rows:
        g = grams(text or "")
        base = brute_base(text)
        out.append((i, *base, not base[-1] and bool(g) and sum(weight[x] for x in g) >= qr.THRESHOLD * len(g)))
    return out


def corpus():
    rng = random.Random(3)
    clean = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = [rng.choice(clean) for _ in range(rng.choice([3, 49, 50, 80, 120]))]
        if i % 5 == 4:
            words = [f"{w}{rng.choice(['###', '$$$', '%%'])}" for w in words]
        rows.append((i, " ".join(words)))
    rows += [
        (100, None), (101, ""), (102, " \t\n\x0b\x0c\r "), (103, "a b c " * 30), (104, "é ü　x y # * \U0001f600 |\n é ü \n é ü "),
        (105, "\n".join(["same line here", "", "other", "same line here", " same line here"] * 3)), (106, "z" * 50000),
        (107, " ".join(f"q{k % 700}" for k in range(3000))), (0, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]),
    ]
    return rows


def test_matches_brute_force(spark, make_docs):
    rows = corpus()
    for trusted in ({i for i in range(60) if i % 5 != 4}, set()):
        ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
        found = qr.verdicts(make_docs(rows), ids).select("doc_id", *qr.COUNTS, "base_failed", "kept")
        key = lambda r: tuple((x is not None, x) for x in r)
        assert sorted(map(tuple, found.collect()), key=key) == sorted(brute(rows, trusted), key=key)
    assert "MapIn" not in found._jdf.queryExecution().toString() and "Python" not in found._jdf.queryExecution().toString()


def test_filter_keeps_columns_and_empty_tables(spark, make_docs):
    ids = spark.createDataFrame([(i,) for i in range(60) if i % 5 != 4], "doc_id long")
    docs = make_docs(corpus())
    left = qr.keep_good(docs, ids)
    assert left.columns == docs.columns
    expected = [r[0] for r in brute(corpus(), {i for i in range(60) if i % 5 != 4}) if r[-1]]
    key = lambda x: (x is not None, x)
    assert sorted((r.doc_id for r in left.collect()), key=key) == sorted(expected, key=key)
    assert qr.verdicts(make_docs([]), ids).count() == 0 and qr.keep_good(make_docs([]), ids.limit(0)).count() == 0
