import random

import pytest

from faultline.operators import reach


def walk(edges):
    out = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
    found = set()
    for a in out:
        seen, todo = set(), [a]
        while todo:
            for c in out.get(todo.pop(), ()):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        found |= {(a, c) for c in seen if c != a}
    return found


def frame(spark, edges):
    return spark.createDataFrame(edges, "up string, down string")


def pairs(df):
    rows = [tuple(r) for r in df.select("origin", "asset").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def name(i):
    return f"N{i:04d}"


def random_graph(seed, nodes, edges):
    rng = random.Random(seed)
    return [(name(rng.randrange(nodes)), name(rng.randrange(nodes))) for _ in range(edges)]


GRAPHS = {
    "empty": [],
    "loop only": [("a", "a")],
    "two cycles joined": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("x", "a"), ("a", "b")],
    "cycle of seven": [(name(i), name((i + 1) % 7)) for i in range(7)] + [(name(3), "out")],
    "complete": [(name(i), name(j)) for i in range(9) for j in range(9)],
    "sparse": random_graph(1, 40, 45),
    "dense": random_graph(2, 25, 70),
}


@pytest.mark.parametrize("case", GRAPHS)
def test_all_pairs(spark, case):
    edges = GRAPHS[case]
    found = reach.closure(frame(spark, edges))
    want = walk(edges)
    assert pairs(found.node_pairs()) == want
    weight = frame(spark, edges).selectExpr("down AS node").distinct().selectExpr("node", "CAST(2 AS BIGINT) AS weight")
    hit = {b for _, b in edges}
    sums = {r.origin: (r.nodes, r.w) for r in found.sums({"w": weight}).collect()}
    assert sums == {
        a: (len(below), sum(2 for c in below | {a} if c in hit))
        for a in {a for a, _ in want}
        for below in [{b for x, b in want if x == a}]
    }


@pytest.mark.parametrize("case", ["two cycles joined", "dense", "sparse"])
def test_given_origins(spark, case, monkeypatch):
    edges = GRAPHS[case]
    origins = sorted({a for a, _ in edges})[:3] + ["unknown"]
    df = spark.createDataFrame([(o,) for o in origins * 2], "origin string")
    want = {(a, b) for a, b in walk(edges) if a in origins}
    assert pairs(reach.reached_from(frame(spark, edges), df)) == want
    monkeypatch.setattr(reach, "GROWTH", 0)  # as at a hub: single edges from the first round on
    assert pairs(reach.reached_from(frame(spark, edges), df)) == want


def test_deep_chain_takes_few_rounds(spark):
    edges = [(name(i), name(i + 1)) for i in range(1000)]
    found = reach.closure(frame(spark, edges))
    assert found.rounds <= 11
    assert found.pairs.count() == 1000 * 1001 // 2


def test_a_hub_is_not_squared(spark):
    edges = [(f"a{i}", "hub") for i in range(60)] + [("hub", f"b{i}") for i in range(60)]
    assert not reach._doublings(frame(spark, edges), len(edges))
    found = reach.closure(frame(spark, edges))
    assert found.pairs.count() == 60 * 60 + 120 and pairs(found.node_pairs()) == walk(edges)


def all_paths(edges, most):
    edges = [e for e in edges if e[0] != e[1]]
    ahead = {}
    for k, (a, b) in enumerate(edges):
        ahead.setdefault(a, []).append((b, f"D{k}"))
    out, todo = [], [([a], []) for a in sorted({a for a, _ in edges} - {b for _, b in edges})]
    while todo:
        nodes, ids = todo.pop()
        nexts = ahead.get(nodes[-1], [])
        if not nexts:
            out.append((nodes, ids, "root"))
        elif len(ids) == most:
            out.append((nodes, ids, "limit"))
        else:
            for b, k in nexts:
                if b in nodes:
                    out.append((nodes, [*ids, k], "cycle"))
                else:
                    todo.append(([*nodes, b], [*ids, k]))
    return sorted(out)


@pytest.mark.parametrize("most", [3, 32])
def test_paths(spark, most):
    from faultline.operators import graph

    edges = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("c", "e"), ("x", "c"), ("e", "e"), ("r", "s"), ("s", "r"), ("e", "f"), ("f", "g")]
    rows = [(f"D{k}", a, b) for k, (a, b) in enumerate(e for e in edges if e[0] != e[1])] + [("loop", "e", "e")]
    df = spark.createDataFrame(rows, "dependency_id string, dependent_asset_id string, dependency_asset_id string")
    counts = spark.createDataFrame([("a", 5), ("c", 2), ("g", 1)], "asset string, n long")
    found = graph.enumerated_paths(df, counts, max_edges=most).collect()
    assert sorted((r.nodes, r.dependency_ids, r.ended) for r in found) == all_paths(edges, most)
    weight = {"a": 5, "c": 2, "g": 1}
    assert all(r.active_incident_count == sum(weight.get(n, 0) for n in r.nodes) and r.length == len(r.dependency_ids) for r in found)
    assert graph.enumerated_paths(df.limit(0), counts).count() == 0
