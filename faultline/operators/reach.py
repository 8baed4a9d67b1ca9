"""Reachability in directed graphs by doubling, with cycles collapsed into components.

``steps`` holds the pairs that a walk of exactly 2^k edges joins, and squaring it doubles the length. ``known`` holds the
pairs that fewer edges join; extended by ``steps`` it covers twice the length as well. So a graph of depth d takes about log2(d)
rounds of two joins each, and in a tree every pair is derived once. Nodes that reach each other are one component: as soon as
a node reaches itself, the nodes of its cycle are replaced by the smallest of them and the rounds start again on the smaller graph.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import checkpoint

#: Layers of pairs that are united before they are written as one.
LAYERS = 4
#: Squaring stops when it would derive more pairs than this many times the edges; single edges go on from there.
GROWTH = 16


@dataclass(frozen=True)
class Closure:
    """``members`` (node, component) of every node with an edge; ``pairs`` (up, down) of distinct components."""

    members: DataFrame
    pairs: DataFrame
    rounds: int

    def node_pairs(self) -> DataFrame:
        """(origin, asset) for every two distinct nodes of which the first reaches the second."""
        up = self.members.select(F.col("node").alias("origin"), F.col("component").alias("up"))
        down = self.members.select(F.col("node").alias("asset"), F.col("component").alias("down"))
        across = self.pairs.join(up, "up").join(down, "down").select("origin", "asset")
        inside = up.join(down, F.col("up") == F.col("down")).where("origin <> asset").select("origin", "asset")
        return across.unionByName(inside)

    def sums(self, weights: dict[str, DataFrame]) -> DataFrame:
        """(origin, nodes, one sum for each table): how many nodes each node reaches, and the sum of (node, weight) over
        them and itself. Everything is added up per component first, so members of a component don't meet each other."""
        names = list(weights)
        table = self.members.withColumn("nodes", F.lit(1).cast("bigint"))
        for name, rows in weights.items():
            table = table.join(rows.select("node", F.col("weight").alias(name)), "node", "left")
        own = table.groupBy("component").agg(
            F.sum("nodes").alias("nodes"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]
        )
        below = self.pairs.join(own.withColumnRenamed("component", "down"), "down").select(
            F.col("up").alias("component"), "nodes", *names
        )
        total = below.unionByName(own).groupBy("component").agg(*[F.sum(n).alias(n) for n in ["nodes", *names]])
        found = self.members.join(total, "component").select(
            F.col("node").alias("origin"), (F.col("nodes") - 1).alias("nodes"), *names
        )
        return found.where("nodes > 0")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _missing(rows: DataFrame, layers: list[DataFrame]) -> DataFrame:
    for layer in layers:
        rows = rows.join(layer, ["up", "down"], "left_anti")
    return rows


def _extend(pairs: DataFrame, steps: DataFrame) -> DataFrame:
    ahead = steps.select(F.col("up").alias("middle"), F.col("down").alias("end"))
    return pairs.withColumnRenamed("down", "middle").join(ahead, "middle").select("up", F.col("end").alias("down"))


def _doublings(steps: DataFrame, edges: int) -> bool:
    """Whether squaring derives a bounded number of pairs: a hub with many edges on both sides may derive far too many."""
    into = steps.groupBy(F.col("down").alias("middle")).agg(F.count(F.lit(1)).alias("n"))
    out = steps.groupBy(F.col("up").alias("middle")).agg(F.count(F.lit(1)).alias("m"))
    derived = into.join(out, "middle").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    return derived <= GROWTH * max(edges, 1)


def collapse_cycles(mutual: DataFrame) -> DataFrame:
    """(node, into): the smallest node that each node of a two-way pair is known to share a cycle with, itself included."""
    return mutual.groupBy(F.col("up").alias("node")).agg(F.min("down").alias("least")).select(
        "node", F.least("node", "least").alias("into")
    )


def _renamed(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    names = names.select(F.col("node").alias("_name"), F.col("into").alias("_into"))
    joined = rows.join(names, F.col(column) == F.col("_name"), "left")
    return joined.withColumn(column, F.coalesce("_into", column)).select(*rows.columns)


def _opposite(edges: DataFrame) -> DataFrame | None:
    """How to collapse pairs of opposite edges: these are cheap to find, and without them dense graphs become small."""
    back = edges.select(F.col("down").alias("up"), F.col("up").alias("down"))
    mutual = edges.join(back, ["up", "down"], "left_semi")
    return collapse_cycles(mutual) if mutual.head(1) else None


def closure(edges: DataFrame) -> Closure:
    """All reachable pairs of (up, down) edges."""
    edges = checkpoint(edges.where("up <> down").distinct())
    nodes = edges.select(F.col("up").alias("node")).unionByName(edges.select(F.col("down").alias("node"))).distinct()
    members = nodes.select("node", F.col("node").alias("component"))
    rounds, names = 0, _opposite(edges)
    while True:
        while names is not None:
            rounds += 1
            members = checkpoint(_renamed(members, names, "component"))
            edges = checkpoint(_renamed(_renamed(edges, names, "up"), names, "down").where("up <> down").distinct())
            names = _opposite(edges)
        pairs, names, more = _grow(edges, None)
        rounds += more
        if names is None:
            return Closure(members, pairs, rounds)


def _grow(edges: DataFrame, origins: DataFrame | None) -> tuple[DataFrame, DataFrame | None, int]:
    """(pairs, names of nodes on cycles, rounds). Without origins it ends at the first cycle and says how to collapse it."""
    steps, layers, rounds = edges, [], 0
    n_edges, doubling = edges.count(), True
    newest = None
    while True:
        rounds += 1
        if origins is None:
            start = steps
        else:
            start = origins.select(F.col("origin").alias("up"), F.col("origin").alias("middle")).join(
                steps.select(F.col("up").alias("middle"), "down"), "middle"
            ).select("up", "down")
        if doubling:
            found = _union([start, *[_extend(layer, steps) for layer in layers]])
        else:  # one edge further from the pairs of the last round
            found = _extend(newest, edges)
        newest = checkpoint(_missing(found.distinct(), layers))
        if not newest.head(1):
            return _union(layers) if layers else newest, None, rounds
        layers.append(newest)
        if origins is None and newest.where("up = down").head(1):
            every = _union(layers)
            back = every.select(F.col("down").alias("up"), F.col("up").alias("down"))
            return every, collapse_cycles(every.join(back, ["up", "down"], "left_semi")), rounds
        if doubling:
            doubling = _doublings(steps, n_edges)
            if doubling:
                steps = checkpoint(_extend(steps, steps).distinct())
            else:
                newest = _union(layers)
        if len(layers) > LAYERS:
            layers = [checkpoint(_union(layers))]


def reached_from(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """(origin, asset) for the given origins (one ``origin`` column); an origin is not its own asset.

    Cycles need no collapsing here: no shortest walk goes round one, so the pairs end with the longest of these.
    """
    edges = checkpoint(edges.where("up <> down").distinct())
    pairs, _, _ = _grow(edges, checkpoint(origins.distinct()))
    return pairs.where("up <> down").select(F.col("up").alias("origin"), F.col("down").alias("asset"))
