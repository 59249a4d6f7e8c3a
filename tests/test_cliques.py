"""Maximal cliques: brute force, one large clique, hubs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph as G


def cliques_by_force(pairs, least):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found = []

    def grow(members, open_, shut):
        if not open_ and not shut:
            found.append(tuple(sorted(members)))
        for n in sorted(open_):
            grow(members | {n}, open_ & near[n], shut & near[n])
            open_ = open_ - {n}
            shut = shut | {n}

    grow(frozenset(), set(near), set())
    return sorted(c for c in found if len(c) >= least)


def run(spark, pairs, least=3, kind="string"):
    return sorted(tuple(r["members"]) for r in G.maximal_cliques(spark.createDataFrame(pairs, f"src {kind}, dst {kind}"), least).collect())


@pytest.mark.parametrize(("seed", "nodes", "edges", "least"), [(1, 8, 18, 3), (2, 14, 50, 2), (3, 25, 150, 3), (4, 30, 60, 4), (5, 12, 60, 2)])
def test_against_force(spark, seed, nodes, edges, least):
    r = random.Random(seed)
    pairs = [(f"v{r.randrange(nodes)}", f"v{r.randrange(nodes)}") for _ in range(edges)]
    # a hub whose neighbours fall into pairs, and a chain
    pairs += [("hub", f"h{k}") for k in range(20)] + [(f"h{k}", f"h{k + 1}") for k in range(0, 20, 2)] + [("hub", "v0"), ("v0", "h0")]
    assert run(spark, pairs, least) == cliques_by_force(pairs, least)


def test_numbers_and_nothing(spark):
    assert run(spark, [(1, 2), (2, 3), (3, 1), (3, 3), (10, 9)], 2, "long") == [(1, 2, 3), (9, 10)]
    assert run(spark, [(1, 1)], 2, "long") == [] and run(spark, [], 3, "long") == []


def test_a_clique_of_forty_is_one_row_a_node(spark):
    pairs = [(f"c{a:02d}", f"c{b:02d}") for a, b in itertools.combinations(range(40), 2)]
    assert run(spark, pairs) == [tuple(f"c{k:02d}" for k in range(40))]
    # branches taken: one for each member but the first node's
    near = [((1 << 40) - 1) ^ (1 << k) for k in range(40)]
    assert list(G._branches(near, [], 1)) == [(1 << 40) - 1]
    assert list(G._branches(near, [(1 << 40) - 1], 1)) == []


def test_a_hub_does_not_copy_its_neighbours(spark):
    n = 20_000
    spokes = spark.range(n).select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"))
    rim = spark.range(0, n, 2).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    layers = G.peeled(spokes.union(rim).union(spokes.select("dst", "src")).union(rim.select("dst", "src")).toDF("src", "dst"))
    last = layers.orderBy(F.desc("layer")).first()
    assert last["node"] == -1 and last["layer"] > 0 and layers.count() == n + 1
    got = G.maximal_cliques(spokes.union(rim))
    assert got.count() == n // 2 and got.where(~F.array_contains("members", F.lit(-1).cast("long")) | (F.size("members") != 3)).count() == 0
