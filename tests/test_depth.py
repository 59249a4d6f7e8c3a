"""Trees of any depth, graphs on both sides of the size where one task finishes them."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators import tree as T

TREE = "id string, parent string"


def chain(n, extra=()):
    return [("n0", None), *((f"n{k}", f"n{k - 1}") for k in range(1, n)), *extra]


@pytest.mark.parametrize("n", [1, 2, 80, 300])
def test_closure_and_cycles_at_any_depth(spark, n):
    tree = spark.createDataFrame(chain(n), TREE)
    above = T.closure(tree)
    assert above.count() == n * (n - 1) // 2
    assert T.depths(tree, above).agg(F.max("depth")).first()[0] == n - 1
    assert T.on_cycles(tree).count() == 0
    loop = spark.createDataFrame(chain(n, [("a", "c"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("own", "own")]), TREE)
    assert {r["id"] for r in T.on_cycles(loop).collect()} == {"a", "b", "c", "d", "e", "own"}
    if n > 2:
        with pytest.raises(ValueError, match="cycle"):
            T.closure(loop)


def ids_by_force(nodes, taken):
    out = {}
    for d, up, _, s in sorted(nodes, key=lambda r: (r[2], r[0])):
        group = sorted((x, y) for x, p, _, y in nodes if p == up)
        if d == group[0][0]:
            got = T.allocate_in_group(out.get(up), [x for x, _ in group], [y for _, y in group], set(taken))
            out |= dict(zip([x for x, _ in group], got, strict=True))
    return out


@pytest.mark.parametrize("depth", [4, 80, 300])
def test_ids_at_any_depth(spark, depth):
    dirs = [("/".join(["d"] * (k + 1)), "/".join(["d"] * k) or None, k + 1, "d") for k in range(depth)]
    dirs += [("d/D", "d", 2, "d"), ("d/D/x", "d/D", 3, "x"), ("e", None, 1, "d"), ("e/y", "e", 2, "y")]
    nodes = spark.createDataFrame(dirs, "dir string, parent_dir string, depth int, slug string")
    # taken ids bar a root, a child of the root's new name, and names below
    for taken in ([], ["d"], ["d", "d-2/d", "d-2/d-3", "d-2/d-2/x", "zz/d"]):
        got = T.allocate_ids(nodes, spark.createDataFrame([(t,) for t in taken], "id string") if taken else None).collect()
        want = ids_by_force(dirs, taken)
        assert {r["dir"]: r["id"] for r in got} == want and len(got) == len(dirs)
        assert all(r["parent_id"] == (r["id"].rpartition("/")[0] or None) for r in got)


def strong_by_force(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            new = reach[b] - reach[a]
            if new:
                reach[a] |= new
                changed = True
    return {frozenset(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes} - {frozenset([n]) for n in nodes}


@pytest.mark.parametrize("small", [0, 25, 10**6])
def test_strong_components_do_not_depend_on_the_size_of_the_rest(spark, small):
    r = random.Random(4)
    pairs = [(f"v{r.randrange(40):02d}", f"v{r.randrange(40):02d}") for _ in range(60)]
    pairs += [(f"w{k:03d}", f"w{(k + 1) % 30:03d}") for k in range(30)]
    got = G.strong_components(spark.createDataFrame(pairs, "src string, dst string"), small=small).groupBy("component").agg(F.collect_set("node").alias("g")).collect()
    assert {frozenset(x["g"]) for x in got} == strong_by_force([p for p in pairs if p[0] != p[1]])
    assert all(x["component"] == min(x["g"]) for x in got)


def test_tarjan_walks_long_chains():
    import pandas as pd

    n = 50_000
    ring = pd.DataFrame({"src": list(range(n)), "dst": [*range(1, n), 0]})
    assert len(G._tarjan(ring)) == n


def test_seam_density_against_force(spark):
    r = random.Random(9)
    tree = [("t0", None), ("u0", None)] + [(f"t{k}", f"t{r.randrange(k)}") for k in range(1, 40)] + [(f"u{k}", f"u{r.randrange(k)}") for k in range(1, 5)]
    up = dict(tree)

    def line(n):
        return [n, *line(up[n])] if n is not None and n in up else []

    names = [*up, "outside"]
    edges = [(r.choice(names), r.choice(names)) for _ in range(300)]
    edges += edges[:20] + [("t5", "t5")]
    want = {}
    for n in up:
        inside = sum(n in line(a) and n in line(b) for a, b in edges)
        want[n] = (inside, sum((n in line(a)) != (n in line(b)) for a, b in edges))
    df = spark.createDataFrame(tree, TREE)
    got = G.seam_density(df, T.closure(df), spark.createDataFrame(edges, "src string, dst string")).collect()
    assert {x["id"]: (x["internal"], x["crossing"]) for x in got} == want


def test_children_and_segments(spark):
    tree = spark.createDataFrame(chain(4, [("m", "n1")]), TREE)
    ids = spark.createDataFrame([("n1",), ("n1",), ("ghost",)], "id string")
    assert sorted(tuple(r) for r in T.children(tree, ids).collect()) == [("n1", "m"), ("n1", "n2")]
    c = spark.createDataFrame([("n1", ["a", "b"]), ("n2", ["c"])], "id string, paths array<string>")
    assert sorted(tuple(r) for r in T.segments(c, ids).collect()) == [("n1", "a"), ("n1", "b")]
