"""Graph analysis over ``edges(src, dst)``: strongly connected groups, cliques, seam density, bisection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .edges import is_symmetric
from .settle import discard, settle
from .tree import lines

#: Nodes of a group that a bisection is sought for; the cuts are 2 to the power of the nodes.
LEAST_CUT, MOST_CUT = 4, 12


def edge_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, out_degree, in_degree)`` of every node, with or without edges."""
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.select("node").distinct().join(outs, "node", "left").join(ins, "node", "left").select("node", zero("out_degree"), zero("in_degree"))


def _tarjan(edges: pd.DataFrame) -> pd.DataFrame:
    """Strongly connected groups of two nodes and more among a bounded number of edges, by Tarjan's walk with a stack of its own."""
    out: dict = {}
    for a, b in zip(edges["src"].tolist(), edges["dst"].tolist(), strict=True):
        out.setdefault(a, []).append(b)
    index: dict = {}
    low: dict = {}
    open_: list = []
    inside: set = set()
    found = []
    for root in out:
        if root in index:
            continue
        walk = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        open_.append(root)
        inside.add(root)
        while walk:
            node, rest = walk[-1]
            step = next((n for n in rest if n not in index or n in inside), None)
            if step is None:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == index[node]:
                    group = [open_.pop()]
                    while group[-1] != node:
                        group.append(open_.pop())
                    inside.difference_update(group)
                    if len(group) > 1:
                        least = min(group)
                        found += [(least, n) for n in group]
            elif step in index:
                low[node] = min(low[node], index[step])
            else:
                index[step] = low[step] = len(index)
                open_.append(step)
                inside.add(step)
                walk.append((step, iter(out.get(step, ()))))
    return pd.DataFrame(found, columns=["component", "node"])


def strong_components(edges: DataFrame, max_rounds: int = 1000, small: int = 200_000) -> DataFrame:
    """``(component, node)`` of the strongly connected groups of two nodes and more, named by their least node.

    Where edges have a ``kind``, those of symmetric kinds are left out: they have no direction. Chains of nodes with one way
    out, then of nodes with one way in, are drawn together by doubling, so that long cycles take rounds by the logarithm of
    their length. Forward colouring: each node takes the least name that reaches it. Within a colour, what reaches the node
    of that name forms a group. Groups are taken out and the rest is coloured anew. As soon as at most ``small`` edges are
    left, one task finishes them by Tarjan's exact walk; the result is the same.
    """
    if "kind" in edges.columns:
        edges = edges.where(~is_symmetric(F.col("kind")))
    live = settle(edges.select("src", "dst").where("src <> dst").distinct())
    return _strong(live, max_rounds, small, ("dst", "src"))


def _trimmed(live: DataFrame, small: int) -> DataFrame:
    """Edges among nodes with a way in and a way out; nodes without are groups of their own. Stops where few edges are left."""
    count = live.count()
    while count > small:
        kept = settle(live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        discard(live)
        live, before = kept, count
        if (count := live.count()) == before:
            break
    return live


def _strong(live: DataFrame, max_rounds: int, small: int, ways: tuple[str, ...]) -> DataFrame:
    """``live``: a settled table of distinct edges, which goes. ``ways``: the ends along which chains are still to be drawn together."""
    spark = live.sparkSession
    kind = live.schema["src"].dataType.simpleString()
    if ways and live.count() > small:
        live = _trimmed(live, small)
        if live.count() > small:
            return _along_chains(live, max_rounds, small, ways)
    found = settle(spark.createDataFrame([], f"component {kind}, node {kind}"))
    for _ in range(max_rounds):
        live = _trimmed(live, small)
        if live.count() <= small:
            rest = live.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(lambda pdf: _tarjan(pdf), found.schema)
            out = settle(found.union(rest))
            discard(found, live)
            return out
        colour = settle(live.select(F.col("src").alias("node")).union(live.select("dst")).distinct().withColumn("colour", F.col("node")))
        while True:
            sent = live.join(colour, live["src"] == colour["node"]).select(F.col("dst").alias("node"), "colour").union(colour.select("node", "colour"))
            nxt = settle(sent.groupBy("node").agg(F.min("colour").alias("colour")))
            same = nxt.join(colour, ["node", "colour"], "left_anti").isEmpty()
            discard(colour)
            colour = nxt
            if same:
                break
        inside = live.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c")), ["dst", "c"]).select("src", "dst", "c")
        inside = settle(inside)
        group = settle(colour.where("node = colour").select("node", "colour"))
        front = group
        while True:
            back = inside.join(front.select(F.col("node").alias("dst"), F.col("colour").alias("c")), ["dst", "c"]).select(F.col("src").alias("node"), F.col("c").alias("colour")).distinct()
            more = settle(back.join(group, ["node", "colour"], "left_anti"))
            if more.isEmpty():
                discard(more)
                break
            both = settle(group.union(more))
            discard(group, front)
            group, front = both, more
        large = group.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1")
        known = settle(found.union(group.join(large, "colour").select(F.col("colour").alias("component"), "node")))
        rest = settle(live.join(group.select(F.col("node").alias("src")), "src", "left_anti").join(group.select(F.col("node").alias("dst")), "dst", "left_anti"))
        discard(found, live, colour, inside, group, front)
        found, live = known, rest
    raise RuntimeError("strong components did not settle")


def _along_chains(live: DataFrame, max_rounds: int, small: int, ways: tuple[str, ...]) -> DataFrame:
    """Strong components by way of the graph in which each node with one way on (towards the end ``ways[0]``) gives way to the end of its chain.

    Chains that never end run into a cycle of such nodes, which is a component: after as many steps as there are nodes, all are
    on it. A node of a chain that ends belongs to its end's component if that component has an edge into the chain at or before
    the node. Jumps double in length each round; marks travel along the same jumps.
    """
    ahead, behind = ways[0], "src" if ways[0] == "dst" else "dst"
    once = live.groupBy(F.col(behind).alias("node")).agg(F.count("*").alias("n"), F.first(ahead).alias("jump")).where("n = 1")
    jumps = [settle(once.select("node", "jump", F.least("node", "jump").alias("low")))]
    if not (count := jumps[0].count()):
        discard(*jumps)
        return _strong(live, max_rounds, small, ways[1:])
    reach = 1
    while True:
        now = jumps[-1]
        far = now.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("low").alias("lower"))
        met = now.join(far, "jump", "left")
        if reach >= count or met.where("next is not null").isEmpty():
            break
        jumps.append(settle(met.select("node", F.coalesce("next", "jump").alias("jump"), F.least("low", "lower").alias("low"))))
        reach *= 2
    now, chained = jumps[-1], jumps[0].select("node")
    # those whose jump is still a node of a chain
    endless = settle(now.join(chained.select(F.col("node").alias("jump")), "jump", "left_semi"))
    on = endless.select(F.col("jump").alias("node")).distinct()
    cycles = settle(endless.join(on, "node", "left_semi").select(F.col("low").alias("component"), "node"))
    ends = settle(now.join(endless.select("node"), "node", "left_anti").select("node", F.col("jump").alias("end")))
    outer = live.join(chained.select(F.col("node").alias(behind)), behind, "left_anti").join(endless.select(F.col("node").alias(ahead)), ahead, "left_anti")
    outer = settle(outer.join(ends.withColumnRenamed("node", ahead), ahead, "left").select(behind, ahead, "end"))
    drawn = settle(outer.select(F.col(behind), F.coalesce("end", ahead).alias(ahead)).where(f"{behind} <> {ahead}").distinct().select("src", "dst"))
    inner = _strong(drawn, max_rounds, small, ways[1:])
    home = inner.select("node", F.col("component").alias("home"))
    entered = outer.where("end is not null").join(home.withColumnsRenamed({"node": behind, "home": "from"}), behind, "left").join(home.withColumnsRenamed({"node": "end", "home": "to"}), "end", "left")
    marked = settle(entered.where(F.coalesce("from", behind) == F.coalesce("to", "end")).select(F.col(ahead).alias("node")).distinct())
    for jump in jumps:
        if marked.isEmpty():
            break
        more = settle(marked.union(marked.join(jump, "node").select(F.col("jump").alias("node")).join(ends.select("node"), "node", "left_semi")).distinct())
        discard(marked)
        marked = more
    joined = marked.join(ends, "node").join(home.withColumnRenamed("node", "end"), "end", "left").select(F.coalesce("home", "end").alias("home"), "node", "end")
    every = inner.select(F.col("component").alias("home"), "node").union(joined.select("home", "node")).union(joined.where("home = end").select("home", "end")).distinct()
    names = every.groupBy("home").agg(F.min("node").alias("component"))
    out = settle(cycles.union(every.join(names, "home").select("component", "node")))
    discard(live, *jumps, endless, cycles, ends, outer, inner, marked)
    return out


def peeled(both: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(node, layer)``: in each layer the nodes whose degree among those left is at most twice the mean.

    More than half of the nodes left go in a layer, so the layers are logarithmic in number, and a node has at most four
    times the graph's degeneracy of neighbours in its own layer and later ones. ``both``: each edge both ways.
    """
    live, layers = both, None
    for layer in range(max_rounds):
        degree = settle(live.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d")))
        mean = degree.agg(F.avg("d")).first()[0]
        if mean is None:
            empty = degree.select("node", F.lit(0).alias("layer"))
            return layers if layers is not None else empty
        gone = degree.where(F.col("d") <= 2 * mean)
        own = gone.select("node", F.lit(layer).alias("layer"))
        layers = own if layers is None else layers.union(own)
        if degree.where(F.col("d") > 2 * mean).isEmpty():
            return layers
        rest = degree.where(F.col("d") > 2 * mean)
        nxt = settle(live.join(rest.select(F.col("node").alias("src")), "src", "left_semi").join(rest.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
        if live is not both:
            discard(live)
        # a node all of whose neighbours went has no edge left, but still a place
        lone = settle(rest.select("node", F.lit(layer + 1).alias("layer")).join(nxt.select(F.col("src").alias("node")).distinct(), "node", "left_anti"))
        layers, live = layers.union(lone), nxt
    raise RuntimeError("the layers did not settle")


def _branches(near: list[int], outer: list[int], least: int):
    """Maximal cliques, as bit masks, among numbered nodes with these neighbours, that no mask of ``outer`` holds whole.

    A branch takes a node that may still join; of all such nodes only those are tried that don't neighbour the pivot,
    the node with most neighbours among them.
    """
    todo = [(0, (1 << len(near)) - 1, 0, outer)]
    while todo:
        members, open_, shut, outside = todo.pop()
        if not open_:
            if not shut and not outside and members.bit_count() >= least:
                yield members
            continue
        if members.bit_count() + open_.bit_count() < least:
            continue
        best, most, rest = 0, -1, open_ | shut
        while rest:
            low = rest & -rest
            rest ^= low
            if (n := (near[low.bit_length() - 1] & open_).bit_count()) > most:
                best, most = near[low.bit_length() - 1], n
        for mask in outside:
            if (n := (mask & open_).bit_count()) > most:
                best, most = mask, n
        rest = open_ & ~best
        while rest:
            low = rest & -rest
            rest ^= low
            own = near[low.bit_length() - 1]
            todo.append((members | low, open_ & own, shut & own, [m for m in outside if m & low]))
            open_ ^= low
            shut |= low


def maximal_cliques(edges: DataFrame, least: int = 3) -> DataFrame:
    """``members`` (sorted) of every maximal clique of at least ``least`` nodes, edges taken both ways.

    Nodes stand in layers of their degree, so that a node has few later neighbours, at most four times the degeneracy. A clique is
    found at its first node: its other members are among that node's later neighbours. What an edge's ends have in common there is
    looked up once; it tells the later end's neighbours within the earlier one's branch, and which later neighbours of the
    later end an earlier node bars from being maximal without it. A node's branch is one row, with the distinct
    sets of barring neighbours only, and grows with a pivot, so that no part of a clique is a row of its own.
    """
    both = settle(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct())
    layer = settle(peeled(both))
    key = lambda n, k: F.struct(F.col(k).alias("k"), F.col(n).alias("n"))
    placed = both.join(layer.select(F.col("node").alias("src"), F.col("layer").alias("ks")), "src").join(layer.select(F.col("node").alias("dst"), F.col("layer").alias("kd")), "dst")
    later = settle(placed.select(key("src", "ks").alias("a"), key("dst", "kd").alias("b")).where("a < b"))
    near = settle(later.groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("p")))
    common = later.join(near, "a").join(near.select(F.col("a").alias("b"), F.col("p").alias("q")), "b", "left")
    common = settle(common.select("a", "b", F.coalesce(F.array_intersect("p", "q"), F.slice("p", 1, 0)).alias("i")))
    inner = common.where(F.size("i") > 0).groupBy("a").agg(F.collect_list(F.struct("b", "i")).alias("inner"))
    barring = common.where(F.size("i") > 0).select(F.col("b").alias("a"), "i").distinct().groupBy("a").agg(F.collect_list("i").alias("outer"))
    rows = near.where(F.size("p") >= least - 1).join(inner, "a", "left").join(barring, "a", "left")
    names = lambda c: F.transform(c, lambda x: x["n"])
    rows = rows.select(F.col("a.n").alias("a"), names("p").alias("p"), F.transform("inner", lambda x: F.struct(x["b"]["n"].alias("b"), names(x["i"]).alias("i"))).alias("inner"), F.transform("outer", names).alias("outer"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for a, p, own, outer in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                place = {n: k for k, n in enumerate(p)}
                adj = [0] * len(p)
                for x in own or ():
                    k = place[x["b"]]
                    for n in x["i"]:
                        adj[k] |= 1 << place[n]
                        adj[place[n]] |= 1 << k
                for mask in _branches(adj, [sum(1 << place[n] for n in m) for m in outer or ()], max(least - 1, 1)):
                    found.append(sorted([a, *(n for k, n in enumerate(p) if mask >> k & 1)]))
                    if len(found) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(found, kind)], names=["members"])
                        found = []
            yield pa.RecordBatch.from_arrays([pa.array(found, kind)], names=["members"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema["p"].dataType)
    out = settle(rows.mapInArrow(run, f"members {rows.schema['p'].dataType.simpleString()}"))
    discard(both, layer, later, near, common)
    return out


def ratio(outside: Column, inside: Column) -> Column:
    """Inner to crossing edges: 0 without any, infinite without crossing ones."""
    inf = F.lit(float("inf"))
    return F.when((inside == 0), F.lit(0.0)).when(outside == 0, inf).otherwise(inside / outside)


def seam_density(tree: DataFrame, above: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, internal, crossing, density)`` for every node of ``tree(id)``; ``above`` is its closure.

    An edge is internal to each node at or above both of its ends, and crosses each at or above one. It is
    internal to the lowest node above both ends and to all above that: so ends and lowest nodes are counted a
    node, and the counts are added up along the closure. Edges meet the tree twice, whatever its depth.
    """
    line = lines(above, tree)
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    met = pairs.join(line.select(F.col("id").alias("src"), F.col("line").alias("a")), "src", "left").join(line.select(F.col("id").alias("dst"), F.col("line").alias("b")), "dst", "left")
    common = F.array_intersect("a", "b")
    met = met.select("n", F.when(F.col("a").isNotNull(), F.col("src")).alias("src"), F.when(F.col("b").isNotNull(), F.col("dst")).alias("dst"), F.when(F.size(common) > 0, F.element_at(common, -1)).alias("low"))
    one = met.select("n", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("end")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("end")), F.struct(F.col("low").alias("node"), F.lit(0).alias("end")))).alias("x")).where("x.node is not null")
    own = one.groupBy("x.node").agg(F.sum(F.col("n") * F.col("x.end")).alias("ends"), F.sum(F.col("n") * (1 - F.col("x.end"))).alias("inside"))
    own = own.join(tree.select(F.col("id").alias("node")), "node")
    spread = own.select(F.col("node").alias("id"), "ends", "inside").union(above.join(own.withColumnRenamed("node", "id"), "id").select(F.col("ancestor").alias("id"), "ends", "inside"))
    counted = spread.groupBy("id").agg(F.sum("inside").alias("internal"), (F.sum("ends") - 2 * F.sum("inside")).alias("crossing"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = tree.select("id").join(counted, "id", "left").select("id", zero("internal").alias("internal"), zero("crossing").alias("crossing"))
    return out.withColumn("density", ratio(F.col("crossing"), F.col("internal")))


def best_bisection(members: DataFrame, edges: DataFrame, least: int = LEAST_CUT, most: int = MOST_CUT) -> DataFrame:
    """``(grp, mask, cross_edges, total_edges, side_a, side_b)``: the cleanest cut of each group's inner edges.

    ``members(grp, node)``; groups of ``least`` to ``most`` nodes. Every cut with two nodes or more on each side is
    tried; ties go to the lowest mask. Kept where at most a fifth of the edges cross. The number of
    cuts a group is bounded by ``2 ** (most - 1)``.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("grp")
    m = members.distinct().withColumn("n", F.count("*").over(w)).where((F.col("n") >= least) & (F.col("n") <= most))
    m = m.withColumn("i", F.row_number().over(w.orderBy("node")) - 1)
    a = m.select("grp", F.col("node").alias("src"), F.col("i").alias("ai"), "n")
    b = m.select("grp", F.col("node").alias("dst"), F.col("i").alias("bi"))
    inner = edges.join(a, "src").join(b, ["grp", "dst"]).select("grp", "n", "ai", "bi")
    groups = inner.groupBy("grp", "n").agg(F.collect_list(F.struct("ai", "bi")).alias("es"))
    # odd masks hold the first node, so each cut comes once
    cuts = groups.withColumn("mask", F.explode(F.expr("sequence(1L, shiftleft(1L, n) - 3, 2L)"))).where((F.bit_count("mask") >= 2) & (F.col("n") - F.bit_count("mask") >= 2))
    side = lambda i: F.pmod(F.expr("1L") * F.floor(F.col("mask") / F.pow(F.lit(2.0), i)), F.lit(2))
    cross = F.size(F.filter("es", lambda e: side(e["ai"]) != side(e["bi"])))
    scored = cuts.select("grp", "n", "mask", cross.alias("cross_edges"), F.size("es").alias("total_edges"))
    best = scored.groupBy("grp").agg(F.min(F.struct("cross_edges", "mask")).alias("b"), F.first("total_edges").alias("total_edges")).where(F.col("b.cross_edges") * 5 <= F.col("total_edges"))
    picked = best.join(m, "grp").withColumn("mask", F.col("b.mask"))
    names = lambda s: F.array_sort(F.collect_list(F.when(side(F.col("i")) == s, F.col("node"))))
    return picked.groupBy("grp", "mask", F.col("b.cross_edges").alias("cross_edges"), "total_edges").agg(names(1).alias("side_a"), names(0).alias("side_b"))
