"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a bounded sample, cut in halves again and again at the median of the two-means
direction, so lists are balanced. Where the sample is too small for the lists, its parts are cut further by executors, each from a
sample of its own. A vector near a boundary stands in several lists. A navigable graph over the
centroids, held in memory, finds the lists near a vector. A query reads the lists whose centroids are no
farther than a ratio times the nearest one; the ratio is calibrated on the sample for a target recall. Every
vector is indexed. Lists longer than a block are dealt to several tasks, and so are the queries of much-read lists.

Equal vectors are searched once: each distinct vector keeps as many of its smallest ids as an answer can hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .collide import key_groups
from .embedding_dedup import usable
from .shared import materialise, tidy


@dataclass(frozen=True)
class AnnParams:
    """``sample_bytes`` bounds the vectors of the driver's fit: ``sample``, or eight a list if that is more, as far as they fit.

    Lists beyond an eighth of that sample are fitted by executors, from about eight vectors a list. ``most_lists`` bounds the centroids,
    which are broadcast; one more for each part that the executors cut may come on top.
    """

    k: int = 5
    sample: int = 20_000
    sample_bytes: int = 96 << 20
    list_size: int = 400
    most_lists: int = 16_384
    replicas: int = 4
    closure: float = 1.10
    recall: float = 0.985
    degree: int = 16
    block: int = 4096
    block_queries: int = 20_000


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Unit centroids of ``lists`` equal parts of ``x``."""
    rng = np.random.Generator(np.random.PCG64(9))
    out: list[np.ndarray] = []

    def cut(part: np.ndarray, n: int) -> None:
        if n <= 1 or len(part) < 2:
            c = part.mean(axis=0)
            out.append(c / max(1e-12, np.linalg.norm(c)))
            return
        a, b = part[rng.integers(len(part))], part[rng.integers(len(part))]
        for _ in range(6):
            near = part @ (a - b) > 0
            if near.all() or not near.any():
                break
            a, b = part[near].mean(axis=0), part[~near].mean(axis=0)
        left = n // 2
        order = np.argsort(part @ (a - b), kind="stable")
        at = len(part) * left // n
        cut(part[order[:at]], left)
        cut(part[order[at:]], n - left)

    cut(x, max(1, min(lists, len(x))))
    return np.stack(out)


class CentroidGraph:
    """Best-first search over centroids along a graph of nearest neighbours and a few far links."""

    def __init__(self, centroids: np.ndarray, degree: int):
        self.c = centroids
        n = len(centroids)
        rng = np.random.Generator(np.random.PCG64(17))
        near = min(degree, n - 1)
        links = np.zeros((n, near + 4), np.int64)
        for lo in range(0, n, 1024):
            d = -(centroids[lo : lo + 1024] @ centroids.T)
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            if near:
                links[lo : lo + 1024, :near] = np.argpartition(d, near - 1, axis=1)[:, :near]
        # a ring keeps the graph connected, random links make it navigable
        links[:, near] = (np.arange(n) + 1) % n
        links[:, near + 1 :] = rng.integers(0, n, (n, 3))
        self.links = links

    def rows_at_once(self) -> int:
        """How many vectors to search for at a time, so that their distances take a bounded space."""
        return max(32, min(1000, 4_000_000 // len(self.c)))

    def search(self, x: np.ndarray, ratio: float, least: int) -> np.ndarray:
        """Distances [len(x), n] from unit vectors to the centroids met; infinite where the search didn't come.

        The search goes on while an unvisited centroid is within ``ratio`` of the nearest or among the ``least`` nearest.
        """
        n, m = len(self.c), len(x)
        dist = np.full((m, n), np.inf)
        open_ = np.full((m, n), np.inf)
        entry = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))
        dist[:, entry] = open_[:, entry] = np.sqrt(np.maximum(0, 2 - 2 * x @ self.c[entry].T))
        rows = np.arange(m)
        while len(rows):
            at = open_[rows].argmin(axis=1)
            best = open_[rows, at]
            known = dist[rows]
            limit = np.maximum(known.min(axis=1) * ratio, np.partition(known, min(least, n) - 1, axis=1)[:, min(least, n) - 1])
            go = np.isfinite(best) & (best <= limit)
            rows, at = rows[go], at[go]
            if not len(rows):
                break
            open_[rows, at] = np.inf
            to = self.links[at]
            d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ikj->ik", x[rows], self.c[to])))
            r = np.repeat(rows, to.shape[1])
            t, d = to.reshape(-1), d.reshape(-1)
            new = np.isinf(dist[r, t])
            dist[r[new], t[new]] = open_[r[new], t[new]] = d[new]
        return dist


def lists_of(dist: np.ndarray, closure: float, replicas: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and lists: each vector's nearest list and up to ``replicas`` in all within ``closure`` of it."""
    n = min(replicas, dist.shape[1])
    at = np.argpartition(dist, n - 1, axis=1)[:, :n]
    d = np.take_along_axis(dist, at, axis=1)
    keep = d <= d.min(axis=1, keepdims=True) * closure + 1e-12
    row, k = np.nonzero(keep)
    return row, at[row, k]


def calibrated_ratio(x: np.ndarray, graph: CentroidGraph, p: AnnParams) -> float:
    """Distance ratio at which sample queries find the target share of their true neighbours in the sample."""
    n = len(graph.c)
    if n == 1 or len(x) <= p.k:
        return 1.0
    pick = np.random.Generator(np.random.PCG64(3)).permutation(len(x))[:400]
    sims = x[pick] @ x.T
    sims[np.arange(len(pick)), pick] = -np.inf
    top = np.argpartition(-sims, p.k - 1, axis=1)[:, : p.k]
    # the lists of the neighbours
    own, back = np.unique(top, return_inverse=True)
    held = np.zeros((len(own), n), bool)
    step = graph.rows_at_once()
    for lo in range(0, len(own), step):
        row, c = lists_of(graph.search(x[own[lo : lo + step]], 1.0, p.replicas), p.closure, p.replicas)
        held[lo + row, c] = True
    d = np.sqrt(np.maximum(0, 2 - 2 * x[pick] @ graph.c.T))
    need = np.stack([np.where(held[at], d, np.inf).min(axis=1) for at in back.reshape(top.shape).T], axis=1) / np.maximum(1e-9, d.min(axis=1))[:, None]
    return float(np.quantile(need, p.recall)) + 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def finer_centroids(distinct: DataFrame, coarse: np.ndarray, lists: int, total: int) -> np.ndarray:
    """About ``lists`` unit centroids: the part of each of ``coarse`` cut by itself.

    ``distinct(node, v)`` are ``total`` vectors of one dimension; about eight a list are picked by their hash, so that runs
    agree. No part has more rows than those picked in all.
    """
    spark = distinct.sparkSession
    shared = spark.sparkContext.broadcast(coarse)
    share = min(1 << 30, -(-(8 * lists << 30) // total))
    # of vectors of one dimension, as many as picked are expected
    per_list = max(1.0, total * share / (1 << 30) / lists)
    picked = distinct.where(F.pmod(F.xxhash64("node", F.lit(4)), F.lit(1 << 30)) < share).select("node", "v")

    def deal(batches):
        for b in batches:
            cells = [(unit(_matrix(b.column(1).slice(lo, 1000))) @ shared.value.T).argmax(axis=1) for lo in range(0, b.num_rows, 1000)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells or [np.empty(0, np.int64)])), *b.columns], names=["cell", "node", "v"])

    def cut(batches):
        for t in key_groups(batches, 1):
            x = unit(_matrix(t.column(2).combine_chunks()))
            c = balanced_centroids(x, max(1, round(len(x) / per_list))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([t.column(0)[0].as_py()] * len(c)), pa.array(range(len(c)), pa.int64()), pa.array(list(c), pa.list_(pa.float32()))], names=["cell", "at", "c"])

    cells = picked.mapInArrow(tidy(deal), "cell bigint, node bigint, v array<double>").repartition("cell").sortWithinPartitions("cell", "node", "v")
    found = cells.mapInArrow(tidy(cut), "cell bigint, at bigint, c array<float>").toArrow().sort_by([("cell", "ascending"), ("at", "ascending")])
    return _matrix(found.column("c").combine_chunks()).astype(np.float32)


def nearest(vectors: DataFrame, is_query: Column, params: AnnParams = AnnParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, id_col, score``: for each row for which ``is_query`` holds, its nearest other rows by cosine.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, neither do null ids;
    vectors of different dimensions aren't neighbours. Ties go to the smaller id. With few rows all are searched;
    an empty table, or one without queries, gives no rows. Repeated rows of one id are rows of their own: each is
    asked, and the others are its neighbours. Other columns are not read, so their names don't matter.
    Up to ``most_lists`` times ``list_size`` vectors lists keep their length; beyond, they grow and are dealt to more tasks.
    """
    p = params
    spark = vectors.sparkSession
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), is_query.alias("q"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = materialise(rows.withColumn("node", F.xxhash64("v")), "vectors")
    # the smallest ids of each distinct vector, in two levels: a hot vector's rows meet in lists of bounded length only
    salted = rows.withColumn("_n", F.row_number().over(Window.partitionBy("node", "v", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id"))).where(F.col("_n") <= p.k + 1)
    # equal hashes of different vectors are told apart by the vectors themselves
    distinct = materialise(salted.groupBy("node", "v").agg(F.collect_list(F.array("id")).alias("ids")).select("node", "v", F.slice(F.array_sort(F.flatten("ids")), 1, p.k + 1).alias("ids")), "distinct")
    total = distinct.count()
    if not total:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    dims = {r["d"]: r["n"] for r in distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    main = max(dims, key=lambda d: (dims[d], d))
    lists = max(1, min(p.most_lists, dims[main] // p.list_size))
    most = max(1, min(max(p.sample, 8 * lists), p.sample_bytes // (8 * main)))
    sample = _matrix(distinct.where(F.size("v") == main).orderBy("node").select("v").limit(most).toArrow().column(0).combine_chunks())
    sample = unit(sample)
    parts = max(1, min(lists, len(sample) // 8))
    centroids = balanced_centroids(sample, parts)
    if parts < lists:
        centroids = finer_centroids(distinct.where(F.size("v") == main), centroids, lists, dims[main])
    lists = len(centroids)
    graph = CentroidGraph(centroids, p.degree)
    ratio = calibrated_ratio(sample, graph, p)
    shared = spark.sparkContext.broadcast((graph, ratio, main))

    def assign(query: bool, all_lists: bool = False):
        def run(batches):
            graph, ratio, main = shared.value
            for b in batches:
                size = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
                row, lst = np.flatnonzero(size != main), -size[size != main].astype(np.int64)
                step = graph.rows_at_once()
                for lo in range(0, b.num_rows, step):
                    at = lo + np.flatnonzero(size[lo : lo + step] == main)
                    if not len(at):
                        continue
                    x = unit(_matrix(b.column(1).take(pa.array(at))))
                    if all_lists:
                        r, c = np.nonzero(np.ones((len(at), len(graph.c)), bool))
                    elif query:
                        dist = graph.search(x, ratio, 2)
                        r, c = np.nonzero(dist <= dist.min(axis=1, keepdims=True) * ratio + 1e-12)
                    else:
                        r, c = lists_of(graph.search(x, 1.0, p.replicas), p.closure, p.replicas)
                    row, lst = np.r_[row, at[r]], np.r_[lst, c]
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(lst, pa.int64()), *[c.take(pick) for c in b.columns]], names=["list", *b.schema.names])

        return run

    postings = distinct.select("node", "v", "ids").mapInArrow(tidy(assign(False)), "list bigint, node bigint, v array<double>, ids array<bigint>")
    postings = materialise(postings, "postings")
    sizes = postings.groupBy("list").agg(F.count("*").alias("n"))
    asked = materialise(rows.where("q").select("node", "v").distinct(), "asked")

    def searched(asked: DataFrame, all_lists: bool) -> DataFrame:
        probes = materialise(asked.select("node", "v").mapInArrow(tidy(assign(True, all_lists)), "list bigint, node bigint, v array<double>"), "probes")
        # one row a list: at most ``most_lists``, and one for each rare dimension
        plan = sizes.join(probes.groupBy("list").agg(F.count("*").alias("m")), "list").select("list", F.ceil(F.col("n") / p.block).alias("blocks"), F.ceil(F.col("m") / p.block_queries).alias("parts"))
        own = postings.join(plan, "list").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), "blocks")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        ask = probes.join(plan, "list").withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), "parts")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        none = F.lit(None).cast("array<bigint>")
        both = own.select("list", "block", "part", F.lit(0).alias("kind"), "node", "v", "ids").union(ask.select("list", "block", "part", F.lit(1).alias("kind"), "node", "v", none.alias("ids")))

        def scan(batches):
            for t in key_groups(batches, 3):
                t = t.combine_chunks()
                kind = t.column("kind").to_numpy()
                n = int((kind == 0).sum())
                if n == 0 or n == len(kind):
                    continue
                x = _matrix(t.column("v").chunk(0).slice(0, n))
                ids = t.column("ids").slice(0, n).to_pylist()
                width = max(map(len, ids))
                table = np.full((n, width), np.iinfo(np.int64).max)
                for i, r in enumerate(ids):
                    table[i, : len(r)] = r
                norm = np.sqrt((x * x).sum(axis=1))
                want = p.k + 1
                for lo in range(n, len(kind), 512):
                    part = t.slice(lo, 512)
                    y = _matrix(part.column("v").chunk(0))
                    s = (y @ x.T) / (np.sqrt((y * y).sum(axis=1))[:, None] * norm[None, :])
                    top = min(want, n)
                    # a matrix product rounds by its shape, so scores are taken again row by row: one pair has one score
                    # in all lists. What may tie with the last place stays in, so that ids decide
                    edge = np.partition(s, n - top, axis=1)[:, n - top] - 1e-12
                    length = np.sqrt((y * y).sum(axis=1))
                    got_ids, got_s = [], []
                    for i in range(len(s)):
                        at = np.flatnonzero(s[i] >= edge[i])
                        cand = table[at].reshape(-1)
                        sc = np.repeat((x[at] * y[i]).sum(axis=1) / (length[i] * norm[at]), width)
                        real = cand != np.iinfo(np.int64).max
                        cand, sc = cand[real], sc[real]
                        order = np.lexsort((cand, -sc))[:want]
                        got_ids.append(cand[order])
                        got_s.append(sc[order])
                    yield pa.RecordBatch.from_arrays([part.column("node").chunk(0), part.column("v").chunk(0), pa.array(got_ids, pa.list_(pa.int64())), pa.array(got_s, pa.list_(pa.float64()))], names=["node", "v", "ids", "scores"])

        def merge(batches):
            for t in key_groups(batches, 1):
                by: dict[bytes, list] = {}
                v = t.column("v").combine_chunks()
                v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
                for i in range(t.num_rows):
                    by.setdefault(v[i].values.to_numpy(zero_copy_only=False).tobytes(), []).append(i)
                ids, scores = t.column("ids").to_pylist(), t.column("scores").to_pylist()
                for at in by.values():
                    # a replicated vector comes from several lists; its row counts once. Repeats within one list are rows of their own
                    best: dict[tuple[float, int], int] = {}
                    for i in at:
                        own: dict[tuple[float, int], int] = {}
                        for c, sc in zip(ids[i], scores[i], strict=True):
                            own[(-sc, c)] = own.get((-sc, c), 0) + 1
                        for key, n in own.items():
                            best[key] = max(best.get(key, 0), n)
                    flat = [key for key, n in sorted(best.items()) for _ in range(n)][: p.k + 1]
                    yield pa.RecordBatch.from_arrays([pa.array([t.column("node")[at[0]].as_py()]), v.slice(at[0], 1), pa.array([[c for _, c in flat]], pa.list_(pa.int64())), pa.array([[-s for s, _ in flat]], pa.list_(pa.float64()))], names=["node", "v", "ids", "scores"])

        keys = ["list", "block", "part"]
        hits = both.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(tidy(scan), "node bigint, v array<double>, ids array<bigint>, scores array<double>")
        return hits.repartition("node").sortWithinPartitions("node").mapInArrow(tidy(merge), "node bigint, v array<double>, ids array<bigint>, scores array<double>")

    found = materialise(searched(asked, False), "found")
    if lists > 1:
        # a query whose lists hold too few rows reads all lists
        few = asked.join(found.where(F.size("ids") > p.k).select("node", "v"), ["node", "v"], "left_anti")
        if not few.isEmpty():
            again = materialise(searched(few, True), "found")
            found = found.join(few, ["node", "v"], "left_anti").union(again)
    per_row = rows.where("q").select("id", "node", "v").join(found, ["node", "v"])
    # a row isn't its own neighbour: its first mention goes
    own = F.array_position("ids", F.col("id"))
    pairs = F.arrays_zip("ids", "scores")
    others = F.when(own == 0, pairs).otherwise(F.filter(pairs, lambda _, i: i != own - 1))
    out = per_row.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, p.k)).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.ids").alias(id_col), F.col("hit.scores").alias("score"))

