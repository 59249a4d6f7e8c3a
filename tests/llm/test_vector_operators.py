"""Operators on vectors: edge cases, brute force, recall."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann, embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, score double"
NAN, INF = float("nan"), float("inf")


def rows(n=300, dim=64, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    for k in range(60, 100):  # near copies of a few vectors
        x[k] = x[k % 4] + r.normal(size=dim) * 0.08
    x[100:105] = x[7]
    out = [(k, [float(np.float32(v)) for v in x[k]], int(k % 2 if k < 60 or k >= 105 else (k % 4) % 2 if k < 100 else 1)) for k in range(n)]
    out += [(1000, None, 0), (1001, [], 0), (1002, [0.0] * dim, 0), (1003, [NAN] + [1.0] * (dim - 1), 0), (1004, [INF] + [1.0] * (dim - 1), 0), (1005, [None] + [1.0] * (dim - 1), 0), (1006, out[0][1], None), (1050, [1.0, 2.0], 0), (1051, [1.0, 2.001], 0), (1052, [2.0, 4.0], 1), out[7], (None, out[9][1], 1), (1100, [1e-30] * dim, 0)]
    return [(*row, 0.5) for row in out]


def unit(v):
    if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
        return None
    x = np.array(v, np.float32).astype(float)
    return x / np.sqrt((x * x).sum())


def links_by_force(data):
    u = [unit(r[1]) for r in data]
    near = np.zeros((len(data), len(data)), bool)
    for a in range(len(data)):
        for b in range(len(data)):
            near[a, b] = a != b and u[a] is not None and u[b] is not None and len(u[a]) == len(u[b]) and data[a][2] is not None and data[a][2] == data[b][2] and u[a] @ u[b] >= 0.98
    label = np.arange(len(data))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(data))])
        if (new == label).all():
            break
        label = new
    out = Counter()
    for i in range(len(data)):
        ids = [data[j][0] for j in range(len(data)) if label[j] == label[i] and data[j][0] is not None]
        out[data[i][0], int(near[i].sum()), min(ids) if ids else None] += 1
    return out


@pytest.mark.parametrize(("block", "shape"), [(512, None), (3, None), (512, (12, 12)), (512, (16, 16))])
def test_embedding_dedup(spark, block, shape, monkeypatch):
    from lodestone.llm import collide

    monkeypatch.setattr(collide, "BLOCK", block)
    monkeypatch.setattr(collide, "FLAG_MOST", block)
    data = rows()
    # columns of the names that the result has, and inner names, don't disturb
    table = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit(7) for c in ("n_links", "kept", "node", "key", "_n")})
    got = embedding_dedup.near_duplicates(table, embedding_dedup.ItqParams(shape=shape)).collect()
    want = links_by_force(data)
    have = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got)
    assert sum((have & want).values()) >= 0.99 * len(data)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    total = lambda c: sum(n * k for (_, n, _), k in c.items())
    assert total(want) * 0.97 <= total(have) <= total(want)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_codes_are_balanced():
    x = np.random.default_rng(1).normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = embedding_dedup.learn_rotation(x, 20)
    assert np.allclose(r.T @ r, np.eye(64), atol=1e-8)
    assert np.abs((x @ r >= 0).mean(axis=0) - 0.5).max() < 0.1
    chunks = embedding_dedup.codes(x, r, (8, 8))
    assert chunks.shape == (2000, 8) and chunks.max() < 256
    for d in (3, 40, 100):
        assert embedding_dedup.learn_rotation(np.eye(d), 0).shape == (d, 64)
        assert embedding_dedup.learn_rotation(np.eye(d), 0, 144).shape == (d, 144)


@pytest.mark.parametrize("shape", [(8, 8), (12, 12), (16, 16)])
def test_tables_meet_at_the_threshold(shape):
    """Vectors at cosine 0.98 meet in some table, nearly always, whatever the shape; each pair has one first table."""
    r = np.random.default_rng(2)
    x = r.normal(size=(1500, 64))
    y = r.normal(size=x.shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    z = 0.98 * x + np.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    turn = embedding_dedup.learn_rotation(x, 10, shape[0] * shape[1])
    a, b = (np.ascontiguousarray(embedding_dedup.codes(v, turn, shape)) for v in (x, z))
    tables = embedding_dedup.tables_of(shape[0])
    hits = sum(np.diag(embedding_dedup.first_table(a, b, t, tables)).astype(int) for t in range(len(tables)))
    assert hits.max() == 1 and hits.mean() > 0.975


def test_links_on_the_edge_do_not_depend_on_the_block():
    x = np.random.default_rng(3).normal(size=(40, 64))
    payloads = [v.tobytes() for v in x]
    i, j = 3, 17
    edge = float((x[i] * x[j]).sum() / (np.sqrt((x[i] * x[i]).sum()) * np.sqrt((x[j] * x[j]).sum())))
    for at in ([i, j], list(range(40)), [0, i, 5, j, 9]):
        near = embedding_dedup.near_vectors([payloads[k] for k in at], edge)
        assert near[at.index(i), at.index(j)] and near[at.index(j), at.index(i)]


def nearest_by_force(data, query, k=5):
    u = [unit(r[1]) for r in data]
    out = {}
    for i, r in enumerate(data):
        if r[0] is not None and query(r[0]) and u[i] is not None:
            found = sorted((-float(u[i] @ u[j]), data[j][0]) for j in range(len(data)) if j != i and data[j][0] is not None and u[j] is not None and len(u[j]) == len(u[i]))
            out.setdefault(r[0], []).append([(c, -s) for s, c in found[:k]])
    return out


def test_small_tables_are_exact(spark):
    data = rows()
    got = ann.nearest(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    want = nearest_by_force(data, lambda i: i % 50 == 0)
    have = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        have.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert {q: [c for c, _ in v] for q, v in have.items()} == {q: [c for c, _ in v[0]] for q, v in want.items() if v[0]}
    for q, v in have.items():
        assert np.allclose([s for _, s in v], [s for _, s in want[q][0]], atol=1e-12)
    assert ann.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_repeated_rows_and_clashing_names(spark):
    """Each row of a repeated id is asked, and the other rows of that id are its neighbours."""
    data = [(50, [1.0, 0.0], 0, 0.5), (50, [1.0, 0.0], 0, 0.5), (50, [0.0, 1.0], 0, 0.5), (1, [1.0, 0.1], 0, 0.5)]
    table = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit(1) for c in ("query_id", "rank", "node", "list", "ids")})
    got = ann.nearest(table, F.col("vec_id") % 50 == 0).collect()
    assert Counter((r["query_id"], r["rank"], r["vec_id"]) for r in got) == Counter({(50, 1, 50): 2, (50, 2, 1): 2, (50, 3, 50): 3, (50, 1, 1): 1, (50, 2, 50): 1})


def test_recall_over_lists(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 32)).astype(np.float32)
    df = spark.createDataFrame([(k, [float(v) for v in x[k]], 0, 0.0) for k in range(len(x))], SCHEMA)
    p = ann.AnnParams(list_size=100, block=200, block_queries=7)
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, p).collect()
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -2
        hit += len(set(np.argsort(-s)[:5].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hit / 300 >= 0.9
    assert all(n == 5 for n in Counter(r["query_id"] for r in got).values())


def test_hot_vector(spark):
    """A third of all rows are one vector; its queries get the smallest other ids."""
    data = rows(200)
    data += [(k, data[0][1], 0, 0.0) for k in range(2000, 2200)]
    got = ann.nearest(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    top = lambda q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert top(2000) == [0, 1006, 2001, 2002, 2003] and top(2050) == [0, 1006, 2000, 2001, 2002]


def test_graph_finds_the_nearest_centroids():
    r = np.random.default_rng(8)
    x = r.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = ann.balanced_centroids(x, 64)
    g = ann.CentroidGraph(c, 12)
    sizes = np.bincount((x @ c.T).argmax(axis=1), minlength=64)
    assert len(c) == 64 and sizes.max() < 6 * sizes.mean()
    d = g.search(x[:300], 1.0, 4)
    assert (d.argmin(axis=1) == (x[:300] @ c.T).argmax(axis=1)).mean() > 0.95


def test_more_lists_than_the_sample_holds(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(60, 24))[r.integers(0, 60, 4000)] + r.normal(size=(4000, 24)) * 0.5
    x[:1300] = x[5] + r.normal(size=(1300, 24)) * 0.01  # a hot part
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    # the driver's fit holds 320 vectors, so 40 lists; 200 are wanted
    p = ann.AnnParams(list_size=20, sample=320, sample_bytes=320 * 8 * 24)
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, p).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4000, 50):
        s = u @ u[q]
        s[q] = -np.inf
        mine = sorted((g["rank"], g["vec_id"], g["score"]) for g in got if g["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(s[v] - sc) < 1e-9 for _, v, sc in mine)
        hits += len({v for _, v, _ in mine} & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 5 * 80
    nodes = df.select(F.xxhash64("embedding").alias("node"), F.col("embedding").alias("v"))
    coarse = ann.balanced_centroids(u[:320], 40)
    finer = ann.finer_centroids(nodes, coarse, 200, 4000)
    assert 160 <= len(finer) <= 240 and np.allclose(np.linalg.norm(finer, axis=1), 1, atol=1e-5)
    assert (finer == ann.finer_centroids(nodes.repartition(7), coarse, 200, 4000)).all()
    # lists are no longer than a few times the wanted length
    own = np.bincount((u @ finer.T).argmax(axis=1), minlength=len(finer))
    assert np.sort(own)[-5:].max() <= 20 * 12
