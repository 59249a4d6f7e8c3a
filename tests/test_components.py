"""Strong components: chains, long cycles, kinds; tree digests and settled tables."""

import hashlib
import os
import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F
from test_depth import strong_by_force

from lodestone import vocab
from lodestone.operators import enumerate as E
from lodestone.operators import graph as G
from lodestone.operators.settle import shared_folder


def groups(df):
    rows = df.collect()
    out = {}
    for r in rows:
        out.setdefault(r["component"], set()).add(r["node"])
    assert all(c == min(g) for c, g in out.items()) and len(rows) == sum(map(len, out.values()))
    return {frozenset(g) for g in out.values()}


def shapes(seed):
    """Chains that end, that return, that run into cycles, that meet; cycles with a way out; a random part."""
    r = random.Random(seed)
    e = [(f"a{k}", f"a{k + 1}") for k in range(9)] + [("a9", "a0")]  # a cycle
    e += [(f"b{k}", f"b{k + 1}") for k in range(6)] + [("b6", "a3")]  # into it
    e += [("h", f"c{k}") for k in (0, 3)] + [(f"c{k}", f"c{k + 1}") for k in range(6)] + [("c6", "h"), ("h", "i"), ("i", "h")]  # back to a hub, entered twice
    e += [("0x", "c4"), ("zz", "h"), ("d1", "c2"), ("d0", "d1"), ("h", "d1")]  # joined from outside, and from the hub
    e += [("h", "a5"), ("j", "j")]
    names = [f"v{k}" for k in range(12)]
    e += [(r.choice(names), r.choice(names)) for _ in range(18)] + [("v0", "h"), ("a1", "v1")]
    r.shuffle(e)
    return e


@pytest.mark.parametrize(("seed", "small"), [(1, 0), (2, 0), (3, 0), (4, 12)])
def test_chains_and_cycles(spark, seed, small):
    e = shapes(seed)
    got = groups(G.strong_components(spark.createDataFrame(e, "src string, dst string"), small=small))
    assert got == strong_by_force([p for p in e if p[0] != p[1]])


@pytest.mark.parametrize("turn", [False, True])
def test_a_long_cycle_takes_few_rounds(spark, turn, monkeypatch):
    n, tables = 3000, []
    df = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    # spokes with one way in or out, and a cycle beside it
    df = df.union(spark.range(n).select((F.col("id") + n).alias("src"), F.col("id").alias("dst"))) if turn else df
    df = df.union(spark.createDataFrame([(9000, 9001), (9001, 9000)], "src long, dst long"))
    plain = G.settle
    monkeypatch.setattr(G, "settle", lambda x: tables.append(1) or plain(x))
    got = G.strong_components(df, small=0).groupBy("component").agg(F.count("*").alias("n"), F.max("node").alias("m")).collect()
    assert sorted((r["component"], r["n"], r["m"]) for r in got) == [(0, n, n - 1), (9000, 2, 9001)]
    assert len(tables) < 60


def test_symmetric_kinds_have_no_direction(spark):
    e = [("a", "b", "calls"), ("b", "a", vocab.SYMMETRIC_KINDS[0]), ("c", "d", "calls"), ("d", "c", "depends-on"), ("e", "f", vocab.SYMMETRIC_KINDS[1]), ("f", "e", vocab.SYMMETRIC_KINDS[1])]
    df = spark.createDataFrame(e, "src string, dst string, kind string")
    for small in (0, 100):
        assert groups(G.strong_components(df, small=small)) == {frozenset("cd")}
    assert len(groups(G.strong_components(df.drop("kind"), small=100))) == 3


def test_loops_leave_no_tables_behind(spark):
    folder = urlparse(shared_folder(spark)).path + "/lodestone"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = G.strong_components(spark.createDataFrame(shapes(5), "src string, dst string"), small=0)
    assert out.count() and len(set(os.listdir(folder)) - before) == 1
    cliques = G.maximal_cliques(spark.createDataFrame(shapes(5), "src string, dst string"), 2)
    assert cliques.count()
    left = set(os.listdir(folder)) - before
    assert len(left) <= 8  # the two results, and the layers' degrees


def digest(files, d):
    h = hashlib.sha256()
    prefix = f"{d}/" if d else ""
    for p in sorted((p for p in files if p.startswith(prefix)), key=lambda p: p[len(prefix) :].split("/")):
        rel = p[len(prefix) :].encode()
        h.update(len(rel).to_bytes(8, "little") + rel + hashlib.sha256(files[p]).digest())
    return h.hexdigest()


def test_tree_digests_of_many_files(spark):
    n = 30_000
    files = {f"r/{k % 50}/s{k % 3}/f{k}.é": str(k % 7).encode() for k in range(n)} | {"r-x/a": b"", "r/a.b": b"1", "r/a/b": b"2", "top": b"t"}
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary").repartition(7)
    dirs = ["", "r", "r/7", "r/49/s1", "r-x", "r/a"]
    # directories come once or repeated; one without files has no digest
    asked = spark.createDataFrame([(d,) for d in [*dirs, "r", "none"]], "dir string")
    assert {r["dir"]: r["content_sha"] for r in E.tree_sha(df, asked).collect()} == {d: digest(files, d) for d in dirs}
    whole = {r["dir"]: r["content_sha"] for r in E.tree_sha(df, asked, relative=False).collect()}
    assert whole[""] == digest(files, "") and whole["r"] != digest(files, "r")
