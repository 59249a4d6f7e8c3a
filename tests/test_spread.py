"""Work that was one task's: listing trees, ids of many children, many patterns, long sessions."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_depth import ids_by_force
from test_respond import tree as write

from lodestone.functions import paths as P
from lodestone.operators import project as J
from lodestone.operators import tree as T
from lodestone.respond import charges as G
from lodestone.respond.core import Budget, BudgetExceeded
from lodestone.sources import files as FS


@pytest.mark.parametrize("share", [1, 5, 4096])
def test_executors_list_what_the_walk_lists(spark, tmp_path, share):
    root = str(tmp_path / "r")
    r = random.Random(2)
    names = ["a", "b", "build", "keep", "x.log", "y.txt", ".hidden"]
    files = {"/".join(r.choice(names[:4]) for _ in range(r.randrange(6))) + f"/{r.choice(names[4:])}": "x" for _ in range(60)}
    files = {p.lstrip("/"): c for p, c in files.items()} | {".gitignore": "*.log\n/build/\n", "a/.gitignore": "!x.log\nkeep/\n", "a/b/.gitignore": "y.txt\n!keep/\n", "repo/.git/info/exclude": "secret\n", "repo/secret": "s", "repo/open": "o", "sub/.git": "gitdir: x", "out/z": "1"}
    write(root, files)
    os.symlink(root + "/a", root + "/linked")
    out = os.path.join(root, "out")
    for respect in (True, False):
        want = list(FS.walk(root, respect, out))
        got = [x["path"] for x in FS.listing(spark, root, respect, out, share).collect()]
        assert sorted(got) == sorted(want) and len(got) == len(set(got))
    assert FS.listing(spark, str(tmp_path / "r" / "out")).collect() == [("z",)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ids_of_clashing_families(spark, seed):
    r = random.Random(seed)
    slugs = ["x", "x-2", "x-2-2", "x-3", "y", "y-0000000a", "z-12345", "w"]
    nodes = [("top", None, 1, "top")] + [(f"top/{k:02d}{r.choice('aB')}", "top", 2, r.choice(slugs)) for k in range(30)]
    nodes += [(f"{nodes[5][0]}/{k}", nodes[5][0], 3, "x") for k in range(3)]
    taken = r.choice([[], ["top/x", "top/x-2-3", "top/w-2"], ["top", "top-2/y", "top-2/y-0000000a"]])
    df = spark.createDataFrame(nodes, "dir string, parent_dir string, depth int, slug string")
    got = {x["dir"]: x["id"] for x in T.allocate_ids(df, spark.createDataFrame([(t,) for t in taken], "id string") if taken else None).collect()}
    assert got == ids_by_force(nodes, taken)


def test_ids_beyond_a_thousand(spark):
    dirs = [f"p/{k:05d}" for k in range(1010)]
    nodes = [("p", None, 1, "p")] + [(d, "p", 2, "s") for d in dirs]
    df = spark.createDataFrame(nodes, "dir string, parent_dir string, depth int, slug string")
    got = {x["dir"]: x["id"] for x in T.allocate_ids(df).collect()}
    want = dict(zip(dirs, T.allocate_in_group("p", dirs, ["s"] * len(dirs), set()), strict=True)) | {"p": "p"}
    assert got == want and sum("-" in i and len(i) > 9 for i in got.values()) == 10


def test_many_patterns(spark):
    r = random.Random(8)
    paths = sorted({"/".join(r.choice("abcd") for _ in range(r.randrange(1, 5))) for _ in range(80)})
    comps = spark.createDataFrame([(f"c{k}", k % 9 == 0, [p] + ([paths[k - 1]] if k % 7 == 0 and k else [])) for k, p in enumerate(paths)], "id string, deleted boolean, paths array<string>")
    globs = ["a/*", "*/b", "a/**/c", "**", "b/?", "c/[ab]", "d/{a,b}/*", "a/b", "zz/*", "bad/[x", "x{", "*", "c0", "c1", "none"] + [f"{x}/{y}*" for x in "abcd" for y in "abcd"]
    members = [(f"s{k % 3}", k, g) for k, g in enumerate(globs)]
    got = {tuple(x) for x in J.subsystem_evidence(spark.createDataFrame(members, "subsystem string, ord int, member string"), comps).collect()}
    import re

    live = {x["id"]: x["paths"] for x in comps.where("not deleted").collect()}
    want, first = set(), {}
    for s, o, g in members:
        if "/" not in g and "*" not in g:
            hit = [g] if g in live else []
            via = "id"
            if not hit:
                want.add((s, o, g, "id (no such component)", False))
        else:
            via = g
            try:
                rx = re.compile(P.glob_regex(g))
            except ValueError:
                want.add((s, o, "", f"{g} (invalid glob)", False))
                continue
            hit = [i for i, ps in live.items() if any(rx.match(p) for p in ps)]
            if not hit:
                want.add((s, o, "", f"{g} (no matches)", False))
        for i in hit:
            first.setdefault((s, i), (s, o, i, via, True))
    assert got == want | set(first.values())


def test_long_sessions(spark):
    r = random.Random(6)
    rows = [(s, k, r.randrange(60) if k % 50 else None) for s in ("a", "b", None) for k in range(12_000 if s == "a" else 40)]
    df = spark.createDataFrame(rows, "session string, seq int, cost int").repartition(5)
    got = {(x["session"], x["seq"]): (x["accepted"], x["used"]) for x in G.greedy_charges(df, 1000).collect()}
    for s in ("a", "b", None):
        b = Budget(1000)
        for _, k, c in (x for x in rows if x[0] == s):
            try:
                b.charge(c or 0)
                ok = True
            except BudgetExceeded:
                ok = False
            assert got[s, k] == (ok, b.used)
    assert len(got) == len(rows) and df.where(F.col("session").isNull()).count() == 40


def by_force(costs, limit, used=0):
    b, out = Budget(limit, used), []
    for c in costs:
        try:
            b.charge(c)
            out.append((True, b.used))
        except BudgetExceeded:
            out.append((False, b.used))
    return out


def test_pieces_are_passed_over_as_they_would_be_charged():
    r = random.Random(8)
    seen = {True: 0, False: 0}
    for _ in range(3000):
        limit = r.choice([0, 1, 2, 7, 8, 100, 1 << 20, 1 << 61])
        costs = [min(r.choice([0, 1, r.randrange(limit + 2), r.randrange(limit // 50 + 2), 1 << 62]), 1 << 62) for _ in range(r.randrange(1, 12))]
        used = r.choice([0, limit, r.randrange(limit + 1)])
        levels, cut = G.Levels(limit), r.randrange(len(costs))
        for part in (costs[:cut], costs[cut:]):
            if part:
                levels.add(np.array(part))
        got, want = G.passed(used, limit, levels.sums, levels.least), by_force(costs, limit, used)
        seen[got is None] += 1
        if got is not None:
            assert got == want[-1][1]
        assert [*zip(*G.charge(costs, limit, used), strict=True)] == want
    assert min(seen.values()) > 300


def test_a_session_in_many_tasks(spark):
    r = random.Random(9)
    rows = [(s, k, c) for s, n in (("a", 9000), ("b", 3), (None, 4000), ("c", 6000)) for k in range(n) for c in [r.choice([None, -4, 0, 1, r.randrange(1000), r.randrange(200_000)])]]
    rows += [("c", 7, 900), ("c", 7, 30), ("c", 7, 30)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "session string, seq int, cost int").repartition(3)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for limit in (-1, 1000, 700_000):
            dealt = G.dealt(df, limit)
            assert dealt.where("place is not null").groupBy("session").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 3
            got = [tuple(x) for x in G.greedy_charges(df, limit).collect()]
            want = []
            for s in ("a", "b", "c", None):
                mine = sorted((k, max(c or 0, 0)) for t, k, c in rows if t == s)
                want += [(s, k, c, *x) for (k, c), x in zip(mine, by_force([c for _, c in mine], limit), strict=True)]
            assert sorted(got, key=repr) == sorted(want, key=repr)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_charges_of_nothing(spark):
    df = spark.createDataFrame([], "session bigint, seq int, cost int, accepted string, part int")
    out = G.greedy_charges(df, 5)
    assert out.count() == 0 and out.columns == ["session", "seq", "cost", "accepted", "used"]
