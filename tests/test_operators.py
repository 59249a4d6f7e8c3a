"""Operators on hand-made cases."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from lodestone.operators import classify as K
from lodestone.operators import edges as D
from lodestone.operators import enumerate as E
from lodestone.operators import evaluate as V
from lodestone.operators import graph as G
from lodestone.operators import project as J
from lodestone.operators import recurse as R
from lodestone.operators import tree as T


def edges(spark, pairs):
    return spark.createDataFrame(pairs or [("x", "x")], "src string, dst string").where("src <> dst")


def groups(df, by, of):
    return sorted(sorted(r["g"]) for r in df.groupBy(by).agg(F.collect_list(of).alias("g")).collect())


@pytest.mark.parametrize(("pairs", "expected"), [(["AB", "BC", "CA"], [["A", "B", "C"]]), (["AB", "BC"], []), ([], []), (["AB", "BA", "CD", "DC"], [["A", "B"], ["C", "D"]]), (["AB", "BA", "BC", "CD", "DC", "AD"], [["A", "B"], ["C", "D"]])])
def test_strong_components(spark, pairs, expected):
    assert groups(G.strong_components(edges(spark, [tuple(p) for p in pairs])), "component", "node") == expected


@pytest.mark.parametrize(("pairs", "least", "expected"), [(["AB", "AC", "AD", "BC", "BD", "CD"], 3, ["ABCD"]), (["AB", "BC", "AC"], 3, ["ABC"]), ([], 2, []), (["AB", "BC", "AC", "CD"], 2, ["ABC", "CD"])])
def test_cliques(spark, pairs, least, expected):
    got = G.maximal_cliques(edges(spark, [tuple(p) for p in pairs]), least)
    assert sorted("".join(r["members"]) for r in got.collect()) == expected


@pytest.mark.parametrize(("inside", "pairs", "density"), [("A", ["AX"], 0.0), ("AB", ["AB"], float("inf")), ("AB", ["AB", "AX", "BY"], 0.5)])
def test_seam_density(spark, inside, pairs, density):
    tree = spark.createDataFrame([("root", None), *[(c, "root") for c in inside], ("X", None), ("Y", None)], "id string, parent string")
    got = {r["id"]: r["density"] for r in G.seam_density(tree, T.closure(tree), edges(spark, [tuple(p) for p in pairs])).collect()}
    assert got["root"] == density


def test_bisection(spark):
    def best(names, pairs):
        m = spark.createDataFrame([("g", n) for n in names], "grp string, node string")
        return [(r["cross_edges"], r["total_edges"], "".join(r["side_a"]), "".join(r["side_b"])) for r in G.best_bisection(m, edges(spark, [tuple(p) for p in pairs])).collect()]

    k3 = ["AB", "BC", "AC", "DE", "EF", "DF", "BD"]
    assert best("ABCDEF", k3) == [(1, 7, "ABC", "DEF")]
    assert best("ABCD", ["AB", "AC", "AD", "BC", "BD", "CD"]) == []
    assert best("ABC", ["AB"]) == [] and best("ABCDEFGHIJKLM", ["AB"]) == []


def test_tree(spark):
    t = spark.createDataFrame([("root", None), ("a", "root"), ("b", "a"), ("o", None)], "id string, parent string")
    assert {r["id"]: r["depth"] for r in T.depths(t).collect()} == {"root": 0, "a": 1, "b": 2, "o": 0}
    assert sorted(r["id"] for r in T.closure(t).where("ancestor = 'root'").collect()) == ["a", "b"]
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", None)], "id string, parent string")
    assert sorted(r["id"] for r in T.on_cycles(loop).collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="cycle"):
        T.closure(loop)


def test_allocation(spark):
    assert T.allocate_in_group(None, ["x/foo"], ["foo"], {"foo", "foo-2", "foo-3"}) == ["foo-4"]
    full = {"foo", *(f"foo-{k}" for k in range(2, 1001))}
    assert T.allocate_in_group(None, ["x/foo"], ["foo"], full) == ["foo-" + hashlib.sha256(b"x/foo").hexdigest()[:8]]
    nodes = spark.createDataFrame([("a", None, 1, "a"), ("a/x y", "a", 2, "x-y"), ("a/x-y", "a", 2, "x-y"), ("b", None, 1, "b")], "dir string, parent_dir string, depth int, slug string")
    taken = spark.createDataFrame([("a/x-y",)], "id string")
    got = {r["dir"]: r["id"] for r in T.allocate_ids(nodes, taken).collect()}
    assert got == {"a": "a", "b": "b", "a/x y": "a/x-y-2", "a/x-y": "a/x-y-3"}


def test_renames_and_tombstones(spark):
    prior = spark.createDataFrame([("my-original-id", "s1"), ("gone", "ff")], "id string, content_sha string")
    live = spark.createDataFrame([("new/dir", "s1"), ("fresh", "s3")], "key string, content_sha string")
    got = {(r["live_key"], r["prior_id"], r["state"]) for r in T.match_renames(prior, live).collect()}
    assert got == {("new/dir", "my-original-id", "matched"), ("fresh", None, "fresh"), (None, "gone", "orphan")}
    p = spark.createDataFrame([("gone", False), ("old", True), ("kept", False)], "id string, deleted boolean")
    assert [r["id"] for r in T.tombstones(p, spark.createDataFrame([("kept",)], "id string")).collect()] == ["gone"]


def test_tree_sha_frames_lengths(spark):
    files = spark.createDataFrame([("d/b", "2"), ("d/a", "1"), ("e/x", "3")], "path string, content string")
    dirs = spark.createDataFrame([("d",), ("",)], "dir string")
    got = {r["dir"]: r["content_sha"] for r in E.tree_sha(files, dirs).collect()}
    want = lambda xs: hashlib.sha256(b"".join(struct.pack("<Q", len(p)) + p.encode() + hashlib.sha256(c.encode()).digest() for p, c in xs)).hexdigest()
    assert got == {"d": want([("a", "1"), ("b", "2")]), "": want([("d/a", "1"), ("d/b", "2"), ("e/x", "3")])}


def test_headings_outside_fences(spark):
    text = "# One\r\n```\n# no\n```\n~~~\n# no\n~~~\n## Two ##\n#x\n"
    files = spark.createDataFrame([("a/README.md", text), ("a/other.md", "# no")], "path string, content string")
    assert [(r["line_no"], r["level"], r["text"]) for r in E.doc_headings(files).orderBy("line_no").collect()] == [(1, 1, "One"), (8, 2, "Two")]


def test_edge_answers(spark):
    one = '{"kind":"calls","lifecycle":"runtime","participants":["a","b"]}'
    rows = [(0, f"[{one}]"), (1, f'{{"edges":[{one}]}}'), (2, f'[{one},{{"kind":"calls"}}]'), (3, "x")]
    df = spark.createDataFrame(rows, "k int, t string").select("k", D.parse_edges(F.col("t")).alias("e")).orderBy("k")
    got = [r["e"] for r in df.collect()]
    assert [len(g) if g is not None else None for g in got] == [1, 1, 1, None]
    assert got[0][0]["evidence_grade"] == "medium"


def test_edge_dedup(spark):
    e = spark.createDataFrame([(2, "co-implements", "build", ["b", "a"], "later"), (1, "co-implements", "build", ["a", "b"], "first"), (3, "calls", "build", ["b", "a"], "x")], "ord int, kind string, lifecycle string, participants array<string>, rationale string")
    got = sorted((r["kind"], tuple(r["participants"]), r["rationale"]) for r in D.dedup(D.canonical(e)).collect())
    assert got == [("calls", ("b", "a"), "x"), ("co-implements", ("a", "b"), "first")]


@pytest.mark.parametrize(("kind", "depth", "most", "hint", "verdict"), [("rust-library", 2, 8, False, "ask"), ("rust-library", 3, 8, False, "stop"), ("rust-library", 5, 8, True, "recurse"), ("workspace", 0, 0, True, "stop"), ("workspace", 1, 8, False, "recurse"), ("website", 0, 8, True, "stop")])
def test_policy(spark, kind, depth, most, hint, verdict):
    df = spark.createDataFrame([(kind, depth, most, hint)], "k string, d int, m int, h boolean")
    assert df.select(R.policy(F.col("k"), F.col("d"), F.col("m"), F.col("h")).alias("v")).first()["v"] == verdict


def test_fixedpoint_stops_and_fails(spark):
    start = spark.createDataFrame([], "id string, sub_dir string")
    step = lambda n: lambda known: spark.createDataFrame([("a", str(min(n, known.count())))], "id string, sub_dir string")
    got, rounds = R.fixedpoint(step(2), start)
    assert (got.count(), rounds) == (3, 3)
    with pytest.raises(RuntimeError):
        R.fixedpoint(step(99), start, max_rounds=3)


def test_pins_win_over_rules(spark):
    dirs = spark.createDataFrame([("x/My Lib",), ("y",)], "dir string")
    pins = spark.createDataFrame([("my-lib", "kind", "value", "service"), ("y", "suppress", "suppress", None)], "key string, field string, variant string, value string")
    got = {r["dir"]: (r["pin"]["kind"], r["pin"]["is_boundary"], r["pin"]["evidence_fields"]) for r in K.by_pins(dirs, pins).collect()}
    assert got == {"x/My Lib": ("service", True, ["pin:kind"]), "y": ("non-component", False, ["pin:suppress"])}


def test_subsystems(spark):
    comps = spark.createDataFrame([("auth", ["services/auth/api"], False), ("id-core", ["libs/id"], False), ("old", ["services/auth/old"], True)], "id string, paths array<string>, deleted boolean")
    members = spark.createDataFrame([("s", 0, "services/auth/*"), ("s", 1, "id-core"), ("s", 2, "auth"), ("t", 0, "none/*"), ("t", 1, "ghost"), ("t", 2, "*{")], "subsystem string, ord int, member string")
    ev = J.subsystem_evidence(members, comps)
    assert {(r["subsystem"], r["id"], r["matched_via"]) for r in ev.collect()} == {("s", "auth", "services/auth/*"), ("s", "id-core", "id"), ("t", "", "none/* (no matches)"), ("t", "ghost", "id (no such component)"), ("t", "", "*{ (invalid glob)")}
    assert {r["subsystem"]: (r["members"], r["notes"]) for r in J.subsystems(ev).collect()} == {"s": (["auth", "id-core"], []), "t": ([], ["all members unresolved"])}


def test_metrics_on_empty_and_equal_sides(spark):
    kind = "id string, paths array<string>, kind string, ord int"
    a = spark.createDataFrame([("a", ["p"], "x", 0), ("b", ["q", "r"], "y", 1)], kind)
    none = spark.createDataFrame([], kind)
    first = lambda df: df.first()[0]
    assert first(V.coverage(a, a)) == 1 and first(V.coverage(a, none)) == 0 and first(V.coverage(none, a)) == 1
    assert first(V.spurious_rate(a, none)) == 0 and first(V.kind_accuracy(a, a)) == 1 and first(V.kind_accuracy(none, a)) == 1
    assert V.diff(a, a, ("kind",)).count() == 0


def test_invariants(spark):
    seg = spark.createDataFrame([("p", "a"), ("c", "a/b"), ("q", "a/b/c")], "id string, path string")
    above = spark.createDataFrame([("c", "p")], "id string, ancestor string")
    assert {(r["a"], r["b"]) for r in V.path_overlaps(seg, above).collect()} == {("q", "p"), ("q", "c")}
    e = spark.createDataFrame([("k", ["a", "ghost"])], "key string, participants array<string>")
    assert [r["id"] for r in V.unknown_participants(e, spark.createDataFrame([("a",)], "id string")).collect()] == ["ghost"]
