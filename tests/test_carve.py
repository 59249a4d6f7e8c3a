"""The carve loop with hints, round by round; surfaces with pins and failures; edges proposed by blocks."""

import itertools
import json
import os
import random
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestone.operators import edges as D
from lodestone.operators import propose as Q
from lodestone.plans.index import Options, index
from lodestone.respond.core import Fingerprint

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module

LIB = "[package]\nname = \"x\"\n[lib]\n"


def write(root, files):
    for p, body in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, p)), exist_ok=True)
        with open(os.path.join(root, p), "w") as f:
            f.write(body)


def responder(log, classify=None, edges=lambda ids: [], surface=lambda i: {"purpose": f"about {i}"}):
    """Answers by prompt and notes what it was asked."""

    class Scripted:
        def call(self, prompt, inputs):
            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                json.dump([prompt, inputs], f)
            if prompt == "classify":
                if classify is None:
                    raise LookupError("nothing to say")
                return classify(inputs["DIR_RELATIVE"])
            if prompt == "surface":
                return surface(inputs["COMPONENT_ID"])
            return edges([r["id"] for r in inputs["SURFACE_RECORDS"]])

        def fingerprint(self):
            return Fingerprint("t", "o", "scripted", "1")

    os.makedirs(log, exist_ok=True)
    return Scripted()


def asked(log, prompt):
    return [i for p, i in (json.load(open(f"{log}/{x}")) for x in os.listdir(log)) if p == prompt]


def edge(a, b, kind="calls"):
    return {"kind": kind, "lifecycle": "runtime", "participants": [a, b], "evidence_grade": "strong", "evidence_fields": ["f"], "rationale": "r"}


def dirs_of(r):
    return {s["path"]: x["id"] for x in r.components.where("not deleted").collect() for s in x["path_segments"]}


DEEP = "a/b/c/d"  # a library three levels below the root library


@pytest.fixture
def deep(tmp_path):
    root = str(tmp_path / "r")
    write(root, {f"{d}/Cargo.toml": LIB for d in ("a", "a/b", "a/b/c", DEEP, *(f"{DEEP}/{x}" for x in "pqrs"))} | {f"{DEEP}/extra/notes.txt": "n", f"{DEEP}/extra/more/deep.txt": "n", "z/Cargo.toml": "[package]\n[[bin]]\nname='z'\n"})
    return root


def split(ids):
    """Two pairs without an edge between them, where the request is about them alone; all in one otherwise."""
    leaf = sorted(i for i in ids if i.rpartition("/")[2] in "pqrs" and "/" in i)
    return [edge(leaf[0], leaf[1]), edge(leaf[2], leaf[3])] if len(leaf) == 4 else []


def only_extra(d):
    return {"kind": "service" if d.endswith("/extra") else "non-component", "is_boundary": d.endswith("/extra")}


def test_a_hint_carries_a_library_beyond_the_cap(spark, deep, tmp_path):
    log = str(tmp_path / "log")
    r = index(spark, deep, str(tmp_path / "o"), responder(log, only_extra, split))
    assert f"{DEEP}/extra" in dirs_of(r)
    rows = r.summary["rounds"]
    assert r.summary["iterations"] == 1 and len(rows) == 2
    # the second round judges, digests and places what the first one added, and nothing else
    assert rows[0]["hinted"] == 1 and rows[0]["digested"] == 9 and rows[1]["digested"] == rows[1]["placed"] == 1
    assert rows[1]["classified"] < rows[0]["classified"] and rows[1]["classified"] <= 1
    # the hint was asked for among the library's descendants alone
    sizes = sorted(len(i["SURFACE_RECORDS"]) for i in asked(log, "edges"))
    assert sizes == [4, 5, 10]


def test_edges_across_give_no_hint(spark, deep, tmp_path):
    def across(ids):
        leaf = sorted(i for i in ids if i.rpartition("/")[2] in "pqrs" and "/" in i)
        return [edge(a, b) for a, b in itertools.combinations(leaf, 2)]

    r = index(spark, deep, str(tmp_path / "o"), responder(str(tmp_path / "log"), only_extra, across))
    assert f"{DEEP}/extra" not in dirs_of(r)


def test_directories_are_placed_anew_when_one_comes_between(spark, tmp_path):
    root = str(tmp_path / "r")
    write(root, {"lib/Cargo.toml": LIB, "lib/src/x/y/Cargo.toml": LIB, "lib/src/lib.rs": "", "lib/src/x/z.rs": "", "lib/doc/a.md": "x"})
    r = index(spark, root, str(tmp_path / "o"), responder(str(tmp_path / "log"), lambda d: {"kind": "rust-library", "is_boundary": d in ("lib/src", "lib/src/x")}))
    got = {x["path_segments"][0]["path"]: x["parent"] for x in r.components.collect()}
    ids = dirs_of(r)
    assert got == {"lib": None, "lib/src": ids["lib"], "lib/src/x": ids["lib/src"], "lib/src/x/y": ids["lib/src/x"]}
    rows = r.summary["rounds"]
    assert [(x["digested"], x["placed"]) for x in rows] == [(2, 2), (1, 2), (1, 2), (0, 0)] and r.summary["iterations"] == 3
    judged = sorted(i["DIR_RELATIVE"] for i in asked(str(tmp_path / "log"), "classify"))
    assert judged == sorted(set(judged)) and set(judged) >= {"lib/src", "lib/doc", "lib/src/x"}


def test_no_depth_no_carving(spark, tmp_path):
    root, log = str(tmp_path / "r"), str(tmp_path / "log")
    write(root, {"lib/Cargo.toml": LIB, "lib/src/lib.rs": ""})
    r = index(spark, root, str(tmp_path / "o"), responder(log, lambda d: {"kind": "rust-library", "is_boundary": True}), Options(max_depth=0))
    assert r.summary["iterations"] == 0 and set(dirs_of(r)) == {"lib"} and not asked(log, "classify")


def test_surfaces_by_pin_answer_and_failure(spark, tmp_path):
    root, out, log = str(tmp_path / "r"), str(tmp_path / "o"), str(tmp_path / "log")
    write(root, {f"{d}/Cargo.toml": LIB for d in ("one", "two", "three", "four")})
    write(out, {"components.overrides.yaml": "schema_version: 1\npins:\n  one: {surface: {value: \"purpose: set by hand\\nconsumes_files: [f]\"}}\n  two: {surface: {value: '[1'}}\n"})

    def surface(i):
        if i == "three":
            raise LookupError("out of order")
        return {"purpose": "p", "interaction_role_hints": ["wizard"]} if i == "four" else {"purpose": f"about {i}"}

    index(spark, root, out, responder(log, surface=surface))
    assert sorted(i["COMPONENT_ID"] for i in asked(log, "surface")) == ["four", "three", "two"]
    (only,) = asked(log, "edges")
    got = {r["id"]: r["surface"] for r in only["SURFACE_RECORDS"]}
    assert [r["id"] for r in only["SURFACE_RECORDS"]] == sorted(got) and (got["one"]["purpose"], got["one"]["consumes_files"]) == ("set by hand", ["f"])
    assert got["two"]["purpose"] == "about two" and got["three"]["notes"] == "no answer: LookupError: out of order" and "no surface" in got["four"]["notes"]


def test_recarve_gives_ids_anew(spark, tmp_path):
    root, out = str(tmp_path / "r"), str(tmp_path / "o")
    write(root, {"one/Cargo.toml": LIB, "one/a.txt": "x"})
    index(spark, root, out)
    os.rename(f"{root}/one", f"{root}/two")
    assert dirs_of(index(spark, root, out, options=Options(recarve=True))) == {"two": "two"}  # without it, equal content keeps its id


def catalogue(spark, n, seed=3):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        s = {"purpose": "p", "consumes_files": [f"f{r.randrange(n // 2)}.json"] * (k % 3 > 0), "produces_files": [f"out/F{r.randrange(n // 2)}.json"], "data_formats": ["json"] if k % 2 else [], "explicit_cross_component_mentions": [f"c{r.randrange(n)}"] if k % 4 == 0 else [], "external_tools_spawned": ["", " Make "][k % 2 :]}
        rows.append((f"g/c{k}", json.dumps(s)))
    return spark.createDataFrame(rows, "id string, t string").select("id", D.parse_surface(F.col("t")).alias("surface"))


@pytest.mark.parametrize(("n", "pack", "common"), [(60, 10, 12), (60, 3, 5), (200, 40, 40)])
def test_blocks_hold_every_pair_with_a_token_that_tells(spark, n, pack, common):
    told = catalogue(spark, n)
    index = Q.tokens(told).cache()
    post = {}
    for r in index.collect():
        post.setdefault(r["token"], set()).add(r["id"])
    assert "tool:make" in post and "id:c1" in post and not any(t.endswith(":") for t in post)
    pairs = {p for ids in post.values() if len(ids) <= common for p in itertools.combinations(sorted(ids), 2)}
    sets = [tuple(r["members"]) for r in Q.blocks(index, common).collect()]
    assert len(sets) == len(set(sets)) and {p for s in sets for p in itertools.combinations(s, 2)} == pairs
    requests = {}
    for r in Q.requests_for(told, pack, common).collect():
        requests.setdefault(r["request"], set()).add(r["id"])
    assert {p for ids in requests.values() for p in itertools.combinations(sorted(ids), 2)} >= pairs
    largest = max(map(len, sets))
    assert all(len(ids) <= max(pack, largest) for ids in requests.values()) and len(requests) <= len(sets)
    got = Q.coverage(index, common).first()
    met = sum(len(i) * (len(i) - 1) / 2 for i in post.values() if len(i) <= common)
    assert (got["met"], got["all"]) == (met, sum(len(i) * (len(i) - 1) / 2 for i in post.values())) and got["recall"] == met / got["all"]


def test_blocks_find_the_edges_of_one_request(spark):
    told = catalogue(spark, 60)
    # a model that sees an edge wherever a file written by one is read by another
    known = {r["id"]: r["surface"] for r in told.collect()}

    def answer(ids):
        return [edge(a, b) for a in sorted(ids) for b in sorted(ids) if a != b and any(w.lower().rpartition("/")[2] in known[b]["consumes_files"] for w in known[a]["produces_files"])]

    def run(pack):
        asked = Q.records(Q.requests_for(told, pack, 60), told).collect()
        rows = [(r["request"], json.dumps(answer([x["id"] for x in json.loads(r["inputs"])["SURFACE_RECORDS"]]))) for r in asked]
        return len(asked), sorted(map(tuple, (r["participants"] for r in Q.edges_of(spark.createDataFrame(rows, "request string, response string")).collect())))

    (one, whole), (many, packed) = run(60), run(8)
    assert one == 1 < many and whole and packed == whole
    assert Q.requests_for(told.limit(1)).count() == 0 and Q.requests_for(told.where("1 = 0")).count() == 0
