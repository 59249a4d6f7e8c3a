"""Responders, budgets, templates, the cache, JSONL sources, file walking."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.respond import cache as C
from lodestone.respond import charges as G
from lodestone.respond import templates as R
from lodestone.respond.core import Budget, Budgeted, BudgetExceeded, Canned, Config, Observed, Router, Sentinel, cache_key, canonical_json
from lodestone.sources import files as FS
from lodestone.sources import tables as S
from lodestone.streaming import incremental


def test_keys_ignore_order():
    fp = Canned({}).fingerprint()
    assert cache_key(fp, "p", {"a": 1, "b": 2}) == cache_key(fp, "p", {"b": 2, "a": 1}) != cache_key(fp, "q", {"a": 1, "b": 2})


def test_budget():
    b = Budget(10)
    b.charge(10)
    with pytest.raises(BudgetExceeded):
        b.charge(1)
    assert b.used == 10
    b = Budget(10, 8)
    with pytest.raises(BudgetExceeded):
        b.charge(5)
    b.charge(2)
    assert b.used == 10


def test_sentinel_sticks():
    c = Canned({("p", "{}"): "x" * 400})
    s = Sentinel(Budgeted(c, Budget(10)))
    for _ in range(2):
        with pytest.raises(BudgetExceeded):
            s.call("p", {})
    seen = []
    with pytest.raises(LookupError):
        Observed(c, lambda e, d: seen.append((e, d.get("ok")))).call("q", {})
    assert seen == [("started", None), ("ended", False)]


def test_router_and_config():
    a, b = Canned({("classify", "{}"): 1}), Canned({("edges", "{}"): 2})
    assert Router({"edges": b}, a).call("edges", {}) == 2
    with pytest.raises(ValueError):
        Router({}, a, fileless=(a,))
    c = Config("http/x", {"http": {"kind": "http"}}, {"classify": "nothing", "dance": "http/y"})
    assert len(c.problems()) == 6
    assert Config("c/x", {"c": {}}).problems() == []


def test_templates():
    assert R.render("a {{A}} {{{{X}}}} {{B}}", {"A": "x", "B": [1]}) == "a x {{X}} [1]"
    with pytest.raises(KeyError):
        R.render("{{A}}", {})
    with pytest.raises(ValueError):
        R.render("{{A", {"A": 1})
    assert R.split_at_boundary("h" + R.BOUNDARY + "t") == ("h", "t") and len(R.request_body("x")) == 1
    assert R.problems({"a": 1}, {"type": "object", "required": ["a", "b"]}) == ["missing b"]


def test_cache_answers_only_misses(spark):
    calls = Canned({("p", canonical_json({"n": n})): {"v": n} for n in range(3)})
    req = spark.createDataFrame([("p", canonical_json({"n": n})) for n in (0, 1, 1, 2, 7)], "prompt string, inputs string")
    asked = C.keyed(req, calls)
    empty = spark.createDataFrame([], C.SCHEMA)
    first = C.answer_all(C.misses(asked, empty), calls).cache()
    assert first.count() == 4 and first.where("response is null").count() == 1
    known = first.where("response is not null").drop("error")
    assert C.misses(asked, known).count() == 1 and C.hits(asked, known).count() == 3
    within = C.answer_within(C.misses(asked, empty), calls, Budget(4))
    assert {r["error"] is None for r in within.collect()} == {True, False}


def test_greedy_charges(spark):
    df = spark.createDataFrame([(0, 0, 6), (0, 1, 6), (0, 2, 4), (1, 0, 11)], "session int, seq int, cost int")
    assert [(r["accepted"], r["used"]) for r in G.greedy_charges(df, 10).orderBy("session", "seq").collect()] == [(True, 6), (False, 6), (True, 10), (False, 0)]


def test_jsonl(spark):
    lines = ["noise", '{"type":"result","result":"a"}', '{"type":"result","is_error":true,"result":"b"}', '{"type":"later"}']
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(lines)], "stream string, line_no int, line string")
    assert [(r["is_error"], r["result"]) for r in S.agent_results(df).collect()] == [(True, "b")]


def test_interpolation():
    assert S.interpolate("a: ${X} # ${Y}", {"X": "1"}) == "a: 1 # ${Y}"
    with pytest.raises(KeyError):
        S.interpolate("${Y}", {})


def test_cache_file(spark, tmp_path):
    p = str(tmp_path / "c.json")
    assert S.load_cache(spark, p).count() == 0
    row = ("t", "o", "m", "1", "p", '{"a":1}', '{"b":2}')
    S.save_cache(spark.createDataFrame([row], C.SCHEMA), p)
    assert tuple(S.load_cache(spark, p).first()) == row
    (tmp_path / "c.json").write_text("{")
    assert S.load_cache(spark, p).count() == 0


def tree(root, files):
    for p, body in files.items():
        full = os.path.join(root, p)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(body.encode() if isinstance(body, str) else body)


def test_walk(spark, tmp_path):
    root = str(tmp_path / "r")
    tree(root, {".gitignore": "ignored.txt\nbuild/\n!build/keep\n*.log\n!b.log\n", "ignored.txt": "x", "kept.txt": "k", "build/x": "1", "sub/ignored.txt": "y", "a.log": "", "b.log": "", "repo/.git/refs": "", "out/y": "1", "big": "z" * 50, "bin": b"a\0b", ".hidden": "h"})
    got = list(FS.walk(root, excluded=os.path.join(root, "out")))
    assert got == [".gitignore", ".hidden", "b.log", "big", "bin", "kept.txt", "repo/.git/"]
    assert "out/y" in list(FS.walk(root, excluded="/elsewhere")) and "ignored.txt" in list(FS.walk(root, respect_gitignore=False))
    rows = {r["path"]: (bytes(r["content"]), r["elided"]) for r in FS.read_tree(spark, root, limit=40).collect()}
    assert rows["big"] == (b"", True) and rows["bin"] == (b"", True) and rows["kept.txt"] == (b"k", False)
    via = {r["path"]: r["elided"] for r in FS.binary_files(spark, "file://" + root, limit=40).collect()}
    assert via["big"] and via["bin"] and not via["kept.txt"]


def test_answer_stream(spark, tmp_path):
    inbox, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    req = spark.createDataFrame([("p", '{"n":0}'), ("p", '{"n":0}')], "prompt string, inputs string")
    calls = Canned({("p", '{"n":0}'): 5})
    for _ in range(2):
        req.write.mode("append").parquet(inbox)
        incremental.answer_stream(spark, inbox, cache, calls, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(cache).select(F.col("response")).collect() == [("5",)]
