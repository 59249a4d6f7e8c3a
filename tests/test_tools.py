"""Progress events, reading tools, packaged prompts, the cache's counters, kinds in use."""

import os

import pytest

from lodestone import prompts
from lodestone.operators import enumerate as E
from lodestone.operators import evaluate as V
from lodestone.respond import cache as C
from lodestone.respond import progress as G
from lodestone.respond import sandbox as B
from lodestone.respond.core import PROMPTS


def write(root, files):
    for p, body in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, p)), exist_ok=True)
        with open(os.path.join(root, p), "w") as f:
            f.write(body)


def test_a_run_tells_what_happens(spark, tmp_path):
    from lodestone.plans.index import index

    root = str(tmp_path / "r")
    write(root, {"lib/Cargo.toml": "[package]\n[lib]\n", "ws/Cargo.toml": "[workspace]\n", "ws/inner/package.json": '{"main":"x"}', "odd/readme.md": "# odd\n", "odd/go.mod": "x"})

    class Describes:
        def fingerprint(self):
            from lodestone.respond.core import Fingerprint

            return Fingerprint("t", "o", "m", "1")

        def call(self, prompt, inputs):
            return {"classify": {"kind": "service"}, "surface": {"purpose": "p"}, "edges": []}[prompt]

    seen = G.Recorder()
    r = index(spark, root, str(tmp_path / "o"), Describes(), progress=seen)
    kinds = [type(e).__name__ for e in seen.events]
    assert kinds[0] == "Started" and kinds[-1] == "Finished"
    assert [e.name for e in seen.events if isinstance(e, G.Phase)] == ["seed", "fixedpoint", "project", "edges"]
    assert kinds.count("RoundStarted") == kinds.count("RoundEnded") >= 1
    done = seen.events[-1]
    told = [e for e in seen.events if isinstance(e, G.Surface)]
    assert [e.k for e in told] == list(range(1, done.components + 1)) and {e.n for e in told} == {done.components}
    assert done.calls == r.summary["calls"] == sum(done.by_prompt.values()) and done.by_prompt["surface"] == done.components
    assert all(G.told(e) for e in seen.events)
    again = G.Recorder()
    index(spark, root, str(tmp_path / "o"), Describes(), progress=again)
    assert again.events[-1].calls == 0 and not any(isinstance(e, G.Surface) for e in again.events)


def test_event_lines():
    assert G.told(G.Carving("c", "a/b", 1, 2)) == "  carving 1/2 c (a/b)"
    assert G.told(G.Finished(3, 2, 10, 100, 61.5, {"surface": 2})) == "done in 01:01: 3 components, 2 calls (2 surface), 10/100 tokens"
    with pytest.raises(TypeError):
        G.told("x")


def test_tools_stay_inside(tmp_path):
    root, out = tmp_path / "r", tmp_path / "out"
    write(str(root), {"a/x.txt": "one\ntwo\nthree\n", "a/y.md": "two\n", "b/z.txt": "é" * 100})
    write(str(out), {"secret.txt": "two\n"})
    os.symlink(out, root / "leak")
    os.symlink(out / "secret.txt", root / "a" / "leak.txt")
    os.symlink(root / "b", root / "inside")
    os.symlink(out / "not-there", root / "dangling")
    t = B.SandboxedFiles(str(root), budget=120, cap=100)
    for bad in ("/etc/passwd", "../out/secret.txt", "a/../../out", "leak/secret.txt", "a/leak.txt", "dangling/new"):
        with pytest.raises(B.Escape):
            t.read_file(bad)
        with pytest.raises(B.Escape):
            t.list_dir(bad)
    with pytest.raises(B.Escape):
        t.glob("../*")
    with pytest.raises(B.Escape):
        t.grep("two", ["leak"])
    assert B.resolve(str(root), "inside/z.txt") == str(root / "b" / "z.txt") and B.resolve(str(root), "new/file") == str(root / "new" / "file")
    assert t.glob("a/*")["paths"] == ["a/x.txt", "a/y.md"]
    assert [(m["path"], m["line"]) for m in t.grep("^two", [])["matches"]] == [("a/x.txt", 2), ("a/y.md", 1)]
    assert t.grep("t", ["a/x.txt"], 1) == {"matches": [{"path": "a/x.txt", "line": 2, "text": "two"}], "truncated": True}
    assert [e["name"] for e in t.list_dir("a")["entries"]] == ["leak.txt", "x.txt", "y.md"]
    assert t.read_file("a/x.txt", 3) == {"content": "one", "bytes": 3, "truncated": True}
    assert t.read_file("b/z.txt")["bytes"] == 100 and t.read_file("b/z.txt")["bytes"] == 17 and t.read_file("a/y.md")["bytes"] == 0
    assert t.bytes_read == 120


def test_packaged_prompts(tmp_path):
    assert prompts.problems() == []
    assert len({prompts.template(n) for n in PROMPTS}) == len(PROMPTS) and len(prompts.packaged_sha()) == 64
    assert sorted(map(os.path.basename, prompts.write_to(str(tmp_path)))) == sorted(f"{n}.md" for n in PROMPTS)
    with pytest.raises(KeyError):
        prompts.template("../x")


def test_cache_counters(spark):
    key = ("t", "o", "m", "1", "p")
    rows = lambda *xs: spark.createDataFrame([(*key, i, a, e) for i, a, e in xs], C.SCHEMA + ", error string")
    store = C.ResponseCache(spark.createDataFrame([], C.SCHEMA))
    assert store.record(rows(("1", "a", None), ("2", None, "x"), ("3", "c", None))) == 1
    assert (store.calls, store.errors) == (2, 1)
    store.seed(rows(("1", "new", None), ("0", "z", None)).drop("error"))
    assert [(r["inputs"], r["response"]) for r in store.snapshot().collect()] == [("0", "z"), ("1", "new"), ("3", "c")]
    assert (store.calls, store.errors) == (2, 1)
    asked = rows(("1", None, None), ("9", None, None)).drop("response", "error")
    assert [r["inputs"] for r in store.missing(asked).collect()] == ["9"] and [r["response"] for r in store.found(asked).collect()] == ["new"]
    store.clear()
    assert (store.calls, store.errors, store.snapshot().count()) == (0, 0, 0)


def test_kinds_and_lookup(spark):
    used = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "kind string")
    assert sorted(tuple(r) for r in V.kinds_in_use(used, ("a", "b")).collect()) == [("a", "in use"), ("b", "unused"), ("z", "unknown")]
    files = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, content string")
    wanted = spark.createDataFrame([("y",), ("y",), ("w",)], "path string")
    assert [tuple(r) for r in E.by_path(files, wanted).collect()] == [("y", "2")]
