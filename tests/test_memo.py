"""Results kept between runs: what an edit makes anew, and that nothing else changes."""

import os

from pyspark.sql import functions as F
from test_respond import tree as write

from lodestone.operators import candidates as C
from lodestone.operators import classify as K
from lodestone.operators import enumerate as E
from lodestone.operators.memo import Memo, digest_of
from lodestone.plans.index import Options, index, ruled
from lodestone.sources import files as FS


def digests(spark, files, dirs, memo):
    return {r["dir"]: r["content_sha"] for r in memo.through("sha", E.tree_inputs(files, dirs), "dir", lambda missing: E.tree_sha(files, missing)).collect()}


def test_an_edit_makes_its_ancestors_anew(spark, tmp_path):
    n = 20_000
    path = F.concat(F.lit("r/a"), (F.col("id") % 40).cast("string"), F.lit("/b"), (F.col("id") % 5).cast("string"), F.lit("/f"), F.col("id").cast("string"))
    files = spark.range(n).select(path.alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
    dirs = spark.createDataFrame([("",), ("r",), *[(f"r/a{k}",) for k in range(40)], *[(f"r/a{k}/b{k % 5}",) for k in range(40)], ("none",)], "dir string")
    memo = Memo(spark, f"file://{tmp_path}/m")
    first = digests(spark, files, dirs, memo)
    assert memo.computed == 82 and len(first) == 82
    assert first == {r["dir"]: r["content_sha"] for r in E.tree_sha(files, dirs).collect()}
    assert digests(spark, files, dirs, memo) == first and memo.computed == 0
    edited = files.withColumn("content", F.when(F.col("path") == "r/a7/b2/f7", F.lit("new").cast("binary")).otherwise(F.col("content")))
    second = digests(spark, edited, dirs, memo)
    assert memo.computed == 4 and {d for d in second if second[d] != first[d]} == {"", "r", "r/a7", "r/a7/b2"}
    assert second == {r["dir"]: r["content_sha"] for r in E.tree_sha(edited, dirs).collect()}
    # back again: all known
    assert digests(spark, files, dirs, memo) == first and memo.computed == 0
    assert digests(spark, files.where("1 = 0"), dirs, memo) == {}


def test_digests_of_groups(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", None), ("b", "x", 1), ("c", "y", None), ("c", "x", 1), ("d", "x", 1), ("d", "x", 1)], "g string, s string, n int")
    got = {r["g"]: r["digest"] for r in digest_of(df, "g", F.col("s"), F.col("n")).collect()}
    assert got["a"] == got["c"] and len({got["a"], got["b"], got["d"]}) == 3


def test_a_run_over_an_edited_tree(spark, tmp_path):
    root, out = str(tmp_path / "r"), str(tmp_path / "o")
    lib = "[package]\n[lib]\n"
    write(root, {"a/Cargo.toml": lib, "a/in/Cargo.toml": lib, "a/in/x.rs": "1", "b/Cargo.toml": lib, "c/Cargo.toml": lib})
    options = Options(stages=f"file://{tmp_path}/stages")
    first = index(spark, root, out, options=options).summary
    assert first["hashed"] == 4 and first["ruled"] >= 4
    (tmp_path / "r" / "a" / "in" / "x.rs").write_text("2")
    again = index(spark, root, out, options=options)
    assert again.summary["hashed"] == 2 and again.summary["ruled"] == 0
    files = FS.read_tree(spark, root, excluded=out)
    got = {(s := x["path_segments"][0])["path"]: s["content_sha"] for x in again.components.collect()}
    assert got == {r["dir"]: r["content_sha"] for r in E.tree_sha(files, spark.createDataFrame([(d,) for d in ("a", "a/in", "b", "c")], "dir string")).collect()}
    assert os.path.isdir(f"{tmp_path}/stages/tree-sha")


def test_rules_read_what_changed_only(spark, tmp_path):
    n = 5000
    tree = spark.range(n).select(F.concat(F.lit("r/a"), (F.col("id") % 50).cast("string"), F.lit("/f"), F.col("id").cast("string")).alias("path"), F.lit("x").alias("content"))
    lib, tool = "[package]\n[lib]\n", "[package]\n[[bin]]\n"
    some = {f"r/a{k}/Cargo.toml": lib for k in range(50)} | {"r/README.md": "# r\n", "r/a1/README.md": "# one\n\ntext\n", "r/a2/run": "#!/bin/sh\necho\n", "r/g/.git/HEAD": "x", "r/a3/in/package.json": '{"bin": "b"}'}
    dirs = spark.createDataFrame([("",), ("r",), ("r/g",), ("r/a3/in",), ("r/none",), *[(f"r/a{k}",) for k in range(50)]], "dir string")
    memo = Memo(spark, f"file://{tmp_path}/m")

    def run(extra):
        files = tree.union(spark.createDataFrame(list(extra.items()), "path string, content string"))
        kept = ruled(files, dirs, memo)
        got = {r["dir"]: r for r in kept.collect()}
        assert got == {r["dir"]: r for r in ruled(files, dirs).select(*kept.columns).collect()}
        return got

    first = run(some)
    assert len(first) == 55 and memo.counts[K.KEPT_AS] == 55
    for edit, again in (
        ({"r/a7/Cargo.toml": tool}, 1),  # a manifest is read by its own directory
        ({"r/a1/README.md": "# two\n"}, 3),  # a description by all above
        ({"r/a2/run": "#!/bin/sh\nls\n"}, 0),  # of a script, the interpreter
        ({"r/a2/run": "#!/usr/bin/perl\nls\n"}, 3),
        ({"r/g/.git/HEAD": "y", "r/g/.git/index": "z"}, 0),  # of a repository, that there is one
        ({"r/none/.git": "gitdir: x"}, 1),
        ({"r/new/f": "x"}, 0),
    ):
        before = memo.counts[K.KEPT_AS]
        got = run(some | edit)
        assert memo.counts[K.KEPT_AS] - before == again, edit
        assert again == 0 or got != first
    empty = C.bundle_inputs(tree.where("1 = 0"), dirs)
    assert {r["digest"] for r in empty.collect()} == {""}
    assert run(some) == first
