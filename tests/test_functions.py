"""Scalar functions on hand-made cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.functions import manifests as M
from lodestone.functions import paths as P
from lodestone.functions import text as T


def values(spark, items, f, kind="string"):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(items)], f"k int, x {kind}")
    return [r["y"] for r in df.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_slug(spark):
    assert values(spark, ["My Weird Name!", "a---b", "--foo--", "/", "É", "İx", None], P.slug) == ["my-weird-name", "a-b", "foo", None, None, "x", None]
    assert values(spark, ["/", "x/y z"], P.leaf_slug) == ["root", "y-z"]
    assert values(spark, ["A b/c!/É/d"], P.slug_path) == ["a-b/c/d"]


def test_paths(spark):
    assert values(spark, ["a/b/c", "a", "/x/y"], P.parent) == ["a/b", "", "/x"]
    assert values(spark, ["a/b/c", "a"], lambda c: P.ancestors(c)) == [["a", "a/b"], []]
    assert values(spark, ["a/b", "ab", "a", "b"], lambda c: P.is_inside(c, "a")) == [True, False, True, False]
    assert values(spark, ["r/x", "r", "q"], lambda c: P.relative_to(c, "r")) == ["x", "", "q"]
    assert values(spark, ["x", "/y"], lambda c: P.absolute(c, "/r")) == ["/r/x", "/y"]
    assert values(spark, ["a/b", "/a", "a/../b"], P.is_safe_relative) == [True, False, False]
    assert values(spark, ["a/b"], P.short_hash) == [hashlib.sha256(b"a/b").hexdigest()[:8]]


@pytest.mark.parametrize(("glob", "crosses", "yes", "no"), [("services/auth/*", True, ["services/auth/api", "services/auth/a/b"], ["services/auth"]), ("*.rs", False, ["a.rs"], ["x/a.rs", "a.rst"]), ("**/x", False, ["x", "a/b/x"], ["ax"]), ("{a,b}?", False, ["ac", "bd"], ["c1", "a"]), ("[!a]", True, ["b"], ["a"])])
def test_globs(spark, glob, crosses, yes, no):
    assert values(spark, yes + no, lambda c: P.matches_glob(c, glob, crosses)) == [True] * len(yes) + [False] * len(no)


def test_bad_globs():
    for g in ("[x", "{a"):
        with pytest.raises(ValueError):
            P.glob_regex(g)


def test_headings(spark):
    lines = ["# Title", "### Sub ###", "#foo", "####### Deep", "", "#\tx", "# C#", "#   spaced"]
    assert values(spark, lines, T.heading_level) == [1, 3, None, None, None, None, 1, 1]
    assert values(spark, lines, T.heading_text) == ["Title", "Sub", None, None, None, None, "C", "  spaced"]


def test_files(spark):
    assert values(spark, ["a/Cargo.toml", "x.nix", "a/readme", "Dockerfile"], T.is_manifest) == [True, True, False, True]
    assert values(spark, ["a/ReadMe.md", "changelog", "x/read.me"], T.is_readme) == [True, True, False]
    assert values(spark, ["#!/bin/bash\nx", "#! /usr/bin/env python \r\n", "x"], T.shebang) == ["/bin/bash", "/usr/bin/env python", None]


def test_formats(spark):
    assert values(spark, [9999, 12345, 1234567], T.abbreviate, "long") == ["9999", "12.3k", "1.23M"]
    assert values(spark, [65, 0], T.minutes_seconds, "long") == ["01:05", "00:00"]
    assert values(spark, ["abcdef", "abc"], lambda c: T.clip(c, 4)) == ["abc…", "abc"]
    assert values(spark, ['```json\n{"a":1}\n```', " x "], T.strip_fence) == ['{"a":1}', "x"]
    assert values(spark, ["a<b&\"c\">"], T.escape_html) == ["a&lt;b&amp;&quot;c&quot;&gt;"]
    assert values(spark, ["rust-binary", "dmg", "website"], T.kind_suggestion) == ["rust-cli", "installer", None]
    assert values(spark, ["a/b/c", "x"], T.model_of) == ["b/c", "x"]


def test_short_numbers_round_as_c_does(spark):
    assert values(spark, [10250, 10350, 999950, 1005000, None], T.abbreviate, "long") == ["10.2k", "10.3k", "1000.0k", "1.00M", None]
    many = [*range(10050, 1_000_000, 100), *range(1_005_000, 30_000_000, 10_000), 12_345_675_000_000, 2**63 - 1]
    assert values(spark, many, T.abbreviate, "long") == [f"{n / 1e3:.1f}k" if n < 10**6 else f"{n / 1e6:.2f}M" for n in many]
    assert values(spark, [-65, 2**62 + 1, None], T.minutes_seconds, "long") == ["-1:-5", f"{(2**62 + 1) // 60}:{(2**62 + 1) % 60:02}", None]


def test_crate_shapes(spark):
    texts = ['[package]\n[lib]\n', '# [lib]\nx = "[[bin]]"\n', 'x = """\n[workspace]\n"""', "[bin]\n", "not = toml = x", None, "[[bin]]\nname='b'\n[workspace]\n"]
    got = values(spark, texts, lambda c: M.cargo_shape(c))
    assert [tuple(g) for g in got] == [(True, False, False), (False,) * 3, (False,) * 3, (False,) * 3, (False,) * 3, (False,) * 3, (False, True, True)]


def test_package_shapes(spark):
    texts = ['{"main":1,"bin":null}', "{", "[1]", '{"exports":{}}']
    assert [tuple(g) for g in values(spark, texts, M.package_shape)] == [(True, False, True), (False,) * 3, (False,) * 3, (False, True, False)]


def test_dependencies(spark):
    got = values(spark, ['[dependencies]\nserde="1"\nnear={path="x"}\nw={workspace=true}\n[dev-dependencies]\nt={version="2"}\n'], lambda c: M.cargo_dependencies(c))[0]
    assert [(g["id"], g["purl"]) for g in got] == [("crate:serde", "pkg:cargo/serde@1"), ("crate:w", None), ("crate:t", "pkg:cargo/t@2")]
    got = values(spark, ['{"dependencies":{"lodash":"^4.17.0","x":{"a":1}}}', "{"], M.package_dependencies)
    assert [(g["id"], g["purl"]) for g in got[0]] == [("npm:lodash", "pkg:npm/lodash@^4.17.0"), ("npm:x", None)] and not got[1]
