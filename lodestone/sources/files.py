"""File trees as ``files(path, content, elided)``, listed and read on the executors.

Paths are relative to the root. The root must be readable by the executors. ``binary_files`` reads through Spark instead, for trees
in any store, without ignore rules.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import glob_regex
from ..operators.settle import settle

LIMIT, SNIFF = 1 << 20, 8192
SCHEMA = "path string, content binary, size long, elided boolean"


class IgnoreRules:
    """One ignore file's patterns, relative to its directory; the last that matches decides."""

    def __init__(self, text: str):
        self.rules = []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line.removeprefix("\\")
            only_dir = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            line = line.removeprefix("/")
            self.rules.append((re.compile(glob_regex(line, crosses_slash=False)), anchored, only_dir, keep))

    def verdict(self, rel: str, is_dir: bool) -> bool | None:
        """True: ignored, False: kept on purpose, None: nothing said."""
        out = None
        for rx, anchored, only_dir, keep in self.rules:
            if only_dir and not is_dir:
                continue
            if rx.match(rel if anchored else rel.rsplit("/", 1)[-1]):
                out = not keep
        return out


def _skipped(root: str, excluded: str | None) -> str | None:
    skip = os.path.relpath(os.path.realpath(excluded), os.path.realpath(root)) if excluded else None
    return None if skip in (None, ".") or skip.startswith("..") else skip.replace(os.sep, "/")


@lru_cache(maxsize=1024)
def _rules_of(folder: str) -> tuple[IgnoreRules, ...]:
    """The rules that stand in a directory: the repository's own exclude file, then the ignore file."""
    out = []
    for name in (".git/info/exclude", ".gitignore"):
        f = os.path.join(folder, name)
        if os.path.isfile(f):
            with open(f, encoding="utf-8", errors="replace") as h:
                out.append(IgnoreRules(h.read()))
    return tuple(out)


def _entries(root: str, rel: str, bases: tuple[str, ...], respect: bool, skip: str | None) -> tuple[tuple[str, ...], list[tuple[str, bool]]]:
    """One directory: the directories whose rules hold below it, and its entries ``(path, is a directory to enter)`` in order."""
    here = os.path.join(root, rel) if rel else root
    if respect and _rules_of(here):
        bases = (*bases, rel)
    out = []
    for name in sorted(os.listdir(here)):
        p = f"{rel}/{name}" if rel else name
        full = os.path.join(here, name)
        is_dir = os.path.isdir(full) and not os.path.islink(full)
        if p == skip:
            continue
        if name == ".git":
            out.append((p + "/" if is_dir else p, False))
            continue
        said = None
        for base in bases:
            for r in _rules_of(os.path.join(root, base) if base else root):
                v = r.verdict(p[len(base) + 1 :] if base else p, is_dir)
                said = v if v is not None else said
        if not said and (is_dir or os.path.isfile(full)):
            out.append((p, is_dir))
    return bases, out


def walk(root: str, respect_gitignore: bool = True, excluded: str | None = None) -> Iterator[str]:
    """Relative paths of files in order; ``.git`` itself is listed (with a slash if it is a directory) but not entered.

    Ignore files of the tree and the repository's own exclude file count, those above the root don't.
    Hidden files are listed. ``excluded`` below the root is left out; elsewhere it is ignored.
    """
    root = os.path.abspath(root)
    skip = _skipped(root, excluded)
    _rules_of.cache_clear()

    def go(rel: str, bases: tuple[str, ...]) -> Iterator[str]:
        bases, found = _entries(root, rel, bases, respect_gitignore, skip)
        for p, enter in found:
            if enter:
                yield from go(p, bases)
            else:
                yield p

    yield from go("", ())


def listing(spark: SparkSession, root: str, respect_gitignore: bool = True, excluded: str | None = None, share: int = 4096) -> DataFrame:
    """``path`` of the files that ``walk`` gives, listed by executors.

    A row of the frontier is a directory to enter, with the names of those above it whose ignore rules hold. A task goes
    down from its directory until it has seen about ``share`` entries and hands the directories it didn't enter to the next round.
    """
    root = os.path.abspath(root)
    skip = _skipped(root, excluded)

    def run(batches):
        _rules_of.cache_clear()
        for pdf in batches:
            rows: list[tuple[str, bool, list[str]]] = []
            for rel, bases in zip(pdf["path"], pdf["bases"], strict=True):
                todo, seen = deque([(rel, tuple(bases))]), 0
                while todo and seen < share:
                    here, above = todo.popleft()
                    held, found = _entries(root, here, above, respect_gitignore, skip)
                    seen += len(found) + 1
                    rows += [(p, False, []) for p, enter in found if not enter]
                    todo.extend((p, held) for p, enter in found if enter)
                rows += [(p, True, list(b)) for p, b in todo]
            yield pd.DataFrame(rows, columns=["path", "enter", "bases"])

    schema = "path string, enter boolean, bases array<string>"
    frontier, parts = spark.createDataFrame([("", True, [])], schema), []
    most, n = 4 * spark.sparkContext.defaultParallelism, 1
    while n:
        got = settle(frontier.select("path", "bases").repartition(min(n, most)).mapInPandas(run, schema))
        parts.append(got.where("not enter").select("path"))
        frontier = got.where("enter")
        n = frontier.count()
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def read_tree(spark: SparkSession, root: str, respect_gitignore: bool = True, excluded: str | None = None, limit: int = LIMIT, partitions: int | None = None) -> DataFrame:
    """The tree's files; contents over ``limit`` bytes, or with a zero byte near their beginning, are empty and marked."""
    root = os.path.abspath(root)
    paths = listing(spark, root, respect_gitignore, excluded)
    paths = paths.repartition(partitions or max(1, paths.count() // 500 + 1))

    def read(batches):
        for pdf in batches:
            content, size, gone = [], [], []
            for p in pdf["path"]:
                full = os.path.join(root, p)
                n = os.path.getsize(full) if os.path.isfile(full) else 0
                data = b""
                if 0 < n <= limit:
                    with open(full, "rb") as f:
                        data = f.read(limit + 1)
                binary = b"\0" in data[:SNIFF]
                big = n > limit
                content.append(b"" if big or binary else data)
                size.append(n)
                gone.append(big or binary)
            yield pdf.assign(path=pdf["path"].str.rstrip("/"), content=content, size=size, elided=gone)

    return paths.mapInPandas(read, SCHEMA)


def binary_files(spark: SparkSession, address: str, limit: int = LIMIT) -> DataFrame:
    """The same table through Spark's own reader, for any file system."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(address)
    base = re.escape(address.rstrip("/").split(":", 1)[-1].lstrip("/"))
    path = F.regexp_replace("path", rf"^[a-zA-Z0-9+.-]*:/*{base}/", "")
    zero = F.hex(F.substring(F.col("content"), 1, SNIFF)).rlike("^(..)*00")
    gone = (F.col("length") > limit) | zero
    return raw.select(path.alias("path"), F.when(gone, F.lit(b"")).otherwise(F.col("content")).alias("content"), F.col("length").alias("size"), gone.alias("elided"))


def with_text(files: DataFrame) -> DataFrame:
    """Contents as text, for the text operators; bytes that aren't UTF-8 are replaced."""
    return files.withColumn("content", F.decode("content", "utf-8"))

