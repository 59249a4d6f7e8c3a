"""Candidate directories and their signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from . import enumerate as E
from .memo import digest_of


def candidate_dirs(files: DataFrame, additions: DataFrame | None = None, back_edges: DataFrame | None = None) -> DataFrame:
    """Directories with a manifest, repository roots, authored additions and carved directories, each once: ``dir``."""
    out = E.manifests_in(files).select(P.parent(F.col("path")).alias("dir")).unionByName(E.git_boundaries(files))
    for more in (additions, back_edges):
        if more is not None:
            out = out.unionByName(more.select("dir"))
    return out.distinct()


def bundles(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """Signals of each candidate: manifests right in it, whether it is a repository root, headings and interpreters below it.

    ``headings`` holds those of files at or directly under the directory and of its whole subtree alike;
    ``near_headings`` counts the former.
    """
    manifests = E.manifests_in(files).groupBy(P.parent(F.col("path")).alias("dir")).agg(F.array_sort(F.collect_set("path")).alias("manifests"))
    roots = E.git_boundaries(files).withColumn("is_git_root", F.lit(True))
    heads = E.under(E.doc_headings(files), dirs, itself=False).groupBy("dir").agg(
        F.array_sort(F.collect_list(F.struct("path", "line_no", "level", "text"))).alias("headings"),
        F.count_if(P.parent(F.col("path")) == F.col("dir")).alias("near_headings"),
    )
    bangs = E.under(E.shebangs(files), dirs, itself=False).groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("path", "interpreter"))).alias("shebangs"))
    out = dirs.select("dir").join(manifests, "dir", "left").join(roots, "dir", "left").join(heads, "dir", "left").join(bangs, "dir", "left")
    return out.select(
        "dir",
        F.coalesce("manifests", F.array().cast("array<string>")).alias("manifests"),
        F.coalesce("is_git_root", F.lit(False)).alias("is_git_root"),
        "headings",
        F.coalesce("near_headings", F.lit(0)).alias("near_headings"),
        "shebangs",
    )


def bundle_inputs(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """``(dir, digest)`` of what ``bundles`` and the rules read for each of ``dirs``: its own manifests, whether it is a
    repository root, and the descriptions and interpreters below it.

    Only these: neither the rest of a script nor a manifest further down changes a digest. A directory without any has the digest ''.
    """
    path, none = F.col("path"), F.lit(None).cast("string")
    dirs = dirs.select("dir").distinct()
    own = files.where(X.is_manifest(path)).select(P.parent(path).alias("dir"), "path", F.sha2("content", 256).alias("read"))
    below = files.select("path", F.when(X.is_readme(path), F.sha2("content", 256)).alias("text"), F.when(F.startswith("content", F.lit("#!")), X.shebang(F.col("content"))).alias("bang"))
    below = E.under(below.where("text is not null or bang is not null"), dirs, itself=False).select("dir", "path", F.to_json(F.struct("text", "bang")).alias("read"))
    roots = E.git_boundaries(files).select("dir", F.lit(".git").alias("path"), none.alias("read"))
    rows = own.unionByName(roots).join(dirs, "dir", "left_semi").unionByName(below)
    return dirs.join(digest_of(rows, "dir", F.col("path"), F.col("read")), "dir", "left").select("dir", F.coalesce("digest", F.lit("")).alias("digest"))


def files_below(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """The files that lie below any of ``dirs``."""
    paths = E.under(files.select("path"), dirs.select("dir").distinct(), itself=False).select("path").distinct()
    return files.join(paths, "path", "left_semi")
