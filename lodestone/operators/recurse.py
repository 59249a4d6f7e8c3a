"""Whether to carve deeper into a component, and the loop that does so."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import paths as P
from . import enumerate as E
from .settle import discard, settle


def policy_by_kind(kind: Column) -> Column:
    """``stop`` or ``recurse``; null where the kind alone doesn't tell."""
    return F.when(kind.isin(*vocab.RECURSE_KINDS), "recurse").when(~kind.isin(*vocab.LIBRARY_KINDS), "stop")


def policy(kind: Column, depth: Column, max_depth: Column, hint: Column) -> Column:
    """``stop``, ``recurse`` or ``ask``. Depth is checked first; a hint lifts the libraries' cap and settles the matter."""
    cap = F.when(hint, max_depth).otherwise(F.least(F.lit(vocab.LIBRARY_DEPTH_CAP), max_depth))
    library = F.when(depth >= cap, "stop").when(hint, "recurse").otherwise("ask")
    return F.when(depth >= max_depth, "stop").otherwise(F.coalesce(policy_by_kind(kind), library))


def immediate_subdirs(files: DataFrame, owned: DataFrame) -> DataFrame:
    """``(id, sub_dir)``: directories one level below a component's own that hold a file or a repository root, without its own.

    ``owned(id, dir)``, one row a path segment.
    """
    held = files.select(P.parent(F.col("path")).alias("path")).union(E.git_boundaries(files).select("dir")).where("path <> ''").distinct()
    spread = held.withColumn("up", F.explode(P.ancestors(F.col("path"))))
    below = spread.join(owned.select("id", F.col("dir").alias("up")), "up")
    n = F.size(F.split("up", "/")) + 1
    sub = F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/")
    return below.select("id", sub.alias("sub_dir")).distinct().join(owned.select("id", F.col("dir").alias("sub_dir")), ["id", "sub_dir"], "left_anti")


def without_suppressed(subdirs: DataFrame, names: DataFrame) -> DataFrame:
    """Drop sub-directories whose name, or its slug, is among ``names(id, name)`` or their slugs."""
    off = names.select("id", F.col("name").alias("n")).union(names.select("id", P.slug(F.col("name")))).where("n is not null").distinct()
    base = P.basename(F.col("sub_dir"))
    hit = subdirs.withColumn("n", F.explode(F.array_distinct(F.array(base, P.slug(base))))).join(off, ["id", "n"], "left_semi").select("id", "sub_dir")
    return subdirs.join(hit.distinct(), ["id", "sub_dir"], "left_anti")


def subcarve(subdirs: DataFrame, verdicts: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """``(id, carve, accepted, rejected, kept, rationale)`` from each sub-directory's classification ``(dir, kind, is_boundary)``."""
    v = subdirs.join(verdicts.select(F.col("dir").alias("sub_dir"), "kind", "is_boundary"), "sub_dir", "left")
    yes = F.coalesce(F.col("is_boundary"), F.lit(False))
    out = v.groupBy("id").agg(F.count_if(yes).alias("accepted"), F.count_if(~yes).alias("rejected"), F.array_sort(F.collect_list(F.when(yes, F.col("sub_dir")))).alias("kept"))
    out = out.join(hints.select("id", F.lit(True).alias("hint")), "id", "left") if hints is not None else out.withColumn("hint", F.lit(False))
    carve = F.col("accepted") > 0
    text = F.concat_ws(
        "; ",
        F.concat(F.lit("of "), (F.col("accepted") + F.col("rejected")).cast("string"), F.lit(" directories below, "), F.col("accepted").cast("string"), F.lit(" are components and "), F.col("rejected").cast("string"), F.lit(" are not")),
        F.when(carve, F.concat(F.lit("carved out "), F.array_join("kept", ", "))),
        F.when(F.coalesce("hint", F.lit(False)) & ~carve, F.lit("its edges fall into two parts, but no directory below is a boundary")),
    )
    return out.select("id", carve.alias("carve"), "accepted", "rejected", "kept", text.alias("rationale"))


def merge_back_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs ``(id, sub_dir)`` of both; the old ones stay, so the set only grows."""
    return old.union(new.join(old, ["id", "sub_dir"], "left_anti").select(*old.columns)).distinct()


def fixedpoint(step: Callable[[DataFrame], DataFrame], start: DataFrame, max_rounds: int = 8, hooks=None) -> tuple[DataFrame, int]:
    """Carve until no pair ``(id, sub_dir)`` is new: the set and the rounds that added something.

    ``step`` gives the pairs proposed with the current set. More than ``max_rounds`` productive rounds is an error.
    ``hooks`` may have ``before(round)`` and ``after(round, new)``, called on the driver.
    """
    known, rounds = settle(start), 0
    tried = 0
    while True:
        tried += 1
        if hooks is not None:
            hooks.before(tried)
        new = settle(step(known).select(*known.columns).join(known, known.columns, "left_anti").distinct())
        if hooks is not None:
            hooks.after(tried, new)
        if new.isEmpty():
            discard(new)
            return known, rounds
        rounds += 1
        if rounds >= max_rounds:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
        both = settle(known.union(new))
        discard(known, new)
        known = both
