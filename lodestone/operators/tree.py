"""The component tree: parents, ids, rename matching, tombstones, closures."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from .settle import discard, settle


def nearest_ancestor(dirs: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``(dir, parent_dir)``: the deepest confirmed directory strictly above, null without one."""
    up = dirs.select("dir", F.explode(P.ancestors(F.col("dir"))).alias("parent_dir"))
    hit = up.join(confirmed.select(F.col("dir").alias("parent_dir")), "parent_dir").groupBy("dir").agg(F.max_by("parent_dir", F.length("parent_dir")).alias("parent_dir"))
    return dirs.select("dir").join(hit, "dir", "left")


def allocate_in_group(parent: str | None, dirs: list[str], slugs: list[str], taken: set[str]) -> list[str]:
    """Ids for one parent's directories, in the given order; each new id counts as taken.

    The slug below the parent's id; then with -2 to -1000; then with eight digits of the path's digest,
    and that with -2 to -1000.
    """
    out, used = [], set(taken)

    def numbered(stem: str):
        yield stem
        for k in range(2, 1001):
            yield f"{stem}-{k}"

    for d, s in zip(dirs, slugs, strict=True):
        first = f"{parent}/{s}" if parent else s
        hashed = f"{first}-{hashlib.sha256(d.encode()).hexdigest()[:8]}"
        chosen = next((c for stem in (first, hashed) for c in numbered(stem) if c not in used), None)
        if chosen is None:
            raise ValueError(f"no free id for {d}")
        used.add(chosen)
        out.append(chosen)
    return out


def _full_paths(rows: DataFrame) -> DataFrame:
    """``(dir, id, parent_id)`` from ``rows(dir, above, segment)``: segments joined along the chain of ``above``, doubling the distance a round."""
    known = settle(rows.select("dir", F.col("above").alias("up"), F.col("segment").alias("path")))
    while not (open_ := known.where("up is not null")).isEmpty():
        far = known.select(F.col("dir").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        more = open_.join(far, "up").select("dir", F.col("next").alias("up"), F.concat_ws("/", "head", "path").alias("path"))
        nxt = settle(known.where("up is null").union(more))
        discard(known)
        known = nxt
    ids = known.select("dir", F.col("path").alias("id"))
    return rows.select("dir", "above").join(ids, "dir").join(ids.select(F.col("dir").alias("above"), F.col("id").alias("parent_id")), "above", "left").select("dir", "id", "parent_id")


def allocate_ids(nodes: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``(dir, id, parent_id)`` for ``nodes(dir, parent_dir, depth, slug)``, at any depth.

    Ids of different parents can't clash, so the groups, each one directory's direct components, are
    independent: a group fixes the last segments of its ids, family by family of slugs, and these are joined along the parents. Ids in
    ``taken`` bar segments below the parent they name; as long as that changes the ids of parents, the
    groups are tried again. The top settles first, so the rounds are at most the levels at which a taken id lies, and one.
    """
    known = nodes.select(F.col("dir").alias("parent_dir"), F.lit(True).alias("_known")).distinct()
    base = settle(nodes.join(known, "parent_dir", "left").select("dir", "slug", F.when(F.col("_known"), F.col("parent_dir")).alias("above")))
    group = F.when(F.col("above").isNull(), F.lit("top")).otherwise(F.concat(F.lit("in "), "above"))
    own = base.select(group.alias("grp"), "dir", "slug")
    bars = taken.select(P.parent(F.col("id")).alias("parent_id"), P.basename(F.col("id")).alias("dir")) if taken is not None else None

    ids = None
    while True:
        at = None
        if bars is not None:
            at = bars.where("parent_id = ''").select(F.lit("top").alias("grp"), "dir")
            if ids is not None:
                at = at.union(bars.join(ids.select(F.col("id").alias("parent_id"), F.concat(F.lit("in "), "dir").alias("grp")), "parent_id").select("grp", "dir"))
        new = settle(_full_paths(settle(base.join(_segments(own, at), "dir").select("dir", "above", "segment"))))
        if bars is None or (ids is not None and new.join(ids, ["dir", "id"], "left_anti").isEmpty()):
            return new
        ids = new


def _family(segment: Column) -> Column:
    """What is left of a segment without the numbers and digests at its end: only segments of one family can clash."""
    return F.regexp_replace(segment, r"(-([0-9]{1,4}|[0-9a-f]{8}))+$", "")


def _segments(own: DataFrame, bars: DataFrame | None) -> DataFrame:
    """``(dir, segment)``: the last segments of ids, as ``allocate_in_group`` gives them, for ``own(grp, dir, slug)``.

    Where all of a family have one slug and none is barred, a directory's rank among them tells its segment. The others, whose
    slugs end in numbers that another's may take, or with barred segments (``bars(grp, dir)``), are settled one after another,
    a family at a time.
    """
    rows = own.withColumn("fam", _family(F.col("slug")))
    whole = Window.partitionBy("grp", "fam")
    marked = rows.withColumn("plain", F.min("slug").over(whole) == F.max("slug").over(whole))
    if bars is not None:
        at = bars.select("grp", F.col("dir").alias("bar"), _family(F.col("dir")).alias("fam"))
        marked = marked.join(at.select("grp", "fam").distinct().withColumn("barred", F.lit(True)), ["grp", "fam"], "left").withColumn("plain", F.col("plain") & F.col("barred").isNull()).drop("barred")
    marked = settle(marked)
    many = F.lit(1000)
    hashed = F.concat("slug", F.lit("-"), F.substring(F.sha2("dir", 256), 1, 8))
    ranked = marked.where("plain").withColumn("r", F.row_number().over(whole.orderBy("dir"))).withColumn("h", F.when(F.col("r") > many, hashed))
    ranked = ranked.withColumn("j", F.row_number().over(Window.partitionBy("grp", "fam", "h").orderBy("dir")))
    numbered = lambda stem, k: F.when(k == 1, stem).otherwise(F.concat(stem, F.lit("-"), k.cast("string")))
    easy = ranked.select("dir", F.when(F.col("h").isNull(), numbered(F.col("slug"), F.col("r"))).when(F.col("j") <= many, numbered(F.col("h"), F.col("j"))).alias("segment"))
    hard = marked.where("not plain").select("grp", "fam", "dir", "slug")
    if bars is not None:
        hard = hard.union(at.join(hard.select("grp", "fam").distinct(), ["grp", "fam"], "left_semi").select("grp", "fam", F.col("bar").alias("dir"), F.lit(None).cast("string").alias("slug")))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf[pdf["slug"].notna()].sort_values("dir")
        barred = set(pdf.loc[pdf["slug"].isna(), "dir"])
        return pd.DataFrame({"dir": mine["dir"].tolist(), "segment": allocate_in_group(None, mine["dir"].tolist(), mine["slug"].tolist(), barred)})

    return easy.union(hard.groupBy("grp", "fam").applyInPandas(assign, "dir string, segment string"))


def match_renames(prior: DataFrame, live: DataFrame) -> DataFrame:
    """``(content_sha, live_key, prior_id, state)``: equal digests pair up one to one in key order.

    ``prior(id, content_sha)``, ``live(key, content_sha)``. State: ``matched``, ``fresh`` or ``orphan``.
    """
    rank = lambda by: F.row_number().over(Window.partitionBy("content_sha").orderBy(by))
    a = prior.select("content_sha", F.col("id").alias("prior_id"), rank("id").alias("rn"))
    b = live.select("content_sha", F.col("key").alias("live_key"), rank("key").alias("rn"))
    state = F.when(F.col("prior_id").isNull(), "fresh").when(F.col("live_key").isNull(), "orphan").otherwise("matched")
    return a.join(b, ["content_sha", "rn"], "full_outer").select("content_sha", "live_key", "prior_id", state.alias("state"))


def tombstones(prior: DataFrame, kept: DataFrame) -> DataFrame:
    """Live prior rows whose id no live row carries on, once more with ``deleted`` set; earlier tombstones go."""
    return prior.where(~F.col("deleted")).join(kept.select("id"), "id", "left_anti").withColumn("deleted", F.lit(True))


def closure(tree: DataFrame) -> DataFrame:
    """``(id, ancestor, distance)`` for every node of ``tree(id, parent)`` and every node above it, at any depth.

    Doubles the distance covered in each round. A cycle raises an error.
    """
    known = settle(tree.where("parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    reach = 1
    while True:
        near = known.where(F.col("distance") == reach).select(F.col("id").alias("low"), F.col("ancestor").alias("id"), F.col("distance").alias("first"))
        more = settle(near.join(known, "id").select(F.col("low").alias("id"), "ancestor", (F.col("first") + F.col("distance")).alias("distance")))
        if more.isEmpty():
            return known
        if not more.where("id = ancestor").isEmpty():
            raise ValueError("the parents form a cycle")
        both = settle(known.union(more))
        discard(known, more)
        known = both
        reach *= 2


def depths(tree: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """``(id, depth)``: 0 at a root."""
    above = closure(tree) if above is None else above
    return tree.select("id").join(above.groupBy("id").agg(F.max("distance").alias("depth")), "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth"))


def on_cycles(tree: DataFrame) -> DataFrame:
    """Ids whose parent chain never ends, at any depth.

    Every node looks twice as far up in each round; those whose chain has ended go. A chain that ends later has
    nodes near its end, so when none goes in a round, no other ever will.
    """
    nodes = tree.select("id", "parent")
    live = settle(nodes.join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", F.col("parent").alias("up")))
    count = live.count()
    while count:
        nxt = settle(live.join(live.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")))
        discard(live)
        live, before = nxt, count
        if (count := live.count()) == before:
            break
    return live.select("id")


def lines(above: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, line)`` of ``nodes(id)``: the ids from the root down to the node itself; ``above`` is the closure."""
    line = above.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor"))), lambda x: x["ancestor"]).alias("up"))
    return nodes.select("id").join(line, "id", "left").select("id", F.concat(F.coalesce("up", F.array().cast(line.schema["up"].dataType)), F.array("id")).alias("line"))


def suppress_children(tree: DataFrame, pins: DataFrame) -> DataFrame:
    """``tree`` without the ids that a live component's pin suppresses; ``pins(key, children)``."""
    live = pins.join(tree.select(F.col("id").alias("key")), "key", "left_semi")
    return tree.join(live.select(F.explode("children").alias("id")).distinct(), "id", "left_anti")


def with_additions(rows: DataFrame, additions: DataFrame, suppressed: DataFrame) -> DataFrame:
    """``rows`` and the authored ``additions``, of the same columns, whose ids aren't ``suppressed(id)``."""
    return rows.unionByName(additions.join(suppressed.select("id").distinct(), "id", "left_anti").select(*rows.columns))


def children(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """``(parent, id)``: the direct components below each of ``ids(id)``."""
    return tree.where("parent is not null").join(ids.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi").select("parent", "id")


def segments(components: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, path)``: the path segments of each of ``ids(id)``; ``components(id, paths)``. Unknown ids give none."""
    return components.join(ids.select("id").distinct(), "id", "left_semi").select("id", F.explode("paths").alias("path"))
