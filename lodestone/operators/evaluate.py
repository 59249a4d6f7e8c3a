"""Evaluation: overlap metrics, differences between runs, invariants. Components have ``id, paths, kind`` and more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(l, r, jaccard)`` of all pairs that share a path; a pair without a common path has 0 and no row."""
    a = left.select(F.col("id").alias("l"), F.size(F.array_distinct("paths")).alias("nl"), F.explode(F.array_distinct("paths")).alias("p"))
    b = right.select(F.col("id").alias("r"), F.size(F.array_distinct("paths")).alias("nr"), F.explode(F.array_distinct("paths")).alias("p"))
    return a.join(b, "p").groupBy("l", "r", "nl", "nr").agg(F.count("*").alias("c")).select("l", "r", (F.col("c") / (F.col("nl") + F.col("nr") - F.col("c"))).alias("jaccard"))


def best_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(id, best)``: each left component's best overlap, 0 without any."""
    top = overlaps(left, right).groupBy(F.col("l").alias("id")).agg(F.max("jaccard").alias("best"))
    return left.select("id").join(top, "id", "left").select("id", F.coalesce("best", F.lit(0.0)).alias("best"))


def _share(hit: Column, empty: float) -> Column:
    return F.coalesce(F.avg(hit.cast("double")), F.lit(empty))


def coverage(golden: DataFrame, tool: DataFrame, threshold: float = 0.5) -> DataFrame:
    return best_overlap(golden, tool).agg(_share(F.col("best") >= threshold, 1.0).alias("coverage"))


def spurious_rate(golden: DataFrame, tool: DataFrame, threshold: float = 0.5) -> DataFrame:
    return best_overlap(tool, golden).agg(_share(F.col("best") < threshold, 0.0).alias("spurious_rate"))


def best_match(golden: DataFrame, tool: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(id, match)``: the tool component of best overlap at or above the threshold; ties go to the earlier one by ``ord``."""
    o = overlaps(golden, tool).where(F.col("jaccard") >= threshold).join(tool.select(F.col("id").alias("r"), "ord"), "r")
    return o.groupBy(F.col("l").alias("id")).agg(F.max_by("r", F.struct("jaccard", -F.col("ord"))).alias("match"))


def kind_accuracy(golden: DataFrame, tool: DataFrame, threshold: float = 0.5) -> DataFrame:
    m = best_match(golden, tool, threshold).join(golden.select("id", F.col("kind").alias("gk")), "id").join(tool.select(F.col("id").alias("match"), F.col("kind").alias("tk")), "match")
    return m.agg(_share(F.col("gk") == F.col("tk"), 1.0).alias("kind_accuracy"))


def precision_recall(golden_keys: DataFrame, tool_keys: DataFrame) -> DataFrame:
    """``(precision, recall)`` on distinct keys; an empty side counts as perfect."""
    g, t = golden_keys.select("key").distinct(), tool_keys.select("key").distinct()
    both = g.withColumn("g", F.lit(1)).join(t.withColumn("t", F.lit(1)), "key", "full_outer").agg(F.count("g").alias("g"), F.count("t").alias("t"), F.count_if(F.col("g").isNotNull() & F.col("t").isNotNull()).alias("b"))
    return both.select(F.when(F.col("t") == 0, 1.0).otherwise(F.col("b") / F.col("t")).alias("precision"), F.when(F.col("g") == 0, 1.0).otherwise(F.col("b") / F.col("g")).alias("recall"))


def identifier_stability(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of the first run's ids that the second has."""
    had = a.select("id").distinct().join(b.select("id", F.lit(True).alias("y")).distinct(), "id", "left")
    return had.agg(_share(F.coalesce("y", F.lit(False)), 1.0).alias("stability"))


def diff_components(base: DataFrame, new: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``(id, change, fields)``: added, removed, or modified with the names of the fields that differ."""
    a, b = base.alias("a"), new.alias("b")
    j = a.join(b, "id", "full_outer").select("id", F.col("a._in").alias("ain"), F.col("b._in").alias("bin"), *[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)).alias(f"d_{f}") for f in fields])
    change = F.when(F.col("ain").isNull(), "added").when(F.col("bin").isNull(), "removed").otherwise("modified")
    names = F.when(change == "modified", F.concat_ws(",", *[f"d_{f}" for f in fields])).otherwise("")
    return j.select("id", change.alias("change"), names.alias("fields")).where("change <> 'modified' or fields <> ''")


def diff(base: DataFrame, new: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    mark = lambda d: d.select("id", *fields, F.lit(True).alias("_in"))
    return diff_components(mark(base), mark(new), fields)


def diff_keys(base: DataFrame, new: DataFrame) -> DataFrame:
    """``(key, change)`` of keys that only one side has."""
    a, b = base.select("key").distinct(), new.select("key").distinct()
    return b.join(a, "key", "left_anti").select("key", F.lit("added").alias("change")).union(a.join(b, "key", "left_anti").select("key", F.lit("removed")))


def identifier_changes(base: DataFrame, new: DataFrame) -> DataFrame:
    """``(prior_id, new_id)`` of components with one content and different ids; of several prior ones the last by ``ord`` counts."""
    last = base.groupBy("content_sha").agg(F.max_by("id", "ord").alias("prior_id"))
    return new.join(last, "content_sha").where("id <> prior_id").select("prior_id", F.col("id").alias("new_id")).distinct()


def path_overlaps(segments: DataFrame, above: DataFrame) -> DataFrame:
    """``(a, b, path_a, path_b)``: components with overlapping paths of which neither is above the other.

    ``segments(id, path)``, ``above(id, ancestor)``. Paths are paired through their ancestors, by equality.
    """
    up = segments.select(F.col("id").alias("a"), F.col("path").alias("path_a"), F.explode(P.ancestors(F.col("path"), itself=True)).alias("path_b"))
    pairs = up.join(segments.select(F.col("id").alias("b"), F.col("path").alias("path_b")), "path_b").where("a <> b")
    # equal paths come both ways; the smaller id goes first
    pairs = pairs.where("path_a <> path_b or a < b")
    kin = above.select(F.col("id").alias("a"), F.col("ancestor").alias("b")).union(above.select("ancestor", "id"))
    return pairs.join(kin.distinct(), ["a", "b"], "left_anti").select("a", "b", "path_a", "path_b").distinct()


def unknown_participants(edges: DataFrame, known: DataFrame) -> DataFrame:
    """``(key, id)`` for each end of an edge that no known id stands for."""
    return edges.select("key", F.explode("participants").alias("id")).join(known.select("id"), "id", "left_anti").select("key", "id").distinct()


def uncovered_manifests(found: DataFrame, components: DataFrame) -> DataFrame:
    return found.select("path").distinct().join(components.select(F.explode("manifests").alias("path")), "path", "left_anti")


def empty_paths(components: DataFrame) -> DataFrame:
    """Components without a path, or with an empty one."""
    return components.where((F.size("paths") == 0) | F.array_contains("paths", "")).select("id")


def missing_git_rationale(components: DataFrame, git_dirs: DataFrame) -> DataFrame:
    """Components that stand on a repository root only and don't say so among their evidence."""
    only = components.where(F.size("manifests") == 0).select("id", F.explode("paths").alias("dir"), "evidence_fields")
    return only.join(git_dirs, "dir", "left_semi").where(~F.exists("evidence_fields", lambda e: F.contains(e, F.lit("git")))).select("id")


def broken_round_trips(prior: DataFrame, live: DataFrame) -> DataFrame:
    """Components whose content is that of a prior one but whose id is not carried over."""
    return identifier_changes(prior, live)


def summary(results: DataFrame) -> DataFrame:
    """One line on ``results(name, passed)``: how many passed, or which failed."""
    n = F.count("*").cast("string")
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name"))))
    return results.agg(F.when(F.size(failed) == 0, F.concat(n, F.lit("/"), n, F.lit(" passed"))).otherwise(F.concat(F.lit("failed: "), F.array_join(failed, ", "))).alias("summary"))


def kinds_in_use(used: DataFrame, vocabulary: tuple[str, ...]) -> DataFrame:
    """``(kind, state)``: each kind of ``used(kind)`` or of the vocabulary is ``in use``, ``unused`` or ``unknown``."""
    listed = used.sparkSession.createDataFrame([(k,) for k in vocabulary], "kind string")
    both = used.select("kind").where("kind is not null").distinct().withColumn("u", F.lit(True)).join(listed.withColumn("v", F.lit(True)), "kind", "full_outer")
    return both.select("kind", F.when(F.col("u") & F.col("v"), "in use").when(F.col("v"), "unused").otherwise("unknown").alias("state"))
