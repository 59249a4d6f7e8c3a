"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Every source's target is its weighted share of all words, held to ``cap`` times what the source
has; what is cut off is shared out again by weight. Within a source, documents stand in hash order
and the stream of their words repeats until the target is reached, so that a document is taken in
whole passes and at most one copy a source is cut. The source's weight changes linearly over
training time t in [0, 1]: w(t) = w (1 + a (2t - 1)). Its integral, the cumulative demand, is
D(t) = target (t + a (t^2 - t)); inverting it at the words before a copy gives the copy's training
position. Documents are range-sorted by position.

The running sum of words goes in two levels, so that a source of any size is dealt to many tasks:
documents fall into hash-ordered buckets (the square root of the row count for each source), bucket
totals are summed up along the bucket order, and rows within a bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, materialise, text_or_empty, without_names

SLOPES = (-0.5, 0.0, 0.5)
_GAP = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0) -> DataFrame:
    """``(skey, source_size)`` of each source to ``(skey, source_size, rank, target)``.

    Weights repeat along the sources' order by key. In ascending order of cap/weight, a source
    is held at its cap when its share of what the sources before it leave would exceed the cap; the
    others share the rest by weight. Sources are few beside documents; their table is one window.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy("skey"))).withColumn("w", w).withColumn("top", F.col("source_size") * F.lit(float(cap)))
    line = Window.orderBy(F.col("top") / F.col("w"), "skey")
    every = Window.partitionBy()
    before = F.coalesce(F.sum("top").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(every) - before) / F.sum("w").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    held = ranked.withColumn("level", level).withColumn("held", F.col("top") <= F.col("w") * F.col("level"))
    # levels fall from the first source that isn't held onwards, so its level is the largest among them
    free = F.max(F.when(~F.col("held"), F.col("level"))).over(every)
    return held.withColumn("target", F.when(F.col("held"), F.col("top")).otherwise(F.col("w") * free)).select("skey", "rank", "target")


def place(documents: DataFrame, carry: list[str], text_col: str = "text", **options) -> DataFrame:
    """``carry`` columns of each row, with ``size``, ``source_size``, ``target`` and ``copies``.

    ``copies`` is an array of ``(copy, words, position)``: the passes in which the mix takes the
    document, the words taken in each, and where in training (0 to 1). A null source is a source of
    its own, the last; a null text has no words. A document without words gets one copy of 0 words,
    which costs nothing. Repeated rows count as documents of their own. Input columns that are not in
    ``carry`` are not read; a new column takes the place of a carried one of its name. An empty table gives no rows. Texts of any
    length are counted whole; rows of one id stand by size and text. Texts are read once: what is needed of them is
    written as a narrow table. Options are those of ``_placed``.
    """
    names = ["size", "source_size", "target", "copies"]
    new, carry = [F.col(f"_{c}").alias(c) for c in names], without_names(carry, names)
    return _placed(documents, carry, narrow=text_col not in carry, text_col=text_col, **options).select(*[F.col("_d")[c].alias(c) for c in carry], *new)


def _placed(documents: DataFrame, carry: list[str], weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0, slopes: tuple[float, ...] = SLOPES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", narrow: bool = False) -> DataFrame:
    """``_d`` (the carried columns), ``_size, _source_size, _target, _copies``; inner names don't clash with carried ones.

    Rows of one id stand by their size, then by a hash of their text, so that only equal ones may swap places.
    """
    rows = documents.count()
    buckets = max(1, math.ceil(math.sqrt(rows)))
    hashed = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    base = documents.select(
        F.struct(*[F.col(c) for c in carry]).alias("_d"),
        word_count(text_or_empty(text_col)).alias("_size"),
        F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string"))).alias("skey"),
        hashed.alias("_h"),
        F.xxhash64(text_or_empty(text_col)).alias("_x"),
    )
    # bucket numbers rise with the hash: the leading 32 bits, scaled
    base = base.withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)))
    if narrow:
        base = materialise(base, "sizes")
    # where rows carry their text, it is read once for the totals and once for the rows
    totals = materialise(base.groupBy("skey", "_b").agg(F.sum("_size").alias("_n")), "totals")
    sources = totals.groupBy("skey").agg(F.sum("_n").alias("source_size"))
    goal = sources.join(source_targets(sources, weights, cap), "skey").withColumnsRenamed({"source_size": "_source_size", "target": "_target", "rank": "_rank"})
    along = Window.partitionBy("skey").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_s", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n").join(goal, "skey")
    inside = Window.partitionBy("skey", "_b").orderBy("_h", "_size", "_x").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("_i", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(starts, ["skey", "_b"])
    aim, slope = F.round("_target").cast("long"), F.element_at(F.array(*[F.lit(float(a)) for a in slopes]), (F.pmod(F.col("_rank") - 1, F.lit(len(slopes))) + 1).cast("int"))

    def copy(j: Column) -> Column:
        begin = F.col("_s") + F.col("_i") + j.cast("long") * F.col("_source_size")
        words = F.greatest(F.lit(0), F.least(F.col("_size"), aim - begin))
        u = F.when(F.col("_target") > 0, F.least(F.lit(1.0), begin / F.col("_target"))).otherwise(0.0)
        at = F.when(slope == 0, u).otherwise((slope - 1 + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u)) / (2 * slope))
        return F.struct(j.cast("int").alias("copy"), words.cast("long").alias("words"), at.alias("position"))

    passes = F.transform(F.sequence(F.lit(0), F.lit(max(0, math.ceil(cap) - 1))), copy)
    kept = F.filter(passes, lambda c: (c["words"] > 0) | ((F.col("_size") == 0) & (c["copy"] == 0)))
    return placed.select("_d", "_size", "_source_size", "_target", kept.alias("_copies"))


def mix(documents: DataFrame, position_col: str = "position", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: a row for each copy taken, with all columns of ``documents`` and its position, range-sorted by position.

    The copy that reaches its source's target within a document is cut after its last word taken;
    ``n_chars``, where there is such a column, follows the text. The position takes the place of a column of its
    name. An empty table gives no rows.
    """
    columns = without_names(documents.columns, [position_col])
    one = _placed(documents, columns, text_col=text_col, **options).select("_d", "_size", F.explode("_copies").alias("_c"))
    text = F.col("_d")[text_col]
    pieces = F.split(text, _GAP, -1)
    skip = F.when(F.element_at(pieces, 1).rlike(r"^[\x20\x09-\x0D]+$"), 1).otherwise(0)
    cut = F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), F.col("_c.words").cast("int") + skip), ""), r"[\x20\x09-\x0D]+$", "")
    part = F.col("_c.words") < F.col("_size")
    one = one.withColumn("_text", F.when(part, cut).otherwise(text))

    def shown(c: str) -> Column:
        if c == text_col:
            return F.col("_text").alias(c)
        own = F.col("_d")[c]
        if c == "n_chars":
            own = F.when(part, F.length("_text").cast(dict(documents.dtypes)[c])).otherwise(own)
        return own.alias(c)

    ties = [c for c in columns if c != text_col][:1]
    return one.select(*[shown(c) for c in columns], F.col("_c.position").alias(position_col)).orderBy(position_col, *ties)
