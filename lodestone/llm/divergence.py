"""Source divergence audit: how far each source's words stray from the other sources of its language.

Terms are runs of ASCII letters and characters beyond ASCII, lower-cased in A-Z. Each language keeps the
terms that occur in enough of its documents. A group (language and source) gives each kept term a
smoothed probability in whole parts of ``scale``, which depends on nothing but the term's count and the group's
totals. So the divergence of two groups needs no sum over the vocabulary: terms fall into cells by
their two counts, the function is evaluated once a cell and multiplied by the number of its terms.

Only cells in which both counts are positive come from terms. Terms with the same counts in all
sources are one signature, so that the rare words, most of a vocabulary, make few rows. Cells with a zero are implied:
a group's terms of count c, less those that the other group has too. All numbers are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialise, text_or_empty

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000


def term_counts(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of each term, and rows that hold it, in each group. Nulls count as ''."""
    terms = F.regexp_extract_all(F.translate(text_or_empty(text_col), _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    base = documents.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), terms.alias("t"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    # all occurrences count for n; one of each row counts for docs
    both = base.select("lang", "source", F.explode(F.array(F.struct("t", one.alias("n"), none.alias("docs")), F.struct(F.array_distinct("t").alias("t"), none.alias("n"), one.alias("docs")))).alias("x"))
    each = both.select("lang", "source", F.explode("x.t").alias("term"), "x.n", "x.docs")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def part(count: Column, total: Column, terms: Column, scale: int = SCALE) -> Column:
    """1 + floor(scale (count + 1) / (total + terms)), exactly."""
    num = F.lit(scale).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", num, (total + terms).cast("decimal(20,0)"))


def strays(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): both are at most scale + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(documents: DataFrame, min_docs: int = 3, top: int = 200, scale: int = SCALE, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of each group of a language and a source.

    Part ``pair``: each other source of the language, with the divergence summed over the kept terms, all ranks. Part
    ``term``: the kept terms that the group uses more than its language does, the ``top`` first. Ranks go by value
    descending, then by the item's UTF-8 bytes. Null texts, languages and sources count as ''; a group
    without terms takes part with counts of 0; a language without kept terms has pairs of value 0 and no terms.
    Repeated rows are documents of their own. An empty table gives no rows. Other columns aren't read.

    The result has a row for each ordered pair of a language's sources; nothing but that and the signatures, whose
    lists have an entry for each source, grows with the number of sources.
    """
    kept = term_counts(documents, text_col, lang_col, source_col)
    kept = kept.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts")).where(F.col("docs") >= min_docs)
    kept = materialise(kept.select("lang", "term", "in_lang", "counts"), "kept-terms")
    named = documents.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source")).distinct()
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("total_lang"))
    own = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"), F.count("*").alias("used"))
    zero = F.lit(0).cast("long")
    groups = named.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialise(groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "used", "terms", "total_lang")]), "groups")
    out = _pairs(kept, groups, scale).unionByName(_terms(kept, groups, top, scale))
    out = materialise(out, "audit")
    discard(kept, groups)
    return out


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _terms(kept: DataFrame, groups: DataFrame, top: int, scale: int) -> DataFrame:
    each = kept.select("lang", F.col("term").alias("item"), "in_lang", F.explode("counts").alias("c")).select("lang", "item", "in_lang", "c.source", "c.n")
    p = each.join(groups, ["lang", "source"]).withColumn("p", part(F.col("n"), F.col("total"), F.col("terms"), scale)).withColumn("q", part(F.col("in_lang"), F.col("total_lang"), F.col("terms"), scale))
    over = p.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", strays(F.col("p"), F.col("q")).alias("value"))
    return _ranked(over).where(F.col("rank") <= top)


def _pairs(kept: DataFrame, groups: DataFrame, scale: int) -> DataFrame:
    alike = kept.groupBy("lang", "counts").agg(F.count("*").alias("m"))
    ahead = alike.select("lang", "counts", "m", F.posexplode("counts").alias("i", "a"))
    both = ahead.select("lang", "m", "a", F.explode(F.slice("counts", F.col("i") + 2, F.size("counts"))).alias("b"))
    cells = both.groupBy("lang", F.col("a.source").alias("g"), F.col("b.source").alias("h"), F.col("a.n").alias("cg"), F.col("b.n").alias("ch")).agg(F.sum("m").alias("m"))
    zero = F.lit(0).cast("long")
    # a term of both groups isn't one of the cells with a zero
    signed = F.array(*[F.struct(x.alias("cg"), y.alias("ch"), (F.col("m") * s).alias("m")) for x, y, s in ((F.col("cg"), F.col("ch"), 1), (F.col("cg"), zero, -1), (zero, F.col("ch"), -1), (zero, zero, 1))])
    met = cells.select("lang", "g", "h", F.inline(signed))
    a, b = groups.select("lang", F.col("source").alias("g"), F.col("used").alias("ug"), "terms"), groups.select("lang", F.col("source").alias("h"), F.col("used").alias("uh"))
    two = a.join(b, "lang").where("g < h")
    alone = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source", "c.n").agg(F.count("*").alias("m"))
    left = two.join(alone.withColumnRenamed("source", "g"), ["lang", "g"]).select("lang", "g", "h", F.col("n").alias("cg"), zero.alias("ch"), "m")
    right = two.join(alone.withColumnRenamed("source", "h"), ["lang", "h"]).select("lang", "g", "h", zero.alias("cg"), F.col("n").alias("ch"), "m")
    rest = two.select("lang", "g", "h", zero.alias("cg"), zero.alias("ch"), (F.col("terms") - F.col("ug") - F.col("uh")).alias("m"))
    table = met.unionByName(left).unionByName(right).unionByName(rest).groupBy("lang", "g", "h", "cg", "ch").agg(F.sum("m").alias("m")).where("m > 0")
    gs, hs = groups.select("lang", F.col("source").alias("g"), F.col("total").alias("tg"), "terms"), groups.select("lang", F.col("source").alias("h"), F.col("total").alias("th"))
    p = table.join(gs, ["lang", "g"]).join(hs, ["lang", "h"]).withColumn("p", part(F.col("cg"), F.col("tg"), F.col("terms"), scale)).withColumn("q", part(F.col("ch"), F.col("th"), F.col("terms"), scale))
    sums = p.groupBy("lang", "g", "h").agg(F.sum(F.col("m") * strays(F.col("p"), F.col("q"))).alias("gh"), F.sum(F.col("m") * strays(F.col("q"), F.col("p"))).alias("hg"))
    known = two.select("lang", "g", "h").join(sums, ["lang", "g", "h"], "left").na.fill(0, ["gh", "hg"])
    ways = F.array(F.struct(F.col("g").alias("source"), F.col("h").alias("item"), F.col("gh").alias("value")), F.struct(F.col("h").alias("source"), F.col("g").alias("item"), F.col("hg").alias("value")))
    return _ranked(known.select("lang", F.lit("pair").alias("part"), F.inline(ways)).select("lang", "source", "part", "item", "value"))
