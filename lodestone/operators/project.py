"""Projections: externals, subsystems, known ids, stable timestamps, summaries."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import paths as P
from ..functions.manifests import cargo_dependencies, package_dependencies
from ..functions.text import kind_suggestion
from .settle import settle


def npm_externals(files: DataFrame) -> DataFrame:
    found = files.where(P.basename(F.col("path")) == "package.json").select("path", F.posexplode(package_dependencies(F.col("content"))).alias("seq", "d"))
    return found.select("path", "seq", "d.id", "d.purl", F.lit("javascript").alias("language"))


def cargo_externals(files: DataFrame) -> DataFrame:
    found = files.where(P.basename(F.col("path")) == "Cargo.toml").select("path", F.explode(cargo_dependencies("content")).alias("d"))
    return found.select("path", "d.seq", "d.id", "d.purl", F.lit("rust").alias("language"))


def externals(registrations: DataFrame) -> DataFrame:
    """One row an id: the first registration in manifest order fixes language and purl, even a null one."""
    first = F.min_by(F.struct("language", "purl"), F.struct("path", "seq"))
    out = registrations.groupBy("id").agg(first.alias("f"), F.array_sort(F.collect_set("path")).alias("discovered_from"))
    return out.select("id", F.lit("external").alias("kind"), "f.language", "f.purl", "discovered_from", F.lit("strong").alias("evidence_grade"))


def known_ids(components: DataFrame, externals: DataFrame) -> DataFrame:
    return components.where(~F.col("deleted")).select("id").union(externals.select("id")).distinct()


def compiled_globs(members: DataFrame) -> DataFrame:
    """``(subsystem, ord, member, stem, regex)`` of the patterns among ``members``; ``regex`` is null where a pattern is invalid.

    ``stem``: the directory, or the whole path, that a pattern names before its first wildcard; '' for the root.
    """

    def run(batches):
        for pdf in batches:
            stems, regexes = [], []
            for g in pdf["member"]:
                at = min((k for k in (g.find(c) for c in "*?[{") if k >= 0), default=-1)
                stems.append(g if at < 0 else g[:at].rpartition("/")[0])
                try:
                    regexes.append(P.glob_regex(g))
                except ValueError:
                    regexes.append(None)
            yield pdf.assign(stem=stems, regex=regexes)

    kept = members.where(P.is_glob(F.col("member"))).select("subsystem", F.col("ord").cast("int").alias("ord"), "member")
    return kept.mapInPandas(run, "subsystem string, ord int, member string, stem string, regex string")


def subsystem_evidence(members: DataFrame, components: DataFrame) -> DataFrame:
    """``(subsystem, ord, id, matched_via)`` of ``members(subsystem, ord, member)``, each component by the first member that names it.

    Names are joined by equality. A pattern meets only the path segments that lie at or below its stem, by equality
    with their ancestors; ``*`` crosses slashes.
    """
    live = components.where(~F.col("deleted"))
    plain = members.where(~P.is_glob(F.col("member")))
    by_id = plain.join(live.select(F.col("id").alias("member")), "member", "left_semi").select("subsystem", "ord", F.col("member").alias("id"), F.lit("id").alias("matched_via"))
    lost = plain.join(live.select(F.col("id").alias("member")), "member", "left_anti").select("subsystem", "ord", F.col("member").alias("id"), F.lit("id (no such component)").alias("matched_via"), F.lit(False).alias("ok"))
    globs = settle(compiled_globs(members))
    under = live.select("id", F.explode("paths").alias("path")).select("id", "path", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), P.ancestors(F.col("path"), True)))).alias("stem"))
    found = settle(under.join(globs.where("regex is not null"), "stem").where(F.rlike("path", F.col("regex"))).select("subsystem", "ord", "id", F.col("member").alias("matched_via")).distinct())
    out = by_id.withColumn("ok", F.lit(True)).union(found.withColumn("ok", F.lit(True)))
    none = globs.where("regex is not null").join(found.select("subsystem", "ord").distinct(), ["subsystem", "ord"], "left_anti").select("subsystem", "ord", F.lit("").alias("id"), F.concat("member", F.lit(" (no matches)")).alias("matched_via"), F.lit(False).alias("ok"))
    wrong = globs.where("regex is null").select("subsystem", "ord", F.lit("").alias("id"), F.concat("member", F.lit(" (invalid glob)")).alias("matched_via"), F.lit(False).alias("ok"))
    w = Window.partitionBy("subsystem", "id").orderBy("ord")
    return out.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").union(lost).union(none).union(wrong)


def subsystems(evidence: DataFrame) -> DataFrame:
    """``(subsystem, members, notes)``."""
    members = F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("id"))))
    return evidence.groupBy("subsystem").agg(members.alias("members")).withColumn("notes", F.when(F.size("members") == 0, F.array(F.lit("all members unresolved"))).otherwise(F.array().cast("array<string>")))


def collisions(subsystem_ids: DataFrame, components: DataFrame) -> DataFrame:
    """Ids that name both a subsystem and a live component."""
    return subsystem_ids.select("id").join(components.where(~F.col("deleted")).select("id"), "id", "left_semi").distinct()


def unresolved_members(members: DataFrame, components: DataFrame) -> DataFrame:
    plain = members.where(~P.is_glob(F.col("member")))
    return plain.join(components.where(~F.col("deleted")).select(F.col("id").alias("member")), "member", "left_anti").select("subsystem", "member").distinct()


def validate_pins(pins: DataFrame) -> DataFrame:
    """``(severity, pin_key, field, message, suggestion)`` of pins with unknown fields or kinds."""
    unknown = pins.where(~F.col("field").isin(*vocab.PIN_FIELDS)).select(F.lit("warning").alias("severity"), F.col("key").alias("pin_key"), "field", F.concat(F.lit("no such pin field: "), "field", F.lit("; it has no effect")).alias("message"), F.lit(None).cast("string").alias("suggestion"))
    kinds = pins.where((F.col("field") == "kind") & (F.col("variant") == "value") & ~F.col("value").isin(*vocab.KINDS))
    text = F.concat(F.lit("no such kind: "), "value", F.lit("; the component would count as none"))
    return unknown.union(kinds.select(F.lit("error"), "key", F.lit("kind"), text, kind_suggestion(F.col("value"))))


def validate_additions(additions: DataFrame) -> DataFrame:
    text = F.concat(F.lit("added component "), "id", F.lit(" is of no known kind: "), "kind")
    return additions.where(~F.col("kind").isin(*vocab.KINDS)).select(F.lit("error").alias("severity"), F.col("id").alias("pin_key"), F.lit("kind").alias("field"), text.alias("message"), kind_suggestion(F.col("kind")).alias("suggestion"))


def validate_subsystems(subs: DataFrame) -> DataFrame:
    """Repeated ids and empty member lists of ``subs(ord, id, members)``."""
    none = F.lit(None).cast("string")
    rn = F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    again = subs.withColumn("rn", rn).where("rn > 1").select(F.lit("error").alias("severity"), F.col("id").alias("pin_key"), none.alias("field"), F.concat(F.lit("subsystem "), "id", F.lit(" is listed twice")).alias("message"), none.alias("suggestion"))
    empty = subs.where(F.size("members") == 0).select(F.lit("error"), "id", F.lit("members"), F.concat(F.lit("subsystem "), "id", F.lit(" lists no members")), none)
    return again.union(empty)


def report_lines(issues: DataFrame) -> DataFrame:
    """One line of text for each issue."""
    where = F.concat(F.lit(" in pin "), "pin_key", F.coalesce(F.concat(F.lit(" / "), "field"), F.lit("")))
    hint = F.coalesce(F.concat(F.lit(" (did you mean "), "suggestion", F.lit("?)")), F.lit(""))
    return issues.select(F.concat(F.lit("  "), "severity", F.coalesce(where, F.lit("")), F.lit(": "), "message", hint).alias("line"))


def tally(issues: DataFrame) -> DataFrame:
    """The report's last line, how many errors and warnings there are; no row without any."""
    n = issues.agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w")).where("e + w > 0")
    return n.select(F.concat(F.lit("  ("), F.col("e").cast("string"), F.lit(" error(s), "), F.col("w").cast("string"), F.lit(" warning(s))")).alias("line"))


def digest(df: DataFrame, without: tuple[str, ...] = ("generated_at",)) -> str:
    """Order-free digest of a table's rows, for telling whether anything changed."""
    rows = df.drop(*without)
    one = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(one, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    got = rows.select(*[p.alias(f"p{k}") for k, p in enumerate(parts)]).agg(F.count("*"), *[F.sum(f"p{k}") for k in range(4)]).first()
    return hashlib.sha256(repr(tuple(str(x) for x in got)).encode()).hexdigest()


def stable_timestamp(prior: DataFrame | None, fresh: DataFrame, prior_time: str | None, now: str) -> str:
    """The prior time when all else is equal."""
    return prior_time if prior is not None and prior_time and digest(prior) == digest(fresh) else now


def stable_timestamps(prior: DataFrame, fresh: DataFrame, by: str, prior_time: str, now: str) -> DataFrame:
    """``(by, stamp)``: the prior time for each group of rows, by one column, that is the same in both tables."""

    def sums(df: DataFrame) -> DataFrame:
        one = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        parts = [F.conv(F.substring(one, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
        rows = df.select(by, *[p.alias(f"p{k}") for k, p in enumerate(parts)])
        return rows.groupBy(by).agg(F.struct(F.count("*").alias("n"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(4)]).alias("d"))

    a, b = sums(prior).select(F.col(by).alias("_a"), F.col("d").alias("da")), sums(fresh).select(F.col(by).alias("_b"), F.col("d").alias("db"))
    both = a.join(b, F.col("_a").eqNullSafe(F.col("_b")), "full_outer")
    return both.select(F.coalesce("_a", "_b").alias(by), F.when(F.col("da").eqNullSafe(F.col("db")), prior_time).otherwise(now).alias("stamp"))


def summary_line(s: Column | str = "s") -> Column:
    """One line about a run from a struct of counters."""
    c = lambda k: F.col(f"{s}.{k}").cast("string")
    budget = F.coalesce(F.concat(c("tokens_used"), F.lit("/"), c("token_budget")), F.concat(c("tokens_used"), F.lit(" (no budget)")))
    parts = [F.lit("index:")] + [F.concat(F.lit(f"{name}="), v) for name, v in (("components", c("components")), ("externals", c("externals")), ("edges", c("edges")), ("llm_calls", c("calls")), ("llm_errors", c("errors")), ("tokens", budget), ("iterations", c("iterations")), ("written", c("written")))]
    return F.concat_ws(" ", *parts)
