"""Inputs of the structure operators, made from the driver's tables; each with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Contents of the file tree by kind of file; a bar stands for a line end. The same expression serves Spark and DuckDB.
_CONTENT = """CASE p_partkey % 8
 WHEN 0 THEN '[package]|name = "p' || CAST(p_partkey AS VARCHAR(20)) || '"|' || CASE p_size % 4 WHEN 0 THEN '[workspace]|members = []|' WHEN 1 THEN '[[bin]]|name = "b"|' WHEN 2 THEN '[lib]|name = "l"|' ELSE '' END || '[dependencies]|serde = "1.' || CAST(p_size % 5 AS VARCHAR(20)) || '"|near = { path = "../near" }|'
 WHEN 1 THEN CASE p_size % 4 WHEN 0 THEN '{"bin":"x","dependencies":{"lodash":"^4.' || CAST(p_size % 3 AS VARCHAR(20)) || '","dep' || CAST(p_size % 7 AS VARCHAR(20)) || '":"1.0"}}'
   WHEN 1 THEN '{"main":"x.js","devDependencies":{"dep' || CAST(p_size % 5 AS VARCHAR(20)) || '":"2.0"}}' WHEN 2 THEN '{"exports":null,"peerDependencies":{"lodash":"3"}}' ELSE '{"name":"x"' END
 WHEN 2 THEN '# ' || p_name || '||## Part ' || CAST(p_partkey AS VARCHAR(20)) || '|```|# not a heading|```|### ' || p_type || ' ##|#bad|'
 WHEN 3 THEN CASE p_size % 3 WHEN 0 THEN '#!/bin/bash|echo' WHEN 1 THEN '#! /usr/bin/env python3 |x' ELSE 'echo' END
 ELSE 'p' || CAST(p_partkey AS VARCHAR(20)) END"""
_NAME = "CASE p_partkey % 8 WHEN 0 THEN 'Cargo.toml' WHEN 1 THEN 'package.json' WHEN 2 THEN 'README.md' WHEN 3 THEN 'run.sh' WHEN 4 THEN '.git' WHEN 5 THEN 'lib.rs' WHEN 6 THEN 'pyproject.toml' ELSE 'CHANGELOG.txt' END"
_PATH = "'ws/' || lower(replace(p_brand, '#', '-')) || '/' || lower(p_type) || '/' || " + _NAME

FILES = f"""files AS (SELECT path, content FROM (
  SELECT {_PATH} AS path, replace({_CONTENT}, '|', chr(10)) AS content, row_number() OVER (PARTITION BY {_PATH} ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    """A file tree: ``ws/<brand>/<type>/<one of eight names>``."""
    rows = table(spark, sf, "part").select("p_partkey", F.expr(_PATH).alias("path"), F.expr(f"replace({_CONTENT}, '|', char(10))").alias("content"))
    return rows.groupBy("path").agg(F.min_by("content", "p_partkey").alias("content"))


PATHS = r"""paths AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') AS path FROM pages)"""


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of web pages as paths."""
    u = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), "/+$", "")
    return table(spark, sf, "pages").select(u.alias("path")).distinct()


TREE = """tree AS (
  SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS parent FROM region
  UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation
  UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR) FROM customer)"""


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, nations, suppliers and customers with their parents."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    out = table(spark, sf, "region").select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    for t, letter, key, up, upkey in (("nation", "n", "n_nationkey", "r", "n_regionkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("customer", "c", "c_custkey", "n", "c_nationkey")):
        out = out.union(table(spark, sf, t).select(name(letter, key), name(up, upkey)))
    return out


TRADE = """trade AS (SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS src, 'c' || CAST(o_custkey AS VARCHAR) AS dst
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """Who supplied whom."""
    j = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return j.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst")).distinct()


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"
_KIND = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'calls' WHEN '2' THEN 'communicates-with' WHEN '3' THEN 'depends-on' WHEN '4' THEN 'co-implements' ELSE 'generates' END"
_LIFE = "CASE l_returnflag WHEN 'A' THEN 'build' WHEN 'N' THEN 'runtime' ELSE 'test' END"
STEPS = f"""steps AS (SELECT * FROM (SELECT l_orderkey, l_linenumber, {_KIND} AS kind, {_LIFE} AS lifecycle,
    lower(replace(p_brand, '#', '-')) AS src, lead(lower(replace(p_brand, '#', '-'))) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS dst
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey) WHERE dst IS NOT NULL AND src <> dst)"""


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """Brand to next brand within an order, with a kind and a lifecycle: a multigraph's proposals, many of them repeated."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("src"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    j = table(spark, sf, "lineitem").join(part, "l_partkey").join(orders, "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", "))
    return j.select("l_orderkey", "l_linenumber", F.expr(_KIND).alias("kind"), F.expr(_LIFE).alias("lifecycle"), "src", F.lead("src").over(w).alias("dst")).where("dst is not null and src <> dst")


STRONG = """strong AS (SELECT src, dst FROM (SELECT src, dst, n, avg(n) OVER () AS m, stddev_pop(n) OVER () AS s FROM (SELECT src, dst, count(*) AS n FROM steps GROUP BY src, dst)) WHERE n > m + 1.3 * s)"""


def strong(spark: SparkSession, sf: str) -> DataFrame:
    """Brand steps that occur clearly more often than the mean of all."""
    n = steps(spark, sf).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.avg("n").alias("m"), F.stddev_pop("n").alias("s")))).where(F.col("n") > F.col("m") + 1.3 * F.col("s")).select("src", "dst")


DOCS = """docs AS (SELECT 'd' || CAST(doc_id AS VARCHAR) || '/README.md' AS path, '# Doc ' || CAST(doc_id AS VARCHAR) || ' #' || chr(10) || '~~~' || chr(10) || '# hidden' || chr(10) || '~~~' || chr(10) || coalesce(text, '') AS content FROM documents)"""


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files, each under a heading and a fenced line that looks like one."""
    i = F.col("doc_id").cast("string")
    return table(spark, sf, "documents").select(F.concat(F.lit("d"), i, F.lit("/README.md")).alias("path"), F.concat(F.lit("# Doc "), i, F.lit(" #\n~~~\n# hidden\n~~~\n"), F.coalesce("text", F.lit(""))).alias("content"))


def dirs_of(paths_: DataFrame) -> DataFrame:
    return paths_.select(P.parent(F.col("path")).alias("dir")).where("dir <> ''").distinct()


SETS = """sets AS (SELECT n_nationkey AS id, o_orderkey % 2 AS half, p_brand AS path FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
halves AS (SELECT 'n' || CAST(id AS VARCHAR) || '-' || CAST(path AS VARCHAR) AS unused, id, half, path, count(*) AS n FROM sets GROUP BY id, half, path),
picked AS (SELECT id, half, path, n FROM (SELECT *, avg(n) OVER (PARTITION BY id, half) AS m FROM halves) WHERE n > m),
kinds AS (SELECT id, half, min(path) AS kind FROM picked GROUP BY id, half)"""


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """For orders of even and of odd number: each nation's more frequent brands as a component's paths, the first as its kind."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    cust = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("id"))
    n = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey").join(orders, "l_orderkey").join(cust, "c_custkey").groupBy("id", (F.col("l_orderkey") % 2).alias("half"), F.col("p_brand").alias("path")).agg(F.count("*").alias("n"))
    kept = n.withColumn("m", F.avg("n").over(Window.partitionBy("id", "half"))).where("n > m")
    out = kept.groupBy("id", "half").agg(F.array_sort(F.collect_set("path")).alias("paths"), F.min("path").alias("kind")).withColumn("ord", F.col("id"))
    return out.where("half = 0").drop("half"), out.where("half = 1").drop("half")


VERSIONS = """base AS (SELECT doc_id AS ord, 'd' || CAST(doc_id AS VARCHAR) AS id, lang AS kind, source AS language, sha256(coalesce(text, '')) AS content_sha FROM documents),
fresh AS (SELECT b.ord, CASE WHEN l.toxic = 1 THEN 'x' || CAST(b.ord AS VARCHAR) ELSE b.id END AS id, CASE WHEN l.quality = 0 THEN 'low' ELSE b.kind END AS kind, b.language, b.content_sha FROM base b LEFT JOIN labels l ON l.doc_id = b.ord)"""


def versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents as components of a first run; in the second, toxic ones are renamed and poor ones change their kind."""
    base = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("kind"), F.col("source").alias("language"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha"))
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("ord"), "quality", "toxic")
    fresh = base.join(lab, "ord", "left").select("ord", F.when(F.col("toxic") == 1, F.concat(F.lit("x"), F.col("ord").cast("string"))).otherwise(F.col("id")).alias("id"), F.when(F.col("quality") == 0, "low").otherwise(F.col("kind")).alias("kind"), "language", "content_sha")
    return base, fresh
