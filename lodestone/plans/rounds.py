"""Queries over loops, calls and blocks: carving round by round, calls a key, components of edges with kinds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import paths as P
from ..operators import classify as K
from ..operators import graph as G
from ..operators import propose as Q
from ..operators.settle import forget_folder, settle, shared_folder
from ..respond import cache as C
from ..respond.core import Budget, Fingerprint
from ..respond.leases import Journal
from . import bindings as B
from .carve import Carving
from .registry import query


class _Noting:
    """Answers with the inputs' source, and leaves a note of each call in a folder that all machines reach."""

    def __init__(self, folder: str):
        self.folder = folder

    def call(self, prompt: str, inputs: dict) -> object:
        own = uuid.uuid4().hex
        Journal(self.folder).put(own, {"prompt": prompt, "source": inputs["a"]})
        return {"source": inputs["a"]}

    def fingerprint(self) -> Fingerprint:
        return Fingerprint("t", "o", "noting", "1")


@query("""WITH d AS (SELECT lang, coalesce(source, '') AS source FROM documents), req AS (SELECT DISTINCT lang AS prompt, source FROM d)
SELECT prompt, source, CAST(1 AS BIGINT) AS calls, CAST((length(source) + 8 + length(source) + 13) // 4 AS BIGINT) AS tokens FROM req""")
def calls_a_key(spark: SparkSession, sf: str) -> DataFrame:
    """How often each language and source was asked about when all documents' requests were answered in executors, recorded and read again; the answer's tokens."""
    folder = f"{shared_folder(spark)}/lodestone/notes-{uuid.uuid4().hex}"
    responder, budget = _Noting(folder), Budget(10**9)
    d = B.table(spark, sf, "documents").select(F.col("lang").alias("prompt"), F.concat(F.lit('{"a":"'), F.coalesce("source", F.lit("")), F.lit('"}')).alias("inputs"))
    asked = C.keyed(d, responder)
    store = C.ResponseCache(spark.createDataFrame([], C.SCHEMA))
    store.record(C.answer_within(store.missing(asked), responder, budget))
    # what the cache holds isn't asked for again
    store.record(C.answer_within(store.missing(asked), responder, budget))
    known = store.snapshot().select("prompt", F.get_json_object("response", "$.source").alias("source"), F.floor((F.octet_length("inputs") + F.octet_length("response")) / 4).cast("long").alias("tokens"))
    notes = spark.read.schema("prompt string, source string").option("recursiveFileLookup", "true").json(folder).groupBy("prompt", "source").agg(F.count("*").alias("calls"))
    out = settle(known.join(notes, ["prompt", "source"], "left").select("prompt", "source", F.coalesce("calls", F.lit(0).cast("long")).alias("calls"), "tokens"))
    forget_folder(folder)
    if budget.used != out.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]:
        raise RuntimeError("the budget doesn't hold what was paid")
    return out


_SYMMETRIC = ", ".join(f"'{k}'" for k in vocab.SYMMETRIC_KINDS)


@query(f"""WITH RECURSIVE {B.STEPS}, n AS (SELECT src, dst, kind, count(*) AS n FROM steps GROUP BY src, dst, kind),
big AS (SELECT DISTINCT src, dst FROM (SELECT *, avg(n) OVER () AS m, stddev_pop(n) OVER () AS s FROM n) WHERE n > m + 1.6 * s AND kind NOT IN ({_SYMMETRIC})),
reach(a, b) AS (SELECT src, dst FROM big UNION SELECT r.a, s.dst FROM reach r JOIN big s ON r.b = s.src),
pairs AS (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a)
SELECT min(b) AS component, a AS node FROM pairs GROUP BY a HAVING count(*) > 1""")
def sccs_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Strong components of brand steps that are frequent for their kind; symmetric kinds have no direction. No single task walks the graph."""
    n = B.steps(spark, sf).groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))
    top = n.agg((F.avg("n") + 1.6 * F.stddev_pop("n")).alias("top")).first()["top"]
    return G.strong_components(n.where(F.col("n") > F.lit(top)), small=0)


@query(f"""WITH {B.FILES}, t AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS d FROM files), b AS (SELECT DISTINCT split_part(d, '/', 1) || '/' || split_part(d, '/', 2) AS d FROM t),
c AS (SELECT (SELECT count(*) FROM b) AS brands, (SELECT count(*) FROM t) AS types)
SELECT 1 AS round, CAST(1 + brands AS BIGINT) AS classified, CAST(1 AS BIGINT) AS digested, CAST(1 AS BIGINT) AS placed FROM c UNION ALL SELECT 2, types, brands, brands FROM c UNION ALL SELECT 3, 0, types, types FROM c""")
def carve_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Directories classified, digested and placed in each round of carving the file tree down from its root, when all of them are libraries."""
    from ..operators import recurse as R

    f = B.files(spark, sf).select(F.concat(P.parent(F.col("path")), F.lit("/x.txt")).alias("path"), F.lit("").alias("content")).distinct()
    library = K.answer("rust-library", None, None, [], [], "by hand")
    judge = lambda _, dirs: dirs.select("dir", F.lit("rule").alias("source"), library.alias("answer"))

    def build(classified: DataFrame, shas: DataFrame, nearest: DataFrame) -> DataFrame:
        rows = classified.select("dir", "answer.kind").join(shas, "dir").join(nearest, "dir", "left")
        return settle(rows.select(F.col("dir").alias("id"), F.col("parent_dir").alias("parent"), "kind", F.array(F.struct(F.col("dir").alias("path"), "content_sha")).alias("path_segments"), F.lit(False).alias("deleted")))

    none = spark.createDataFrame([], "key string, field string, variant string, value string, children array<string>")
    loop = Carving(settle(f), spark.createDataFrame([("ws",)], "dir string"), judge, build, none, None, 8)
    R.fixedpoint(loop.step, spark.createDataFrame([], "id string, sub_dir string"))
    rows = [(k + 1, r["classified"], r["digested"], r["placed"]) for k, r in enumerate(loop.rows)]
    return spark.createDataFrame(rows, "round int, classified long, digested long, placed long")


_TOKENS = "i AS (SELECT CAST(p_partkey AS VARCHAR) AS id, unnest([p_brand || ' ' || CAST(p_size AS VARCHAR), p_brand || ' ' || p_name, p_type]) AS token FROM part)"


def _index(spark: SparkSession, sf: str) -> DataFrame:
    brand = F.concat(F.col("p_brand"), F.lit(" "))
    return B.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.explode(F.array(F.concat(brand, F.col("p_size").cast("string")), F.concat(brand, F.col("p_name")), F.col("p_type"))).alias("token"))


@query(f"""WITH {_TOKENS}, n AS (SELECT token FROM i GROUP BY token HAVING count(*) BETWEEN 2 AND 12)
SELECT DISTINCT string_agg(id, ',' ORDER BY id) AS members FROM i JOIN n ON i.token = n.token GROUP BY i.token""")
def edge_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Parts worth asking about together: those that share a brand and size, a brand and name, or a type with eleven others at most."""
    return Q.blocks(_index(spark, sf), 12).select(F.array_join("members", ",").alias("members"))


@query(f"""WITH {_TOKENS}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM i GROUP BY token),
s AS (SELECT coalesce(sum(CASE WHEN n <= 12 THEN n * (n - 1) / 2 END), 0) AS met, coalesce(sum(n * (n - 1) / 2), 0) AS every FROM n)
SELECT met, every AS "all", CASE WHEN every > 0 THEN met / every ELSE 1 END AS recall FROM s""")
def block_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Which share of all pairs of parts that share a token meets in a block."""
    return Q.coverage(_index(spark, sf), 12)


@query("""WITH pins AS (SELECT DISTINCT p_brand AS key, p_size % 3 AS f, p_size % 2 AS v FROM part)
SELECT '  (' || CAST(count(*) FILTER (f = 0 AND v = 0) AS VARCHAR) || ' error(s), ' || CAST(count(*) FILTER (f = 1) AS VARCHAR) || ' warning(s))' AS line FROM pins HAVING count(*) FILTER (f = 1 OR f = 0 AND v = 0) > 0""")
def validation_tally(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the brands' pins are wrong, and how many have no effect."""
    from ..operators import project as J

    field = F.expr("CASE p_size % 3 WHEN 0 THEN 'kind' WHEN 1 THEN 'hue' ELSE 'role' END")
    value = F.expr("CASE p_size % 2 WHEN 0 THEN 'rust-binary' ELSE 'service' END")
    p = B.table(spark, sf, "part").select(F.col("p_brand").alias("key"), field.alias("field"), F.lit("value").alias("variant"), value.alias("value")).distinct()
    return J.tally(J.validate_pins(p))
