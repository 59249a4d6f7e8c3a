"""Queries over the component tree, edges and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import paths as P
from ..operators import edges as D
from ..operators import graph as G
from ..operators import project as J
from ..operators import recurse as R
from ..operators import tree as T
from . import bindings as B
from .registry import query

_UP = "up AS (SELECT t.id, t.parent AS a1, p.parent AS a2 FROM tree t LEFT JOIN tree p ON p.id = t.parent)"
_CLOSURE = f"{_UP}, above AS (SELECT id, a1 AS ancestor, CAST(1 AS INTEGER) AS distance FROM up WHERE a1 IS NOT NULL UNION ALL SELECT id, a2, 2 FROM up WHERE a2 IS NOT NULL)"


@query(f"""WITH {B.TREE}, {_CLOSURE}, {B.TRADE},
held AS (SELECT id AS node, id FROM tree UNION ALL SELECT id, ancestor FROM above),
inn AS (SELECT a.id, count(*) AS internal FROM trade t JOIN held a ON a.node = t.src JOIN held b ON b.node = t.dst AND b.id = a.id GROUP BY a.id),
ends AS (SELECT a.id, count(*) AS n FROM (SELECT src AS node FROM trade UNION ALL SELECT dst FROM trade) e JOIN held a ON a.node = e.node GROUP BY a.id),
c AS (SELECT t.id, CAST(coalesce(internal, 0) AS BIGINT) AS internal, CAST(coalesce(n, 0) - 2 * coalesce(internal, 0) AS BIGINT) AS crossing FROM tree t LEFT JOIN inn ON inn.id = t.id LEFT JOIN ends ON ends.id = t.id)
SELECT id, internal, crossing, CASE WHEN internal = 0 THEN CAST(0 AS DOUBLE) WHEN crossing = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(internal AS DOUBLE) / crossing END AS density FROM c""")
def seam_density(spark: SparkSession, sf: str) -> DataFrame:
    t = B.tree(spark, sf)
    return G.seam_density(t, T.closure(t), B.trade(spark, sf))


@query(f"WITH {B.TREE}, {_CLOSURE} SELECT t.id, CAST(coalesce(max(distance), 0) AS INTEGER) AS depth FROM tree t LEFT JOIN above a ON a.id = t.id GROUP BY t.id")
def component_depth(spark: SparkSession, sf: str) -> DataFrame:
    return T.depths(B.tree(spark, sf))


@query(f"WITH {B.TREE}, {_CLOSURE} SELECT ancestor, id, distance FROM above")
def descendants(spark: SparkSession, sf: str) -> DataFrame:
    return T.closure(B.tree(spark, sf)).select("ancestor", "id", "distance")


_LOOPED = "looped AS (SELECT id, CASE WHEN id = 'r0' THEN 'n0' WHEN id = 'n0' THEN 'r0' ELSE parent END AS parent FROM tree)"


@query(f"""WITH RECURSIVE {B.TREE}, {_LOOPED},
reach AS (SELECT id FROM looped WHERE parent IS NULL UNION ALL SELECT l.id FROM looped l JOIN reach r ON l.parent = r.id)
SELECT id FROM looped WHERE id NOT IN (SELECT id FROM reach)""")
def acyclicity(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes whose parents never end, when a region and a nation are made each other's parent."""
    t = B.tree(spark, sf)
    parent = F.when(F.col("id") == "r0", "n0").when(F.col("id") == "n0", "r0").otherwise(F.col("parent"))
    return T.on_cycles(t.select("id", parent.alias("parent")))


@query(f"WITH {B.TREE} SELECT id, parent FROM tree WHERE id NOT IN ('n0', 'n5', 's1')")
def suppress_children(spark: SparkSession, sf: str) -> DataFrame:
    pins = spark.createDataFrame([("r0", ["n0", "n5", "zz"]), ("n2", ["s1"]), ("ghost", ["n1"])], "key string, children array<string>")
    return T.suppress_children(B.tree(spark, sf), pins).select("id", "parent")


_PDIRS = "pdirs AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS dir FROM paths WHERE contains(path, '/'))"
_ALLD = f"{_PDIRS}, hosts AS (SELECT DISTINCT split_part(dir, '/', 1) AS dir FROM pdirs), conf AS (SELECT dir FROM hosts WHERE starts_with(dir, 'm.') OR starts_with(dir, 'blog.') UNION SELECT dir FROM pdirs WHERE dir LIKE '%/en'), nodes AS (SELECT path AS dir FROM paths UNION SELECT dir FROM pdirs UNION SELECT dir FROM hosts)"


@query(f"""WITH {B.PATHS}, {_ALLD}, hit AS (SELECT n.dir, c.dir AS parent_dir, row_number() OVER (PARTITION BY n.dir ORDER BY length(c.dir) DESC) AS rn FROM nodes n JOIN conf c ON starts_with(n.dir, c.dir || '/'))
SELECT n.dir, h.parent_dir FROM nodes n LEFT JOIN hit h ON h.dir = n.dir AND h.rn = 1""")
def nearest_ancestor(spark: SparkSession, sf: str) -> DataFrame:
    nodes, conf = _nodes(spark, sf)
    return T.nearest_ancestor(nodes, conf)


def _nodes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = B.paths(spark, sf)
    d = B.dirs_of(p)
    hosts = d.select(F.substring_index("dir", "/", 1).alias("dir")).distinct()
    conf = hosts.where(F.startswith("dir", F.lit("m.")) | F.startswith("dir", F.lit("blog."))).union(d.where(F.endswith("dir", F.lit("/en")))).distinct()
    return p.select(F.col("path").alias("dir")).union(d).union(hosts).distinct(), conf


_VARIANT = "'ws/' || p_brand || '/' || CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '-') ELSE replace(p_name, ' ', '_') END"


@query(rf"""WITH d AS (SELECT DISTINCT {_VARIANT} AS dir, 'ws/' || p_brand AS up FROM part),
top AS (SELECT DISTINCT up AS dir, 'brand-' || regexp_extract(up, '[0-9]+$') AS id FROM d),
low AS (SELECT d.dir, top.id AS parent_id, top.id || '/' || regexp_replace(regexp_extract(d.dir, '[^/]*$'), '[ _]', '-', 'g') AS stem FROM d JOIN top ON top.dir = d.up),
num AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY dir) AS rn FROM low)
SELECT dir, id, CAST(NULL AS VARCHAR) AS parent_id FROM top UNION ALL SELECT dir, CASE WHEN rn = 1 THEN stem ELSE stem || '-' || CAST(rn AS VARCHAR) END, parent_id FROM num""")
def id_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    d = B.table(spark, sf, "part").select(F.expr(_VARIANT).alias("dir"), F.concat(F.lit("ws/"), "p_brand").alias("parent_dir")).distinct()
    top = d.select(F.col("parent_dir").alias("dir"), F.lit(None).cast("string").alias("parent_dir")).distinct()
    nodes = top.union(d.select("dir", "parent_dir")).select("dir", "parent_dir", P.depth(F.col("dir")).alias("depth"), P.leaf_slug(F.col("dir")).alias("slug"))
    return T.allocate_ids(nodes)


_SHA = "h AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents)"


@query(f"""WITH {_SHA}, a AS (SELECT sha, doc_id, row_number() OVER (PARTITION BY sha ORDER BY doc_id) AS rn FROM h WHERE doc_id % 2 = 0),
b AS (SELECT sha, doc_id, row_number() OVER (PARTITION BY sha ORDER BY doc_id) AS rn FROM h WHERE doc_id % 2 = 1)
SELECT coalesce(a.sha, b.sha) AS content_sha, b.doc_id AS live_key, a.doc_id AS prior_id, CASE WHEN a.doc_id IS NULL THEN 'fresh' WHEN b.doc_id IS NULL THEN 'orphan' ELSE 'matched' END AS state FROM a FULL OUTER JOIN b ON a.sha = b.sha AND a.rn = b.rn""")
def rename_match(spark: SparkSession, sf: str) -> DataFrame:
    h = B.table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha"))
    return T.match_renames(h.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "id"), h.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "key"))


@query("""SELECT d.doc_id AS id, d.source, true AS deleted FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang <> 'fr' AND l.doc_id IS NULL""")
def tombstones(spark: SparkSession, sf: str) -> DataFrame:
    prior = B.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", (F.col("lang") == "fr").alias("deleted"))
    return T.tombstones(prior, B.table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return B.steps(spark, sf).withColumn("participants", F.array("src", "dst")).drop("src", "dst")


_CANON = f"""{B.STEPS}, canon AS (SELECT l_orderkey, l_linenumber, kind, lifecycle, CASE WHEN kind IN ('communicates-with', 'co-implements') AND src > dst THEN dst || ',' || src ELSE src || ',' || dst END AS pair FROM steps)"""


@query(f"WITH {_CANON} SELECT kind || '|' || lifecycle || '|' || pair AS key, count(*) AS n FROM canon GROUP BY 1")
def edge_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return D.valid(D.canonical(_edges(spark, sf))).groupBy(D.edge_key().alias("key")).agg(F.count("*").alias("n"))


@query(f"WITH {_CANON} SELECT kind, lifecycle, pair, min(l_orderkey) AS first_order FROM canon GROUP BY kind, lifecycle, pair")
def edge_dedup(spark: SparkSession, sf: str) -> DataFrame:
    e = D.dedup(D.canonical(_edges(spark, sf)), "l_orderkey")
    return e.select("kind", "lifecycle", F.array_join("participants", ",").alias("pair"), F.col("l_orderkey").alias("first_order"))


@query(f"WITH {B.STEPS} SELECT DISTINCT kind, lifecycle, src, dst FROM steps WHERE src = 'brand-7' OR dst = 'brand-7'")
def edges_for_id(spark: SparkSession, sf: str) -> DataFrame:
    return D.touching(_edges(spark, sf), "brand-7").select("kind", "lifecycle", F.col("participants")[0].alias("src"), F.col("participants")[1].alias("dst")).distinct()


@query(f"WITH {B.STEPS} SELECT src, dst, count(*) AS n FROM steps WHERE kind = 'depends-on' AND lifecycle = 'build' GROUP BY src, dst")
def edge_filter(spark: SparkSession, sf: str) -> DataFrame:
    return D.select_edges(B.steps(spark, sf), "depends-on", "build").groupBy("src", "dst").agg(F.count("*").alias("n"))


_ANSWER = """CASE CAST(event_id % 6 AS INT)
 WHEN 0 THEN '[{"kind":"calls","lifecycle":"runtime","participants":["u' || CAST(user_id AS VARCHAR(20)) || '","' || event_type || '"],"evidence_grade":"strong"}]'
 WHEN 1 THEN '{"edges":[{"kind":"depends-on","lifecycle":"build","participants":["' || event_type || '","u' || CAST(user_id AS VARCHAR(20)) || '"],"evidence_grade":"odd"},{"kind":"depends-on"}]}'
 WHEN 2 THEN '[{"kind":"unheard-of","lifecycle":"build","participants":["a","b"]},{"kind":"tests","lifecycle":"test","participants":["a"]}]'
 WHEN 3 THEN '[{"kind":"tests","lifecycle":"test","participants":["u' || CAST(user_id AS VARCHAR(20)) || '","b"],"rationale":"why"}]'
 WHEN 4 THEN 'no json' ELSE '[]' END"""


@query("""SELECT event_id, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'calls' WHEN 1 THEN 'depends-on' ELSE 'tests' END AS kind,
 CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'u' || CAST(user_id AS VARCHAR) || ',' || event_type WHEN 1 THEN event_type || ',u' || CAST(user_id AS VARCHAR) ELSE 'u' || CAST(user_id AS VARCHAR) || ',b' END AS pair,
 CASE WHEN event_id % 6 = 0 THEN 'strong' ELSE 'medium' END AS grade, CASE WHEN event_id % 6 = 3 THEN 'why' ELSE 'no reason given' END AS rationale FROM events WHERE event_id % 6 IN (0, 1, 3)""")
def parse_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events").select("event_id", F.explode(D.parse_edges(F.expr(_ANSWER))).alias("e"))
    return e.select("event_id", "e.kind", F.array_join("e.participants", ",").alias("pair"), F.col("e.evidence_grade").alias("grade"), "e.rationale")


_SURFACE = """CASE CAST(event_id % 4 AS INT)
 WHEN 0 THEN '{"purpose":"' || event_type || '","consumes_files":["a","b"],"interaction_role_hints":["client"]}'
 WHEN 1 THEN '{"surface":{"purpose":"p' || CAST(user_id AS VARCHAR(20)) || '","notes":"n"}}'
 WHEN 2 THEN '{"purpose":"x","interaction_role_hints":["wizard"]}' ELSE 'text' END"""


@query("""SELECT event_id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN event_type ELSE 'p' || CAST(user_id AS VARCHAR) END AS purpose, CASE WHEN event_id % 4 = 0 THEN 'a,b' ELSE '' END AS consumes, CASE WHEN event_id % 4 = 0 THEN 'client' ELSE '' END AS hints, CASE WHEN event_id % 4 = 1 THEN 'n' ELSE '' END AS notes FROM events WHERE event_id % 4 IN (0, 1)""")
def parse_surface(spark: SparkSession, sf: str) -> DataFrame:
    s = B.table(spark, sf, "events").select("event_id", D.parse_surface(F.expr(_SURFACE)).alias("s")).where("s is not null")
    return s.select("event_id", "s.purpose", F.array_join("s.consumes_files", ",").alias("consumes"), F.array_join("s.interaction_role_hints", ",").alias("hints"), "s.notes")


@query(f"""WITH {B.STEPS}, {B.STRONG}, nodes AS (SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS node FROM part)
SELECT node, CAST((SELECT count(*) FROM strong WHERE src = node) AS BIGINT) AS out_degree, CAST((SELECT count(*) FROM strong WHERE dst = node) AS BIGINT) AS in_degree FROM nodes""")
def edge_graph(spark: SparkSession, sf: str) -> DataFrame:
    nodes = B.table(spark, sf, "part").select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("node"))
    return G.edge_graph(nodes, B.strong(spark, sf))


@query(f"""WITH RECURSIVE {B.STEPS}, {B.STRONG},
reach(a, b) AS (SELECT src, dst FROM strong UNION SELECT r.a, s.dst FROM reach r JOIN strong s ON r.b = s.src),
pairs AS (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a)
SELECT min(b) AS component, a AS node FROM pairs GROUP BY a HAVING count(*) > 1""")
def sccs(spark: SparkSession, sf: str) -> DataFrame:
    return G.strong_components(B.strong(spark, sf))


@query(f"""WITH RECURSIVE {B.STEPS}, {B.STRONG}, und AS (SELECT src AS a, dst AS b FROM strong UNION SELECT dst, src FROM strong),
grow(members, last, n) AS (SELECT a || ',' || b, b, 2 FROM und WHERE a < b UNION ALL
  SELECT g.members || ',' || u.b, u.b, g.n + 1 FROM grow g JOIN und u ON u.a = g.last AND u.b > g.last WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(string_split(g.members, ',')) AS m) q WHERE NOT EXISTS (SELECT 1 FROM und v WHERE v.a = q.m AND v.b = u.b)))
SELECT members FROM grow g WHERE n >= 3 AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT a FROM und) c WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(string_split(g.members, ',')) AS m) q WHERE NOT EXISTS (SELECT 1 FROM und v WHERE v.a = q.m AND v.b = c.a)))""")
def cliques(spark: SparkSession, sf: str) -> DataFrame:
    return G.maximal_cliques(B.strong(spark, sf)).select(F.array_join("members", ",").alias("members"))


_NTRADE = """nt AS (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
nbig AS (SELECT src, dst FROM (SELECT *, avg(n) OVER () AS m FROM nt) WHERE n > m * 1.5 AND src <> dst)"""


def _nation_trade(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: B.table(spark, sf, n)
    j = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("src")), "l_suppkey").join(t("customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("dst")), "c_custkey")
    n = j.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.avg("n").alias("m")))).where("n > m * 1.5 and src <> dst").select("src", "dst")


@query(f"""WITH {_NTRADE}, mem AS (SELECT CAST(n_regionkey AS BIGINT) AS grp, CAST(n_nationkey AS BIGINT) AS node, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation),
e AS (SELECT a.grp, a.n, a.i AS ai, b.i AS bi FROM nbig JOIN mem a ON a.node = src JOIN mem b ON b.node = dst AND b.grp = a.grp WHERE a.n BETWEEN 4 AND 12),
masks AS (SELECT unnest(generate_series(1, 4095, 2)) AS mask),
cuts AS (SELECT grp, mask, count(*) AS total_edges, sum(CASE WHEN ((mask >> ai) & 1) <> ((mask >> bi) & 1) THEN 1 ELSE 0 END) AS cross_edges FROM e JOIN masks ON mask < (1 << n) - 1 AND bit_count(mask) >= 2 AND n - bit_count(mask) >= 2 GROUP BY grp, mask),
best AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY cross_edges, mask) AS rn FROM cuts)
SELECT b.grp, CAST(mask AS BIGINT) AS mask, CAST(cross_edges AS BIGINT) AS cross_edges, CAST(total_edges AS BIGINT) AS total_edges, string_agg(CASE WHEN ((mask >> i) & 1) = 1 THEN CAST(node AS VARCHAR) END, ',' ORDER BY node) AS side_a, string_agg(CASE WHEN ((mask >> i) & 1) = 0 THEN CAST(node AS VARCHAR) END, ',' ORDER BY node) AS side_b
FROM best b JOIN mem m ON m.grp = b.grp WHERE rn = 1 AND cross_edges * 5 <= total_edges GROUP BY b.grp, mask, cross_edges, total_edges""")
def modularity_hint(spark: SparkSession, sf: str) -> DataFrame:
    members = B.table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("grp"), F.col("n_nationkey").cast("long").alias("node"))
    b = G.best_bisection(members, _nation_trade(spark, sf))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return b.select("grp", "mask", F.col("cross_edges").cast("long").alias("cross_edges"), F.col("total_edges").cast("long").alias("total_edges"), text("side_a"), text("side_b"))


_KINDS = ", ".join(f"('{k}')" for k in vocab.KINDS)
_LIBS = ", ".join(f"'{k}'" for k in vocab.LIBRARY_KINDS)


@query(f"SELECT k AS kind, CASE WHEN k = 'workspace' THEN 'recurse' WHEN k IN ({_LIBS}) THEN NULL ELSE 'stop' END AS verdict FROM (VALUES {_KINDS}) t(k)")
def policy_kind_only(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in vocab.KINDS], "kind string").withColumn("verdict", R.policy_by_kind(F.col("kind")))


@query(f"""SELECT k AS kind, d AS depth, m AS max_depth, h AS hint, CASE WHEN d >= m THEN 'stop' WHEN k = 'workspace' THEN 'recurse' WHEN k NOT IN ({_LIBS}) THEN 'stop'
 WHEN d >= (CASE WHEN h THEN m ELSE least(3, m) END) THEN 'stop' WHEN h THEN 'recurse' ELSE 'ask' END AS verdict
FROM (VALUES {_KINDS}) t(k), (VALUES (0), (1), (2), (3), (4), (5)) u(d), (VALUES (0), (2), (8)) v(m), (VALUES (true), (false)) w(h)""")
def policy_full(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(k, d, m, h) for k in vocab.KINDS for d in range(6) for m in (0, 2, 8) for h in (True, False)]
    t = spark.createDataFrame(rows, "kind string, depth int, max_depth int, hint boolean")
    return t.withColumn("verdict", R.policy(F.col("kind"), F.col("depth"), F.col("max_depth"), F.col("hint")))


_SUB = f"{_PDIRS}, owned AS (SELECT DISTINCT split_part(path, '/', 1) AS dir FROM paths)"
_SUBS = f"{_SUB}, sub AS (SELECT DISTINCT o.dir AS id, o.dir || '/' || split_part(substr(p.dir, length(o.dir) + 2), '/', 1) AS sub_dir FROM pdirs p JOIN owned o ON starts_with(p.dir, o.dir || '/'))"


def _subdirs(spark: SparkSession, sf: str) -> DataFrame:
    p = B.paths(spark, sf)
    owned = p.select(F.substring_index("path", "/", 1).alias("dir")).distinct().select(F.col("dir").alias("id"), "dir")
    return R.immediate_subdirs(p.withColumn("content", F.lit("")), owned)


@query(f"WITH {B.PATHS}, {_SUBS} SELECT id, sub_dir FROM sub")
def immediate_subdirs(spark: SparkSession, sf: str) -> DataFrame:
    return _subdirs(spark, sf)


@query(f"""WITH {B.PATHS}, {_SUBS}, v AS (SELECT id, sub_dir, sub_dir LIKE '%/en' OR sub_dir LIKE '%/fr' AS yes FROM sub WHERE NOT (id LIKE 'm.%' AND sub_dir LIKE '%/de')),
g AS (SELECT id, sum(CASE WHEN yes THEN 1 ELSE 0 END) AS a, sum(CASE WHEN yes THEN 0 ELSE 1 END) AS r, string_agg(CASE WHEN yes THEN sub_dir END, ',' ORDER BY sub_dir) AS kept, string_agg(CASE WHEN yes THEN sub_dir END, ', ' ORDER BY sub_dir) AS kept2 FROM v GROUP BY id)
SELECT id, a > 0 AS carve, CAST(a AS BIGINT) AS accepted, CAST(r AS BIGINT) AS rejected, coalesce(kept, '') AS kept, 'of ' || CAST(a + r AS VARCHAR) || ' directories below, ' || CAST(a AS VARCHAR) || ' are components and ' || CAST(r AS VARCHAR) || ' are not' || CASE WHEN a > 0 THEN '; carved out ' || kept2 ELSE '' END AS rationale FROM g""")
def subcarve_reduce(spark: SparkSession, sf: str) -> DataFrame:
    subs = _subdirs(spark, sf)
    off = subs.select("id").distinct().where(F.startswith("id", F.lit("m."))).withColumn("name", F.lit("DE"))
    subs = R.without_suppressed(subs, off)
    name = P.basename(F.col("sub_dir"))
    verdicts = subs.select(F.col("sub_dir").alias("dir"), F.lit("service").alias("kind"), name.isin("en", "fr").alias("is_boundary")).distinct()
    return R.subcarve(subs, verdicts).withColumn("kept", F.array_join("kept", ","))


@query(f"""WITH {B.PATHS}, {_SUB}, one AS (SELECT DISTINCT split_part(dir, '/', 1) AS id, dir AS d FROM pdirs)
SELECT id, d AS sub_dir FROM one WHERE contains(d, '/') UNION SELECT id, id || '/' || split_part(d, '/', 2) FROM one WHERE contains(d, '/')""")
def fixedpoint_backedge(spark: SparkSession, sf: str) -> DataFrame:
    """Every host's directories, found level by level: each round carves what the last one added."""
    p = B.paths(spark, sf).withColumn("content", F.lit(""))
    hosts = p.select(F.substring_index("path", "/", 1).alias("id")).distinct()

    def step(known: DataFrame) -> DataFrame:
        owned = hosts.select("id", F.col("id").alias("dir")).union(known.select("id", F.col("sub_dir").alias("dir"))).distinct()
        return R.immediate_subdirs(p, owned)

    start = spark.createDataFrame([], "id string, sub_dir string")
    return R.fixedpoint(step, start)[0]


@query(f"""WITH {B.TREE}, {B.FILES}, ids AS (SELECT DISTINCT 'npm:lodash' AS id FROM files WHERE regexp_extract(path, '[^/]*$') = 'package.json' AND json_valid(content) AND contains(content, '"lodash"')
 UNION SELECT DISTINCT 'npm:' || regexp_extract(content, '"(dep[0-9])":"', 1) FROM files WHERE regexp_extract(path, '[^/]*$') = 'package.json' AND json_valid(content) AND regexp_matches(content, '"dep[0-9]"'))
SELECT id FROM tree WHERE NOT starts_with(id, 's') UNION SELECT id FROM ids""")
def known_ids(spark: SparkSession, sf: str) -> DataFrame:
    comps = B.tree(spark, sf).select("id", F.startswith("id", F.lit("s")).alias("deleted"))
    return J.known_ids(comps, J.externals(J.npm_externals(B.files(spark, sf))))


_SUBSYSTEMS = [("mobile", ["m.*", "*/en", "nowhere/*"]), ("blogs", ["blog.*/fr", "lost-id", "blog.*"]), ("none", ["[x", "gone/*"])]


def _members(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, i, m) for s, ms in _SUBSYSTEMS for i, m in enumerate(ms)], "subsystem string, ord int, member string")


def _components(spark: SparkSession, sf: str) -> DataFrame:
    d = B.dirs_of(B.paths(spark, sf))
    return d.select(P.slug(F.col("dir")).alias("id"), F.array("dir").alias("paths"), F.endswith("dir", F.lit("/de")).alias("deleted"))


_COMPS = f"{_PDIRS}, comps AS (SELECT trim(regexp_replace(lower(dir), '[^a-z0-9]+', '-', 'g'), '-') AS id, dir FROM pdirs WHERE NOT dir LIKE '%/de')"


@query(f"""WITH {B.PATHS}, {_COMPS}, raw AS (
 SELECT 'mobile' AS subsystem, 0 AS ord, id, 'm.*' AS matched_via FROM comps WHERE dir LIKE 'm.%' UNION ALL SELECT 'mobile', 1, id, '*/en' FROM comps WHERE dir LIKE '%/en'
 UNION ALL SELECT 'blogs', 0, id, 'blog.*/fr' FROM comps WHERE dir LIKE 'blog.%/fr' UNION ALL SELECT 'blogs', 2, id, 'blog.*' FROM comps WHERE dir LIKE 'blog.%'),
one AS (SELECT *, row_number() OVER (PARTITION BY subsystem, id ORDER BY ord) AS rn FROM raw)
SELECT subsystem, CAST(ord AS INTEGER) AS ord, id, matched_via FROM one WHERE rn = 1
UNION ALL SELECT 'mobile', 2, '', 'nowhere/* (no matches)' UNION ALL SELECT 'none', 1, '', 'gone/* (no matches)' UNION ALL SELECT 'blogs', 1, 'lost-id', 'id (no such component)' UNION ALL SELECT 'none', 0, '[x', 'id (no such component)'
UNION ALL SELECT 'blogs', 0, '', 'blog.*/fr (no matches)' WHERE NOT EXISTS (SELECT 1 FROM comps WHERE dir LIKE 'blog.%/fr')""")
def subsystem_members(spark: SparkSession, sf: str) -> DataFrame:
    return J.subsystem_evidence(_members(spark), _components(spark, sf)).select("subsystem", "ord", "id", "matched_via")


@query(f"WITH {B.PATHS}, {_COMPS} SELECT min(id) AS id FROM comps")
def subsystem_collisions(spark: SparkSession, sf: str) -> DataFrame:
    c = _components(spark, sf)
    ids = c.where("not deleted").agg(F.min("id").alias("id")).union(spark.createDataFrame([("mobile",)], "id string"))
    return J.collisions(ids, c)


@query("SELECT 'blogs' AS subsystem, 'lost-id' AS member UNION ALL SELECT 'none', '[x'")
def subsystem_bad_ids(spark: SparkSession, sf: str) -> DataFrame:
    return J.unresolved_members(_members(spark), _components(spark, sf))


@query("""SELECT * FROM (VALUES
 ('warning', 'a', 'colour', 'no such pin field: colour; it has no effect', NULL),
 ('error', 'b', 'kind', 'no such kind: rust-binary; the component would count as none', 'rust-cli'),
 ('error', 'c', 'kind', 'no such kind: blob; the component would count as none', NULL),
 ('error', 'x', 'kind', 'added component x is of no known kind: dmg', 'installer'),
 ('error', 's', NULL, 'subsystem s is listed twice', NULL),
 ('error', 't', 'members', 'subsystem t lists no members', NULL)) v(severity, pin_key, field, message, suggestion)""")
def validate_overrides(spark: SparkSession, sf: str) -> DataFrame:
    pins = spark.createDataFrame([("a", "colour", "value", "red"), ("b", "kind", "value", "rust-binary"), ("c", "kind", "value", "blob"), ("d", "kind", "value", "service"), ("e", "suppress", "suppress", None)], "key string, field string, variant string, value string")
    adds = spark.createDataFrame([("x", "dmg"), ("y", "website")], "id string, kind string")
    subs = spark.createDataFrame([(0, "s", ["m"]), (1, "s", ["n"]), (2, "t", [])], "ord int, id string, members array<string>")
    return J.validate_pins(pins).union(J.validate_additions(adds)).union(J.validate_subsystems(subs))


