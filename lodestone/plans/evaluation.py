"""Queries over metrics, differences, invariants and the response cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..operators import edges as D
from ..operators import enumerate as E
from ..operators import evaluate as V
from ..operators import project as J
from ..respond import cache as C
from ..respond import charges as G
from ..respond import templates as R
from ..respond.core import Canned, Fingerprint
from ..sources import tables as S
from . import bindings as B
from .registry import query

_JAC = f"""{B.SETS}, sz AS (SELECT id, half, count(*) AS n FROM picked GROUP BY id, half),
com AS (SELECT a.id AS g, b.id AS t, count(*) AS c FROM picked a JOIN picked b ON a.path = b.path AND a.half = 0 AND b.half = 1 GROUP BY a.id, b.id),
jac AS (SELECT g, t, CAST(c AS DOUBLE) / (x.n + y.n - c) AS j FROM com JOIN sz x ON x.id = g AND x.half = 0 JOIN sz y ON y.id = t AND y.half = 1)"""


@query(f"WITH {_JAC}, best AS (SELECT g.id, coalesce(max(j), 0) AS b FROM (SELECT DISTINCT id FROM picked WHERE half = 0) g LEFT JOIN jac ON jac.g = g.id GROUP BY g.id) SELECT CAST(coalesce(avg(CASE WHEN b >= 0.5 THEN 1.0 ELSE 0.0 END), 1) AS DOUBLE) AS coverage FROM best")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return V.coverage(*B.halves(spark, sf))


@query(f"WITH {_JAC}, best AS (SELECT g.id, coalesce(max(j), 0) AS b FROM (SELECT DISTINCT id FROM picked WHERE half = 1) g LEFT JOIN jac ON jac.t = g.id GROUP BY g.id) SELECT CAST(coalesce(avg(CASE WHEN b < 0.5 THEN 1.0 ELSE 0.0 END), 0) AS DOUBLE) AS spurious_rate FROM best")
def spurious_rate(spark: SparkSession, sf: str) -> DataFrame:
    return V.spurious_rate(*B.halves(spark, sf))


@query(f"WITH {_JAC}, top AS (SELECT g, t, row_number() OVER (PARTITION BY g ORDER BY j DESC, t) AS rn FROM jac WHERE j >= 0.5) SELECT CAST(coalesce(avg(CASE WHEN a.kind = b.kind THEN 1.0 ELSE 0.0 END), 1) AS DOUBLE) AS kind_accuracy FROM top JOIN kinds a ON a.id = g AND a.half = 0 JOIN kinds b ON b.id = t AND b.half = 1 WHERE rn = 1")
def kind_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return V.kind_accuracy(*B.halves(spark, sf))


_HALF = f"""{B.STEPS}, k AS (SELECT DISTINCT l_orderkey % 2 AS half, kind || '|' || lifecycle || '|' || CASE WHEN kind IN ('communicates-with', 'co-implements') AND src > dst THEN dst || ',' || src ELSE src || ',' || dst END AS key FROM steps)"""


def _keys(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = D.canonical(B.steps(spark, sf).withColumn("participants", F.array("src", "dst"))).select((F.col("l_orderkey") % 2).alias("half"), D.edge_key().alias("key"))
    return e.where("half = 0").select("key"), e.where("half = 1").select("key")


@query(f"""WITH {_HALF}, a AS (SELECT key FROM k WHERE half = 0), b AS (SELECT key FROM k WHERE half = 1), c AS (SELECT count(*) AS n FROM a JOIN b ON a.key = b.key)
SELECT CAST(c.n AS DOUBLE) / (SELECT count(*) FROM b) AS precision, CAST(c.n AS DOUBLE) / (SELECT count(*) FROM a) AS recall FROM c""")
def edge_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    return V.precision_recall(*_keys(spark, sf))


@query(f"WITH {_HALF} SELECT key, CASE WHEN max(half) = 1 THEN 'added' ELSE 'removed' END AS change FROM k GROUP BY key HAVING count(*) = 1")
def diff_edges(spark: SparkSession, sf: str) -> DataFrame:
    return V.diff_keys(*_keys(spark, sf))


@query(f"WITH {B.VERSIONS} SELECT CAST(avg(CASE WHEN f.id IS NOT NULL THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS stability FROM base b LEFT JOIN fresh f ON f.id = b.id")
def identifier_stability(spark: SparkSession, sf: str) -> DataFrame:
    return V.identifier_stability(*B.versions(spark, sf))


@query(f"""WITH {B.VERSIONS} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'kind' ELSE '' END AS fields
FROM base a FULL OUTER JOIN fresh b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.kind IS DISTINCT FROM b.kind""")
def diff_components(spark: SparkSession, sf: str) -> DataFrame:
    return V.diff(*B.versions(spark, sf), ("kind", "language", "content_sha"))


@query(f"""WITH {B.VERSIONS}, last AS (SELECT content_sha, id FROM (SELECT *, row_number() OVER (PARTITION BY content_sha ORDER BY ord DESC) AS rn FROM base) WHERE rn = 1)
SELECT DISTINCT l.id AS prior_id, f.id AS new_id FROM fresh f JOIN last l ON l.content_sha = f.content_sha WHERE l.id <> f.id""")
def identifier_changes(spark: SparkSession, sf: str) -> DataFrame:
    return V.identifier_changes(*B.versions(spark, sf))


@query(f"""WITH {B.PATHS}, seg AS (SELECT 'a:' || split_part(path, '/', 1) AS id, path FROM paths UNION SELECT 'b:' || regexp_replace(path, '/?[^/]*$', '') AS id, regexp_replace(path, '/?[^/]*$', '') AS path FROM paths WHERE contains(path, '/')),
kin AS (SELECT DISTINCT 'a:' || split_part(path, '/', 1) AS x, 'b:' || regexp_replace(path, '/?[^/]*$', '') AS y FROM paths WHERE path LIKE '%/en/%'),
hit AS (SELECT DISTINCT p.id AS a, q.id AS b, p.path AS path_a, q.path AS path_b FROM seg p JOIN seg q ON (p.path = q.path AND p.id < q.id) OR (p.id <> q.id AND starts_with(p.path, q.path || '/')))
SELECT h.* FROM hit h LEFT JOIN kin k ON (k.x = h.a AND k.y = h.b) OR (k.x = h.b AND k.y = h.a) WHERE k.x IS NULL""")
def inv_path_overlap(spark: SparkSession, sf: str) -> DataFrame:
    p = B.paths(spark, sf)
    host, up = F.substring_index("path", "/", 1), P.parent(F.col("path"))
    seg = p.select(F.concat(F.lit("a:"), host).alias("id"), "path").union(p.where(F.contains("path", F.lit("/"))).select(F.concat(F.lit("b:"), up), up)).distinct()
    above = p.where(F.contains("path", F.lit("/en/"))).select(F.concat(F.lit("b:"), up).alias("id"), F.concat(F.lit("a:"), host).alias("ancestor")).distinct()
    return V.path_overlaps(seg, above)


@query(f"""WITH {B.STEPS}, k AS (SELECT DISTINCT kind || '|' || lifecycle || '|' || src || ',' || dst AS key, src, dst FROM steps), known AS (SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS id FROM part WHERE p_brand NOT LIKE '%3')
SELECT DISTINCT key, id FROM (SELECT key, src AS id FROM k UNION ALL SELECT key, dst FROM k) x WHERE id NOT IN (SELECT id FROM known)""")
def inv_participants(spark: SparkSession, sf: str) -> DataFrame:
    e = B.steps(spark, sf).withColumn("participants", F.array("src", "dst")).withColumn("key", D.edge_key()).select("key", "participants").distinct()
    known = B.table(spark, sf, "part").where("p_brand not like '%3'").select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("id")).distinct()
    return V.unknown_participants(e, known)


_FOUND = r"found AS (SELECT path FROM files WHERE regexp_extract(path, '[^/]*$') IN ('Cargo.toml', 'package.json', 'pyproject.toml'))"


@query(f"WITH {B.FILES}, {_FOUND} SELECT path FROM found WHERE path NOT LIKE '%/Cargo.toml'")
def inv_manifest_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests that no component names, when components name crate manifests only."""
    found = E.manifests_in(B.files(spark, sf))
    comps = found.where(F.endswith("path", F.lit("/Cargo.toml"))).groupBy(P.parent(F.col("path")).alias("id")).agg(F.collect_list("path").alias("manifests"))
    return V.uncovered_manifests(found, comps)


@query(f"WITH {B.PATHS} SELECT DISTINCT split_part(path, '/', 1) AS id FROM paths WHERE split_part(path, '/', 1) LIKE 'blog.%'")
def inv_path_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Components without a path, when the blogs' paths are taken away."""
    c = B.paths(spark, sf).groupBy(F.substring_index("path", "/", 1).alias("id")).agg(F.collect_list("path").alias("paths"))
    return V.empty_paths(c.withColumn("paths", F.when(F.startswith("id", F.lit("blog.")), F.array().cast("array<string>")).otherwise(F.col("paths"))))


@query(f"WITH {B.FILES}, g AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS dir FROM files WHERE regexp_extract(path, '[^/]*$') = '.git') SELECT dir AS id FROM g WHERE dir LIKE '%small'")
def inv_git_rationale(spark: SparkSession, sf: str) -> DataFrame:
    """Components on repository roots that give no reason, when those named small don't."""
    g = E.git_boundaries(B.files(spark, sf))
    c = g.select(F.col("dir").alias("id"), F.array("dir").alias("paths"), F.array().cast("array<string>").alias("manifests"), F.when(F.endswith("dir", F.lit("small")), F.array(F.lit("x"))).otherwise(F.array(F.lit(".git"))).alias("evidence_fields"))
    return V.missing_git_rationale(c, g)


_REQ = "req AS (SELECT DISTINCT lang AS prompt, '{\"a\":\"' || source || '\",\"n\":' || CAST(n_chars % 50 AS VARCHAR) || '}' AS inputs, doc_id FROM documents)"
_CACHE = "cached AS (SELECT DISTINCT r.prompt, r.inputs FROM req r JOIN labels l ON l.doc_id = r.doc_id)"


def _requests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, Canned]:
    r = B.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("prompt"), F.concat(F.lit('{"a":"'), "source", F.lit('","n":'), (F.col("n_chars") % 50).cast("string"), F.lit("}")).alias("inputs"))
    responder = Canned({}, Fingerprint("t", "o", "m", "1"))
    asked = C.keyed(r, responder)
    known = C.keyed(r.join(B.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi"), responder).withColumn("response", F.lit("{}"))
    return asked, known, responder


@query(f"WITH {_REQ}, {_CACHE} SELECT r.prompt, r.inputs, c.inputs IS NOT NULL AS hit FROM (SELECT DISTINCT prompt, inputs FROM req) r LEFT JOIN cached c ON c.prompt = r.prompt AND c.inputs = r.inputs")
def cache_hits_misses(spark: SparkSession, sf: str) -> DataFrame:
    asked, known, _ = _requests(spark, sf)
    return C.hits(asked, known).select("prompt", "inputs", F.lit(True).alias("hit")).union(C.misses(asked, known).select("prompt", "inputs", F.lit(False)))


@query(f"WITH {_REQ} SELECT prompt, count(*) AS calls FROM (SELECT DISTINCT prompt, inputs FROM req) GROUP BY prompt")
def prompt_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return C.breakdown(_requests(spark, sf)[0])


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, CAST(octet_length(encode(coalesce(text, ''))) // 4 AS BIGINT) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
f AS (SELECT conv_id, turn, cost, rn, cost <= 500 AS accepted, CASE WHEN cost <= 500 THEN cost ELSE 0 END AS used FROM r WHERE rn = 1
  UNION ALL SELECT r.conv_id, r.turn, r.cost, r.rn, f.used + r.cost <= 500, CASE WHEN f.used + r.cost <= 500 THEN f.used + r.cost ELSE f.used END FROM f JOIN r ON r.conv_id = f.conv_id AND r.rn = f.rn + 1)
SELECT conv_id AS session, turn AS seq, cost, accepted, CAST(used AS BIGINT) AS used FROM f""")
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy charges of each conversation's turns against 500 tokens."""
    r = B.table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), X.token_estimate(F.col("text")).alias("cost"))
    return G.greedy_charges(r, 500)


@query("SELECT conv_id AS session, turn AS seq, CAST(octet_length(encode(text)) // 4 AS BIGINT) AS cost, CAST(sum(octet_length(encode(text)) // 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM conversations")
def token_running_total(spark: SparkSession, sf: str) -> DataFrame:
    r = B.table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), X.token_estimate(F.col("text")).alias("cost"))
    return C.running_cost(r)


@query("SELECT n_nationkey AS id, 'Nation ' || n_name || ' {{kept}} ' || CAST(n_regionkey AS VARCHAR) AS prompt FROM nation")
def prompt_render(spark: SparkSession, sf: str) -> DataFrame:
    n = B.table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").alias("id"), R.filled("Nation {{NAME}} {{{{kept}}}} {{KEY}}", {"NAME": F.col("n_name"), "KEY": F.col("n_regionkey")}).alias("prompt"))


_LINE = """CASE role WHEN 'assistant' THEN '{"type":"result","is_error":' || CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'false' END || ',"result":"t' || CAST(turn AS VARCHAR(20)) || '"}' WHEN 'user' THEN '{"type":"user","result":"no"}' ELSE 'not json' END"""


@query("""WITH a AS (SELECT conv_id AS stream, turn AS line_no, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role = 'assistant')
SELECT stream, line_no, line_no % 2 = 0 AS is_error, 't' || CAST(line_no AS VARCHAR) AS result FROM a WHERE rn = 1""")
def terminal_event(spark: SparkSession, sf: str) -> DataFrame:
    c = B.table(spark, sf, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("line_no"), F.expr(_LINE).alias("line"))
    return S.agent_results(c)


_TURN = """CASE WHEN role = 'assistant' THEN '{"type":"item.completed","item":{"type":"agent_message","text":"m' || CAST(turn AS VARCHAR(20)) || '"}}' WHEN role = 'system' THEN '{"type":"turn.failed","error":{"message":"e' || CAST(turn AS VARCHAR(20)) || '"}}' ELSE '{"type":"item.started"}' END"""


@query("""SELECT conv_id AS stream, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) = 1 AS failed, CASE WHEN max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) = 1 THEN 'e' || CAST(max(CASE WHEN role = 'system' THEN turn END) AS VARCHAR) ELSE 'm' || CAST(max(CASE WHEN role = 'assistant' THEN turn END) AS VARCHAR) END AS message FROM conversations GROUP BY conv_id""")
def turn_outcome(spark: SparkSession, sf: str) -> DataFrame:
    c = B.table(spark, sf, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("line_no"), F.expr(_TURN).alias("line"))
    return S.turn_messages(c)


_TOOL = """'{"type":"x","message":{"content":[{"type":"tool_use","name":"' || role || '"},{"type":"tool_result"' || CASE WHEN turn % 2 = 0 THEN ',"is_error":true' ELSE '' END || '},{"type":"text"}]}}'"""


@query("""SELECT conv_id AS stream, turn AS line_no, 'tool_use' AS event, role AS name, CAST(NULL AS BOOLEAN) AS ok FROM conversations UNION ALL SELECT conv_id, turn, 'tool_result', NULL, turn % 2 <> 0 FROM conversations""")
def tool_events(spark: SparkSession, sf: str) -> DataFrame:
    c = B.table(spark, sf, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("line_no"), F.expr(_TOOL).alias("line"))
    return S.tool_events(c)


@query(f"""WITH {B.TREE}, {B.STEPS}, e AS (SELECT DISTINCT kind, lifecycle, src, dst FROM steps)
SELECT 'index: components=' || CAST((SELECT count(*) FROM tree) AS VARCHAR) || ' externals=0 edges=' || CAST((SELECT count(*) FROM e) AS VARCHAR) || ' llm_calls=0 llm_errors=0 tokens=0 (no budget) iterations=1 written=false' AS line""")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    n = B.tree(spark, sf).agg(F.count("*").alias("components"))
    e = B.steps(spark, sf).select("kind", "lifecycle", "src", "dst").distinct().agg(F.count("*").alias("edges"))
    zero = F.lit(0)
    s = n.crossJoin(e).select(F.struct("components", zero.alias("externals"), "edges", zero.alias("calls"), zero.alias("errors"), zero.alias("tokens_used"), F.lit(None).cast("int").alias("token_budget"), F.lit(1).alias("iterations"), F.lit(False).alias("written")).alias("s"))
    return s.select(J.summary_line().alias("line"))
