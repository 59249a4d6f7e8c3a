"""Queries over paths, answers of models, overrides and the response cache."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import paths as P
from ..functions import text as X
from ..operators import classify as K
from ..operators import edges as D
from ..operators import enumerate as E
from ..operators import evaluate as V
from ..operators import project as J
from ..operators import tree as T
from ..respond import cache as C
from ..respond import templates as R
from ..respond.core import PROMPTS, Canned, Fingerprint, Router
from . import bindings as B
from .registry import query


@query(f"WITH {B.FILES} SELECT path, CAST(octet_length(encode(content)) AS BIGINT) AS bytes FROM files WHERE path LIKE '%/README.md' AND path LIKE 'ws/brand-1%'")
def file_by_path(spark: SparkSession, sf: str) -> DataFrame:
    """Look up readme files by their paths; some of the paths asked for don't exist."""
    f = B.files(spark, sf)
    wanted = f.select(F.concat(P.parent(F.col("path")), F.lit("/README.md")).alias("path")).where(F.startswith("path", F.lit("ws/brand-1")))
    return E.by_path(f, wanted).select("path", F.octet_length("content").cast("long").alias("bytes"))


@query(f"WITH {B.FILES}, p AS (SELECT path FROM files UNION ALL SELECT 'ws' UNION ALL SELECT '/else/where' UNION ALL SELECT 'wsx/y') SELECT path, CASE WHEN path = 'ws' THEN '' WHEN starts_with(path, 'ws/') THEN substr(path, 4) ELSE path END AS relative, CASE WHEN starts_with(path, '/') THEN path ELSE '/root/' || path END AS absolute FROM p")
def relative_absolute(spark: SparkSession, sf: str) -> DataFrame:
    p = B.files(spark, sf).select("path").union(spark.createDataFrame([("ws",), ("/else/where",), ("wsx/y",)], "path string"))
    return p.select("path", P.relative_to(F.col("path"), "ws").alias("relative"), P.absolute(F.col("path"), "/root/").alias("absolute"))


_ODD_PATH = "CASE p_partkey % 5 WHEN 0 THEN '/' WHEN 1 THEN '../' WHEN 2 THEN 'a/../' WHEN 3 THEN 'a..b/' ELSE 'a/' END || replace(p_name, ' ', '/') || CASE p_partkey % 7 WHEN 0 THEN '/..' ELSE '' END"


@query("SELECT p_partkey, p_partkey % 5 > 2 AND p_partkey % 7 <> 0 AS safe FROM part")
def safe_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Which paths stay below their root by their letters."""
    return B.table(spark, sf, "part").select("p_partkey", P.is_safe_relative(F.expr(_ODD_PATH)).alias("safe"))


_MODEL = "CASE WHEN doc_id % 3 = 0 THEN 'local' ELSE coalesce(source, 'none') || '/' || lang || CASE WHEN doc_id % 3 = 1 THEN '/v2' ELSE '' END END"


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN coalesce(source, 'none') END AS provider, CASE WHEN doc_id % 3 = 0 THEN 'local' ELSE lang || CASE WHEN doc_id % 3 = 1 THEN '/v2' ELSE '' END END AS model FROM documents")
def model_ids(spark: SparkSession, sf: str) -> DataFrame:
    m = F.expr(_MODEL)
    return B.table(spark, sf, "documents").select("doc_id", X.provider_of(m).alias("provider"), X.model_of(m).alias("model"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '✗ ' ELSE '' END || role || CASE WHEN text = '' THEN '' ELSE ' ' || CASE WHEN length(text) > 20 THEN substr(text, 1, 19) || '…' ELSE text END END AS line FROM conversations")
def status_lines(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "conversations").select("conv_id", "turn", X.status_line(F.col("role"), F.col("text"), F.col("turn") % 3 == 0, 20).alias("line"))


_BODY = """CASE p_partkey % 4 WHEN 0 THEN '{"content":[{"type":"text","text":"' || p_name || '"}]}' WHEN 1 THEN '{"choices":[{"message":{"content":"```json\\\\n{\\\\"a\\\\":' || CAST(p_size AS VARCHAR(20)) || '}\\\\n```"}}]}' WHEN 2 THEN '{"error":"x"}' ELSE 'no json' END"""


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '{"a":' || CAST(p_size AS VARCHAR) || '}' END AS answer FROM part""")
def provider_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The answer in response bodies of either common form; null where there is none."""
    return B.table(spark, sf, "part").select("p_partkey", X.provider_text(F.expr(_BODY)).alias("answer"))


_PIN_ROWS = "SELECT DISTINCT p_brand AS key, CASE p_size % 3 WHEN 0 THEN 'kind' WHEN 1 THEN 'hue' ELSE 'role' END AS field, CASE p_size % 2 WHEN 0 THEN 'rust-binary' ELSE 'service' END AS value FROM part"


@query(f"""WITH pins AS ({_PIN_ROWS})
SELECT '  warning in pin ' || key || ' / hue: no such pin field: hue; it has no effect' AS line FROM pins WHERE field = 'hue'
UNION ALL SELECT '  error in pin ' || key || ' / kind: no such kind: rust-binary; the component would count as none (did you mean rust-cli?)' FROM pins WHERE field = 'kind' AND value = 'rust-binary'""")
def validation_report(spark: SparkSession, sf: str) -> DataFrame:
    """Lines on brands' pins with unknown fields and kinds."""
    p = B.table(spark, sf, "part").select(F.col("p_brand").alias("key"), F.expr("CASE p_size % 3 WHEN 0 THEN 'kind' WHEN 1 THEN 'hue' ELSE 'role' END").alias("field"), F.lit("value").alias("variant"), F.expr("CASE p_size % 2 WHEN 0 THEN 'rust-binary' ELSE 'service' END").alias("value")).distinct()
    return J.report_lines(J.validate_pins(p))


_VERDICT = """CASE CAST(event_id % 5 AS INT)
 WHEN 0 THEN '{"kind":"service","evidence_grade":"strong","lifecycle_roles":["build","never"],"rationale":"' || event_type || '"}'
 WHEN 1 THEN '{"kind":"non-component","evidence_grade":"odd"}'
 WHEN 2 THEN '{"kind":"spaceship"}'
 WHEN 3 THEN '{"kind":"website","is_boundary":false,"role":"u' || CAST(user_id AS VARCHAR(20)) || '"}' ELSE 'text' END"""


@query("""SELECT event_id, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'service' WHEN 1 THEN 'non-component' WHEN 3 THEN 'website' END AS kind, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'strong' WHEN 1 THEN 'medium' WHEN 3 THEN 'medium' END AS grade,
 CASE CAST(event_id % 5 AS INT) WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN false END AS boundary, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'build' WHEN 1 THEN '' WHEN 3 THEN '' END AS roles,
 CASE CAST(event_id % 5 AS INT) WHEN 0 THEN event_type WHEN 1 THEN '' WHEN 3 THEN '' END AS rationale, CASE WHEN event_id % 5 = 3 THEN 'u' || CAST(user_id AS VARCHAR) END AS role FROM events""")
def parse_classification(spark: SparkSession, sf: str) -> DataFrame:
    """Models' answers with defaults; null where the kind is unknown or the answer is no object."""
    a = B.table(spark, sf, "events").select("event_id", K.parse_answer(F.expr(_VERDICT)).alias("a"))
    return a.select("event_id", "a.kind", F.col("a.evidence_grade").alias("grade"), F.col("a.is_boundary").alias("boundary"), F.array_join("a.lifecycle_roles", ",").alias("roles"), "a.rationale", "a.role")


@query(f"WITH {B.STEPS} SELECT l_orderkey, l_linenumber FROM steps WHERE lifecycle = 'test' OR kind <> 'calls'")
def edges_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Edges that give evidence unless they are weak: calls give none, and those in tests are weak."""
    s = B.steps(spark, sf)
    e = s.select("l_orderkey", "l_linenumber", F.array("src", "dst").alias("participants"), F.when(F.col("lifecycle") == "test", "weak").otherwise("strong").alias("evidence_grade"), F.when(F.col("kind") == "calls", F.array().cast("array<string>")).otherwise(F.array("kind")).alias("evidence_fields"))
    return D.valid(e, need_evidence=True).select("l_orderkey", "l_linenumber")


@query(f"""WITH {B.VERSIONS}, l AS (SELECT DISTINCT source FROM documents),
changed AS (SELECT DISTINCT b.language FROM base b JOIN fresh f ON f.ord = b.ord WHERE b.id <> f.id OR b.kind <> f.kind)
SELECT source, CASE WHEN EXISTS (SELECT 1 FROM changed WHERE language IS NOT DISTINCT FROM source) THEN 'now' ELSE 'then' END AS stamp FROM l UNION ALL SELECT 'every', CASE WHEN EXISTS (SELECT 1 FROM changed) THEN 'now' ELSE 'then' END UNION ALL SELECT 'same', 'then'""")
def stable_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each source's components, and all of them, keep their time."""
    base, fresh = B.versions(spark, sf)
    each = J.stable_timestamps(base, fresh, "language", "then", "now").withColumnRenamed("language", "source")
    rows = [("every", J.stable_timestamp(base, fresh, "then", "now")), ("same", J.stable_timestamp(base, base, "then", "now"))]
    return each.union(spark.createDataFrame(rows, "source string, stamp string"))


@query(f"WITH {B.TREE} SELECT parent, id FROM tree WHERE parent IN ('r0', 'n3', 'n7')")
def children(spark: SparkSession, sf: str) -> DataFrame:
    return T.children(B.tree(spark, sf), spark.createDataFrame([("r0",), ("n3",), ("n7",), ("ghost",)], "id string"))


@query(f"WITH {B.PATHS} SELECT split_part(path, '/', 1) AS id, path FROM paths WHERE split_part(path, '/', 1) LIKE 'm.%'")
def component_segments(spark: SparkSession, sf: str) -> DataFrame:
    host = F.substring_index("path", "/", 1)
    c = B.paths(spark, sf).groupBy(host.alias("id")).agg(F.collect_list("path").alias("paths"))
    return T.segments(c, c.where(F.startswith("id", F.lit("m."))).select("id"))


_KINDS_SQL = ", ".join(f"('{k}')" for k in vocab.EDGE_KINDS)


@query(f"WITH {B.STEPS}, u AS (SELECT DISTINCT kind FROM steps UNION SELECT 'envies'), v AS (SELECT * FROM (VALUES {_KINDS_SQL}) x(kind)) SELECT coalesce(u.kind, v.kind) AS kind, CASE WHEN u.kind IS NULL THEN 'unused' WHEN v.kind IS NULL THEN 'unknown' ELSE 'in use' END AS state FROM u FULL OUTER JOIN v ON u.kind = v.kind")
def kinds_in_use(spark: SparkSession, sf: str) -> DataFrame:
    used = B.steps(spark, sf).select("kind").union(spark.createDataFrame([("envies",)], "kind string"))
    return V.kinds_in_use(used, vocab.EDGE_KINDS)


class _Picky:
    """Answers requests whose inputs have an even length."""

    def call(self, prompt: str, inputs: dict) -> object:
        if len(inputs["a"]) % 2:
            raise LookupError("no answer")
        return {"ok": True}

    def fingerprint(self) -> Fingerprint:
        return Fingerprint("t", "o", "picky", "1")


@query("""WITH req AS (SELECT DISTINCT lang AS prompt, coalesce(source, '') AS a FROM documents)
SELECT count(*) FILTER (prompt <> 'fr' AND length(a) % 2 = 0) AS calls, count(*) FILTER (prompt <> 'fr' AND length(a) % 2 = 1) AS errors, count(*) FILTER (prompt = 'fr' OR length(a) % 2 = 0) AS entries FROM req""")
def cache_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Calls, errors and entries after asking for every language and source, when the French answers were there."""
    responder = _Picky()
    d = B.table(spark, sf, "documents").select(F.col("lang").alias("prompt"), F.concat(F.lit('{"a":"'), F.coalesce("source", F.lit("")), F.lit('"}')).alias("inputs"))
    asked = C.keyed(d, responder)
    store = C.ResponseCache(spark.createDataFrame([], C.SCHEMA))
    store.seed(asked.where("prompt = 'fr'").withColumn("response", F.lit("{}")))
    store.record(C.answer_all(store.missing(asked), responder))
    return store.snapshot().agg(F.count("*").alias("entries")).select(F.lit(store.calls).cast("long").alias("calls"), F.lit(store.errors).cast("long").alias("errors"), "entries")


@query("""SELECT n_nationkey AS id, CASE WHEN n_regionkey % 2 = 0 THEN '' ELSE n_name END AS missing, CASE WHEN n_regionkey % 3 = 0 THEN 'EXTRA' ELSE '' END AS unused FROM nation""")
def template_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """A template for each nation against its inputs: names that nothing fills, and inputs without a use."""
    n = B.table(spark, sf, "nation")
    some = lambda c, name: F.when(c, F.array(name)).otherwise(F.array().cast("array<string>"))
    keys = F.concat(F.array(F.lit("KEY"), F.lit("SHA")), some(F.col("n_regionkey") % 2 == 0, F.col("n_name")), some(F.col("n_regionkey") % 3 == 0, F.lit("EXTRA")))
    missing, unused = R.gaps(F.concat(F.lit("A {{"), "n_name", F.lit("}} of {{ KEY }} and {{{{braces}}}}")), keys, F.array(F.lit("SHA")))
    return n.select(F.col("n_nationkey").alias("id"), F.array_join(missing, ",").alias("missing"), F.array_join(unused, ",").alias("unused"))


@query("""WITH p AS (SELECT n.n_name AS name, count(c_custkey) FILTER (c_acctbal < -900) = 0 AS passed FROM nation n LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n.n_name)
SELECT CASE WHEN count(*) FILTER (NOT passed) = 0 THEN count(*) || '/' || count(*) || ' passed' ELSE 'failed: ' || string_agg(name, ', ' ORDER BY name) FILTER (NOT passed) END AS summary FROM p""")
def invariant_summary(spark: SparkSession, sf: str) -> DataFrame:
    """One line on the nations, of which those with a customer deep in debt fail."""
    debt = B.table(spark, sf, "customer").where("c_acctbal < -900").select(F.col("c_nationkey").alias("n_nationkey")).distinct().withColumn("debt", F.lit(True))
    n = B.table(spark, sf, "nation").join(debt, "n_nationkey", "left")
    return V.summary(n.select(F.col("n_name").alias("name"), F.col("debt").isNull().alias("passed")))


_TOOLS = """CASE CAST(turn % 4 AS INT) WHEN 0 THEN 'Read' WHEN 1 THEN 'Grep' WHEN 2 THEN 'Dance' ELSE 'Bash' END"""
_INPUT = """CASE WHEN turn % 5 = 0 THEN 'no json' ELSE '{"file_path":"f' || CAST(turn AS VARCHAR(20)) || '","pattern":"' || role || '","command":"/bin/zsh -lc ls"}' END"""


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN '' ELSE CASE CAST(turn % 4 AS INT) WHEN 0 THEN 'f' || CAST(turn AS VARCHAR) WHEN 1 THEN role WHEN 2 THEN '' ELSE '/bin/zsh -lc ls' END END AS about, 'say ' || CAST(turn AS VARCHAR) AS command FROM conversations""")
def tool_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """What tool calls work on, and a shell's command without its wrapper."""
    c = B.table(spark, sf, "conversations")
    shell = F.concat(F.when(F.col("turn") % 2 == 0, F.lit('/bin/zsh -lc "say ')).otherwise(F.lit("say ")), F.col("turn").cast("string"), F.when(F.col("turn") % 2 == 0, F.lit('"')).otherwise(F.lit(" ")))
    return c.select("conv_id", "turn", X.tool_summary(F.expr(_TOOLS), F.expr(_INPUT)).alias("about"), X.shell_summary(shell).alias("command"))


@query("""SELECT n_nationkey AS id, CASE WHEN n_regionkey % 2 = 0 THEN n_name || ' ' ELSE '' END AS head, CASE WHEN n_regionkey % 2 = 0 THEN ' rest' ELSE n_name || ' rest' END AS tail, CASE WHEN n_regionkey % 2 = 0 THEN 2 ELSE 1 END AS blocks FROM nation""")
def prompt_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts split at their boundary, and the blocks that are sent; every other region's have no boundary."""
    text = F.concat("n_name", F.when(F.col("n_regionkey") % 2 == 0, F.lit(f" {R.BOUNDARY} rest")).otherwise(F.lit(" rest")))
    n = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), text.alias("prompt"))
    return n.select("id", X.prompt_head(F.col("prompt"), R.BOUNDARY).alias("head"), X.prompt_tail(F.col("prompt"), R.BOUNDARY).alias("tail"), X.prompt_block_count(F.col("prompt"), R.BOUNDARY).alias("blocks"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'missing role' WHEN 2 THEN 'expected object' ELSE 'missing kind,missing role' END AS problems FROM part""")
def response_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Answers against a schema that asks for an object with a kind and a role."""
    k = F.col("p_partkey")
    value = F.expr("""CASE p_partkey % 4 WHEN 0 THEN '{"kind":1,"role":null}' WHEN 1 THEN '{"kind":"x"}' WHEN 2 THEN '["kind","role"]' ELSE '{"other":{"kind":1}}' END""")
    return B.table(spark, sf, "part").select(k, R.object_problems(value, ("kind", "role")).alias("problems"))


@query("SELECT n_nationkey AS id, sha256(CAST(n_name AS BLOB) || '\\x00'::BLOB || CAST(CAST(n_regionkey AS VARCHAR) AS BLOB)) AS sha FROM nation")
def template_shas(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of a template's name and body, for each nation's name and region."""
    n = B.table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").alias("id"), X.template_digest((F.col("n_name"), F.col("n_regionkey").cast("string"))).alias("sha"))


@query("WITH req AS (SELECT DISTINCT lang AS prompt, '{\"a\":\"' || coalesce(source, '') || '\"}' AS inputs FROM documents) SELECT prompt, inputs, row_number() OVER (ORDER BY prompt, inputs) AS place FROM req")
def cache_order(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry of a cache, with its place in the order in which it is stored."""
    d = B.table(spark, sf, "documents").select(F.col("lang").alias("prompt"), F.concat(F.lit('{"a":"'), F.coalesce("source", F.lit("")), F.lit('"}')).alias("inputs"))
    store = C.ResponseCache(C.keyed(d, _Picky()).withColumn("response", F.lit("{}")))
    return C.placed(store.snapshot()).select("prompt", "inputs", "place")


@query("""SELECT event_id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'small' WHEN 2 THEN 'large' ELSE 'plain' END AS model FROM events""")
def provider_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Which model each request goes to, by its prompt."""

    def run(batches):
        named = lambda m: Canned({}, Fingerprint("t", "o", m, "1"))
        router = Router({"classify": named("small"), "edges": named("large")}, named("plain"))
        for pdf in batches:
            yield pdf.assign(model=[router.of(PROMPTS[k % 4]).fingerprint().model_id for k in pdf["event_id"].tolist()])

    return B.table(spark, sf, "events").select("event_id").mapInPandas(run, "event_id long, model string")


@query(f"WITH {B.TREE} SELECT id, false AS added FROM tree WHERE id NOT IN ('n1') UNION ALL SELECT 'extra', true")
def live_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components with authored additions; what a pin suppresses isn't added, and components below a pin's list go."""
    t = B.tree(spark, sf).withColumn("added", F.lit(False))
    extra = spark.createDataFrame([("extra", None, True), ("off", None, True)], "id string, parent string, added boolean")
    off = spark.createDataFrame([("off",)], "id string")
    lists = spark.createDataFrame([("r1", ["n1", "nobody"])], "key string, children array<string>")
    return T.suppress_children(T.with_additions(t, extra, off), lists).select("id", "added")
