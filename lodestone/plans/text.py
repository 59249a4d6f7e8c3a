"""Queries over files, lines and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import manifests as M
from ..functions import paths as P
from ..functions import text as T
from ..operators import candidates as C
from ..operators import classify as K
from ..operators import enumerate as E
from ..operators import project as J
from . import bindings as B
from .registry import query

_IN = ", ".join(f"'{m}'" for m in vocab.MANIFESTS)
_BASE = r"regexp_extract(path, '[^/]*$')"
_PARENT = r"regexp_replace(path, '/?[^/]*$', '')"
_IS_MANIFEST = f"({_BASE} IN ({_IN}) OR {_BASE} LIKE '%.nix')"


@query(f"WITH {B.FILES} SELECT path FROM files WHERE (path = 'ws' OR starts_with(path, 'ws/')) AND {_IS_MANIFEST}")
def manifests_in(spark: SparkSession, sf: str) -> DataFrame:
    return E.manifests_in(B.files(spark, sf), "ws")


@query(f"WITH {B.FILES} SELECT DISTINCT {_PARENT} AS dir FROM files WHERE {_BASE} = '.git'")
def git_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return E.git_boundaries(B.files(spark, sf))


_LINES = r"""lines AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM {src}),
marked AS (SELECT path, CAST(line_no AS INTEGER) AS line_no, regexp_replace(line, '\r$', '') AS line FROM lines),
fenced AS (SELECT *, regexp_matches(trim(line), '^(```|~~~)') AS fence FROM marked),
opened AS (SELECT *, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM fenced),
body AS (SELECT path, line_no, CAST(length(regexp_extract(line, '^(#{1,6}) ', 1)) AS INTEGER) AS level, rtrim(regexp_replace(regexp_replace(regexp_extract(line, '^#{1,6} (.*)$', 1), '\s+$', ''), '#+$', '')) AS text FROM opened WHERE NOT fence AND o % 2 = 0 AND regexp_matches(line, '^#{1,6} '))"""


@query("WITH " + B.DOCS + ", " + _LINES.replace("{src}", "docs") + " SELECT path, line_no, level, text FROM body WHERE text <> ''")
def readme_headings(spark: SparkSession, sf: str) -> DataFrame:
    return E.doc_headings(B.docs(spark, sf))


@query(rf"WITH {B.FILES} SELECT path, trim(regexp_extract(content, '^#!([^\r\n]*)', 1)) AS interpreter FROM files WHERE starts_with(content, '#!')")
def shebang_scan(spark: SparkSession, sf: str) -> DataFrame:
    return E.shebangs(B.files(spark, sf))


_DIRS = "dirs AS (SELECT DISTINCT dir FROM (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir FROM files UNION ALL SELECT regexp_replace(path, '/[^/]*/[^/]*$', '') FROM files UNION ALL SELECT 'ws') x)"


@query(f"""WITH {B.FILES}, {_DIRS},
held AS (SELECT dir, substr(path, length(dir) + 2) AS rel, content FROM files JOIN dirs ON starts_with(path, dir || '/')),
bits AS (SELECT dir, rel, printf('%02x', octet_length(encode(rel))) || '00000000000000' || lower(hex(encode(rel))) || sha256(content) AS piece FROM held)
SELECT dir, sha256(unhex(string_agg(piece, '' ORDER BY string_split(rel, '/')))) AS content_sha FROM bits GROUP BY dir""")
def file_tree_sha(spark: SparkSession, sf: str) -> DataFrame:
    f = B.files(spark, sf)
    return E.tree_sha(f, f.select(F.explode(P.ancestors(F.col("path"))).alias("dir")).distinct())


@query("""SELECT d.doc_id AS path FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL""")
def snapshot_upserts(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = B.table(spark, sf, "documents"), B.table(spark, sf, "labels").select("doc_id", "quality")
    old = d.select(F.col("doc_id").alias("path"), F.coalesce("source", F.lit("")).alias("content"))
    new = d.join(lab, "doc_id", "left").select(F.col("doc_id").alias("path"), F.concat(F.coalesce("source", F.lit("")), F.coalesce(F.concat(F.lit("/"), F.col("quality").cast("string")), F.lit(""))).alias("content"))
    return E.upserts(old, new).select("path")


@query(f"WITH {B.FILES} SELECT path FROM files WHERE NOT (path = 'ws/brand-1' OR starts_with(path, 'ws/brand-1/'))")
def excluded_subtree(spark: SparkSession, sf: str) -> DataFrame:
    return E.without_subtree(B.files(spark, sf), "ws/brand-1", "ws").select("path")


@query("SELECT page_id, octet_length(encode(html)) > 4096 AS elided, CAST(CASE WHEN octet_length(encode(html)) > 4096 THEN 0 ELSE octet_length(encode(html)) END AS BIGINT) AS kept_bytes FROM pages")
def elided_files(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "pages").select("page_id", F.col("html").alias("content"))
    return E.elided(p, limit=4096).select("page_id", "elided", F.octet_length("content").cast("long").alias("kept_bytes"))


@query(f"WITH {B.PATHS} SELECT split_part(path, '/', 1) AS name, CASE WHEN max(CASE WHEN contains(path, '/') THEN 1 ELSE 0 END) = 1 THEN 'dir' ELSE 'file' END AS kind FROM paths GROUP BY 1")
def list_dir(spark: SparkSession, sf: str) -> DataFrame:
    return E.list_dir(B.paths(spark, sf), "")


@query(f"WITH {B.PATHS} SELECT path FROM paths WHERE regexp_matches(path, '^[^/]*/en/[^/]*$')")
def glob_files(spark: SparkSession, sf: str) -> DataFrame:
    return E.glob_files(B.paths(spark, sf), "*/en/*", most=None)


@query(r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
c AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, regexp_replace(line, '\r$', '') AS line FROM lines)
SELECT * FROM c WHERE regexp_matches(line, '[Ll]icen[sc]e|rights reserved')""")
def grep_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = B.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return E.grep(d, "[Ll]icen[sc]e|rights reserved", most=None, by=("doc_id",))


@query("""WITH r AS (SELECT conv_id AS session, turn AS seq, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM conversations),
w AS (SELECT *, least(size, 400) AS want, coalesce(sum(least(size, 400)) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT session, seq, size, CAST(greatest(0, least(want, 1000 - before)) AS BIGINT) AS granted, greatest(0, least(want, 1000 - before)) < size AS truncated FROM w""")
def read_budgeted(spark: SparkSession, sf: str) -> DataFrame:
    r = B.table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.octet_length("text").cast("long").alias("size"))
    return E.read_budgeted(r, budget=1000, cap=400)


_CANDIDATES = f"""cand AS (SELECT DISTINCT dir FROM (SELECT {_PARENT} AS dir FROM files WHERE {_IS_MANIFEST} UNION ALL SELECT {_PARENT} FROM files WHERE {_BASE} = '.git') x)"""


@query(f"""WITH {B.FILES}, {_CANDIDATES} SELECT dir FROM cand UNION SELECT 'ws/added' UNION SELECT 'ws/brand-2/economy'""")
def candidate_union(spark: SparkSession, sf: str) -> DataFrame:
    added = spark.createDataFrame([("ws/added",)], "dir string")
    carved = spark.createDataFrame([("ws/brand-2/economy",)], "dir string")
    return C.candidate_dirs(B.files(spark, sf), added, carved)


_SQL_HEADS = _LINES.replace("{src}", "(SELECT * FROM files WHERE upper(split_part(regexp_extract(path, '[^/]*$'), '.', 1)) IN ('README', 'CHANGELOG', 'CONTRIBUTING'))")
_BUNDLES = f"""{_CANDIDATES}, {_SQL_HEADS},
man AS (SELECT {_PARENT} AS dir, string_agg(path, ',' ORDER BY path) AS manifests FROM files WHERE {_IS_MANIFEST} GROUP BY 1),
git AS (SELECT DISTINCT {_PARENT} AS dir FROM files WHERE {_BASE} = '.git'),
heads AS (SELECT dir, count(*) AS headings FROM body JOIN cand ON starts_with(path, dir || '/') WHERE text <> '' GROUP BY dir),
bangs AS (SELECT dir, count(*) AS shebangs FROM files JOIN cand ON starts_with(path, dir || '/') WHERE starts_with(content, '#!') GROUP BY dir),
bundle AS (SELECT c.dir, coalesce(manifests, '') AS manifests, git.dir IS NOT NULL AS is_git_root, CAST(coalesce(headings, 0) AS BIGINT) AS headings, CAST(coalesce(shebangs, 0) AS BIGINT) AS shebangs
  FROM cand c LEFT JOIN man ON man.dir = c.dir LEFT JOIN git ON git.dir = c.dir LEFT JOIN heads ON heads.dir = c.dir LEFT JOIN bangs ON bangs.dir = c.dir)"""


@query(f"WITH {B.FILES}, {_BUNDLES} SELECT * FROM bundle")
def candidate_bundle(spark: SparkSession, sf: str) -> DataFrame:
    f = B.files(spark, sf)
    b = C.bundles(f, C.candidate_dirs(f))
    size = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return b.select("dir", F.array_join("manifests", ",").alias("manifests"), "is_git_root", size("headings").alias("headings"), size("shebangs").alias("shebangs"))


@query(f"""WITH {B.FILES}, j AS (SELECT path, content, json_valid(content) AS ok FROM files WHERE {_BASE} = 'package.json')
SELECT path, ok AND contains(content, '"main"') AS has_main, ok AND contains(content, '"exports"') AS has_exports, ok AND contains(content, '"bin"') AS has_bin FROM j""")
def package_json_shape(spark: SparkSession, sf: str) -> DataFrame:
    f = B.files(spark, sf).where(P.basename(F.col("path")) == "package.json")
    return f.select("path", M.package_shape(F.col("content")).alias("s")).select("path", "s.*")


@query(f"""WITH {B.FILES} SELECT path, contains(content, '[lib]') AS has_lib, contains(content, '[[bin]]') AS has_bin, contains(content, '[workspace]') AS has_workspace FROM files WHERE {_BASE} = 'Cargo.toml'""")
def cargo_shape(spark: SparkSession, sf: str) -> DataFrame:
    f = B.files(spark, sf).where(P.basename(F.col("path")) == "Cargo.toml")
    return f.select("path", M.cargo_shape("content").alias("s")).select("path", "s.*")


@query(rf"""WITH {B.FILES}, c AS (SELECT path, regexp_extract(content, 'serde = "([^"]*)"', 1) AS v FROM files WHERE {_BASE} = 'Cargo.toml'),
f AS (SELECT path, v, row_number() OVER (ORDER BY path) AS rn FROM c)
SELECT 'crate:serde' AS id, 'external' AS kind, 'rust' AS language, 'pkg:cargo/serde@' || max(CASE WHEN rn = 1 THEN v END) AS purl, string_agg(path, ',' ORDER BY path) AS discovered_from FROM f""")
def cargo_externals(spark: SparkSession, sf: str) -> DataFrame:
    e = J.externals(J.cargo_externals(B.files(spark, sf)))
    return e.select("id", "kind", "language", "purl", F.array_join("discovered_from", ",").alias("discovered_from"))


_NPM = rf"""npm AS (SELECT path, seq, 'npm:' || k AS id, 'pkg:npm/' || k || '@' || v AS purl FROM (
  SELECT path, 1 AS seq, 'lodash' AS k, regexp_extract(content, '"lodash":"([^"]*)"', 1) AS v FROM files WHERE {_BASE} = 'package.json' AND json_valid(content) AND contains(content, '"lodash"')
  UNION ALL SELECT path, 2, regexp_extract(content, '"(dep[0-9])":"', 1), regexp_extract(content, '"dep[0-9]":"([^"]*)"', 1) FROM files WHERE {_BASE} = 'package.json' AND json_valid(content) AND regexp_matches(content, '"dep[0-9]"')) x),
ext AS (SELECT id, purl, path, row_number() OVER (PARTITION BY id ORDER BY path, seq) AS rn FROM npm)"""


@query(f"""WITH {B.FILES}, {_NPM} SELECT id, 'external' AS kind, 'javascript' AS language, max(CASE WHEN rn = 1 THEN purl END) AS purl, string_agg(path, ',' ORDER BY path) AS discovered_from FROM ext GROUP BY id""")
def npm_externals(spark: SparkSession, sf: str) -> DataFrame:
    e = J.externals(J.npm_externals(B.files(spark, sf)))
    return e.select("id", "kind", "language", "purl", F.array_join("discovered_from", ",").alias("discovered_from"))


_RULES = rf"""own AS (SELECT dir, max(CASE WHEN {_BASE} = 'Cargo.toml' THEN content END) AS cargo, max(CASE WHEN {_BASE} = 'package.json' THEN CASE WHEN json_valid(content) THEN content ELSE '' END END) AS package, max(CASE WHEN {_BASE} = 'pyproject.toml' THEN 1 END) AS py,
  max(CASE WHEN upper(split_part({_BASE}, '.', 1)) = 'README' THEN 1 END) AS readme FROM files JOIN cand ON {_PARENT} = dir GROUP BY dir),
ruled AS (SELECT b.dir, CASE WHEN contains(cargo, '[workspace]') THEN 'workspace' WHEN contains(cargo, '[[bin]]') THEN 'rust-cli' WHEN contains(cargo, '[lib]') THEN 'rust-library'
  WHEN contains(package, '"bin"') THEN 'node-cli' WHEN contains(package, '"main"') OR contains(package, '"exports"') THEN 'node-library' WHEN py = 1 THEN 'python-library'
  WHEN is_git_root AND b.manifests = '' AND readme IS NULL THEN 'non-component' END AS kind FROM bundle b JOIN own ON own.dir = b.dir)"""


def _ruled(spark: SparkSession, sf: str) -> DataFrame:
    f = B.files(spark, sf)
    return K.classify_by_rules(C.bundles(f, C.candidate_dirs(f)), f)


@query(f"WITH {B.FILES}, {_BUNDLES}, {_RULES} SELECT dir, kind FROM ruled")
def classify_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _ruled(spark, sf).select("dir", F.col("rule.kind").alias("kind"))


_PINS = [("ws/brand-1/economy", "kind", "value", "service"), ("economy", "kind", "value", "nonsense"), ("ws/brand-3/small", "suppress", "suppress", None), ("promo", "role", "value", "r"), ("promo", "kind", "value", "website")]
_PIN_SQL = "pinned AS (SELECT dir, CASE WHEN dir = 'ws/brand-1/economy' THEN 'service' WHEN dir = 'ws/brand-3/small' THEN 'non-component' WHEN dir LIKE '%/economy' THEN 'non-component' WHEN dir LIKE '%/promo' THEN 'website' END AS pin, dir <> 'ws/brand-3/small' AS on_ FROM cand)"


@query(f"""WITH {B.FILES}, {_BUNDLES}, {_RULES}, {_PIN_SQL}
SELECT r.dir, CASE WHEN pin IS NOT NULL THEN 'pin' WHEN kind IS NOT NULL THEN 'rule' ELSE 'unknown' END AS source, coalesce(pin, kind, 'non-component') AS kind, CASE WHEN pin IS NOT NULL THEN on_ ELSE coalesce(kind, 'non-component') <> 'non-component' END AS is_boundary
FROM ruled r JOIN pinned p ON p.dir = r.dir""")
def classify_cascade(spark: SparkSession, sf: str) -> DataFrame:
    ruled = _ruled(spark, sf)
    pins = spark.createDataFrame(_PINS, "key string, field string, variant string, value string")
    got = K.cascade(ruled, K.by_pins(ruled.select("dir"), pins))
    return got.select("dir", "source", F.col("answer.kind").alias("kind"), F.col("answer.is_boundary").alias("is_boundary"))


_SLUG = r"nullif(trim(regexp_replace(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '-', 'g'), '-'), '')"
_LEAF = _SLUG.replace("{c}", "p_brand || '  ' || p_name || '!'")
_WHOLE = _SLUG.replace("{c}", "p_brand || '  ' || p_name || '!'")


@query(f"SELECT p_partkey, {_LEAF} AS leaf, 'a/' || {_WHOLE} AS whole, substr(sha256('a/' || p_brand || '  ' || p_name || '!'), 1, 8) AS short_hash FROM part")
def slug_ids(spark: SparkSession, sf: str) -> DataFrame:
    p = F.concat(F.lit("a/"), "p_brand", F.lit("  "), "p_name", F.lit("!"))
    return B.table(spark, sf, "part").select("p_partkey", P.leaf_slug(p).alias("leaf"), P.slug_path(p).alias("whole"), P.short_hash(p).alias("short_hash"))


@query("""WITH b AS (SELECT doc_id, text FROM documents)
SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS clipped, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS flat, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html, CAST((octet_length(encode(text)) + octet_length(encode('abc'))) // 4 AS BIGINT) AS tokens FROM b""".replace("\\\\", "\\"))
def text_formats(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return B.table(spark, sf, "documents").select("doc_id", T.clip(t, 40).alias("clipped"), T.flatten(t).alias("flat"), T.escape_html(t).alias("html"), T.token_estimate(t, F.lit("abc")).alias("tokens"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey < 10000 THEN CAST(o_custkey AS VARCHAR) WHEN o_custkey < 1000000 THEN printf('%.1fk', o_custkey / 1000.0) ELSE printf('%.2fM', o_custkey / 1000000.0) END AS short,
  printf('%02d:%02d', o_orderkey // 60, o_orderkey % 60) AS elapsed, strftime(greatest(o_orderdate, TIMESTAMP '1970-01-01 00:00:00'), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM orders""")
def number_formats(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders")
    return o.select("o_orderkey", T.abbreviate(F.col("o_custkey")).alias("short"), T.minutes_seconds(F.col("o_orderkey")).alias("elapsed"), T.rfc3339(F.col("o_orderdate").cast("timestamp")).alias("stamp"))
