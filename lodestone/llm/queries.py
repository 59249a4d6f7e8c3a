"""Queries of this subpackage for the driver's registry, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, divergence, embedding_dedup, fingerprints, lm, mixing, ngram_join, packing, quality, repeats, stages, toxicity, training_order
from .shared import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.toxicity_model(docs, labels, crc_mod("doc_id", 5) != 0)
    return toxicity.score_toxicity(docs, model, ["doc_id"]).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.quality_model(docs, labels, crc_mod("doc_id", 4) != 2)
    return quality.score_quality(docs, model, ["doc_id"]).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.place(_table(spark, sf_dir, "documents"), ["doc_id"])
    first = F.coalesce(F.get("copies", F.lit(0))["position"], F.lit(2.0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"])
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), first.alias("_p")).orderBy("_p", "doc_id").drop("_p")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY skey) AS rank FROM d GROUP BY skey),
w AS (SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS top FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY top / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT skey, source_size, CASE WHEN top <= w * level THEN top ELSE w * max(CASE WHEN top > w * level THEN level END) OVER () END AS target FROM l),
p AS (SELECT d.*, t.source_size, CAST(t.target AS DOUBLE) AS target, CAST(round(t.target) AS BIGINT) AS aim,
             coalesce(sum(size) OVER (PARTITION BY d.skey ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
      FROM d JOIN t ON d.skey = t.skey)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, aim - s)) + greatest(0, least(size, aim - s - source_size)) + greatest(0, least(size, aim - s - 2 * source_size)) AS BIGINT) AS taken
FROM p
"""


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise_order(_table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    trie = lm.build_trie(docs, crc_mod("doc_id", 7) != 2)
    scored = lm.score_texts(docs, trie, ["doc_id"])
    # texts of any length compare by their mean; the gain over single words tells how well the text's sequence is known
    each = [(F.col("score") / F.col("n_tokens")).alias("score_per_token"), ((F.col("score") - F.col("base_score")) / F.col("n_tokens")).alias("gain_per_token")]
    return scored.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(trie.tokens).cast("long").alias("train_tokens"), "base_score", "score", *each)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # beyond the contract's columns n_passages also counts passages of 50 words and more under 400 bytes, of which nothing is removed
    return repeats.cut_and_passages(_table(spark, sf_dir, "documents"), ["doc_id"], stages.PASSAGES)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(t) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS terms, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS in_lang, v.n AS total_lang, v.terms
      FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + terms)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (in_lang + 1)::HUGEINT) // (total_lang + terms)::HUGEINT AS q FROM x),
e AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(e.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.beside_next(_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.agreement(_table(spark, sf_dir, "documents"), ["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": stages.run,
        "op1_toxicity": op1_toxicity,
        "op2_mixing": op2_mixing,
        "op3_quality": op3_quality,
        "op4_training_order": op4_training_order,
        "op5_ann": op5_ann,
        "op6_ngram_join": op6_ngram_join,
        "op7_packing": op7_packing,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_divergence": op11_divergence,
        "op12_fingerprints": op12_fingerprints,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op11_divergence": OP11_SQL}
