"""The stages of ``corpus_pipeline.py``: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Their results are written as Parquet and read again, so that a lost executor costs no more than
the stage that runs. Null texts count as empty ones, null ids, labels and sources are allowed, an empty table
passes through all stages, and columns beyond those of ``documents`` are carried to the packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, ngram_join, packing, quality, repeats
from .shared import crc_mod, discard, free_name, materialise

#: Passages of this many words and more that also start elsewhere are cut.
PASSAGES = repeats.RepeatParams(width=50, gram=8, unit="word")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects; it learns from the labelled rows of its training fold.

    Empty texts are scored like others, by their lack of words. Repeated rows are judged alike. Without a usable
    label there is no model and no ground to reject anything: all documents stay.
    """
    model = quality.quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("doc_id", 4) != 2)
    if model is None:
        return docs
    scored = quality.score_quality(docs, model, docs.columns, score_col=free_name("_score", docs.columns), predicted_col=(own := free_name("_predicted", docs.columns)))
    return scored.where(F.col(own) == 1).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of near-duplicates; a null id is the least.

    Texts without words are near nothing and stay. Of rows equal in id and text one stays, whichever columns it has beside them.
    """
    return ngram_join.drop_near_duplicates(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words and more that also start elsewhere from the texts; all documents stay, even if nothing is left of them."""
    return repeats.without_repeats(docs, PASSAGES)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's share, a row for each copy of a document, in training order; documents without words are taken once."""
    return mixing.mix(docs, position_col=free_name("_position", docs.columns)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts' token ids into sequences; a row for each piece. An empty text is one piece, its end token."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeat_stage),
    ("mixing to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out = materialise(out, "stage")
        discard(docs)
        docs = out
    return docs
