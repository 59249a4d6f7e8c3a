"""Keeping results current while files or requests arrive, by the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..respond import cache as C
from ..respond.core import Responder


def follow(spark: SparkSession, folder: str, schema: str, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run ``each(batch, number)`` on Parquet files as they appear in ``folder``; with ``once``, on those there now.

    A restarted stream goes on after the last finished batch, so ``each`` must tolerate one batch twice.
    """
    stream = spark.readStream.schema(schema).parquet(folder)
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def answer_stream(spark: SparkSession, folder: str, cache_folder: str, responder: Responder, checkpoint: str) -> StreamingQuery:
    """Answer requests ``(prompt, inputs)`` that arrive as files; the cache table is the only state.

    A key that the cache holds is not asked for again, so repeated batches cost nothing.
    """

    def each(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        known = session.read.schema(C.SCHEMA).parquet(cache_folder)
        missing = C.misses(C.keyed(batch, responder), known)
        C.answer_all(missing, responder).where("response is not null").drop("error").write.mode("append").parquet(cache_folder)

    spark.createDataFrame([], C.SCHEMA).write.mode("append").parquet(cache_folder)
    return follow(spark, folder, "prompt string, inputs string", each, checkpoint)
