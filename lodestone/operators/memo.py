"""Results kept between runs, by what they were computed from: only rows whose inputs changed are computed again."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .settle import settle


def digest_of(rows: DataFrame, by: str, *columns: Column) -> DataFrame:
    """``(by, digest)``: an order-free digest of each group's rows. Sums of hashes and a count, so partial sums meet in the shuffle."""
    one = F.sha2(F.concat_ws("\0", *[F.coalesce(c.cast("string"), F.lit("\1")) for c in columns]), 256)
    parts = [F.conv(F.substring(one, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = rows.select(by, *[p.alias(f"_p{k}") for k, p in enumerate(parts)]).groupBy(by).agg(F.count("*").alias("_n"), *[F.sum(f"_p{k}").alias(f"_p{k}") for k in range(4)])
    return sums.select(by, F.sha2(F.concat_ws(",", *[F.col(c).cast("string") for c in ("_n", "_p0", "_p1", "_p2", "_p3")]), 256).alias("digest"))


class Memo:
    """A table of results by key and digest, in a folder that all machines reach. Runs append to it; rows of older digests stay.

    ``computed`` counts the rows that the last call had to compute, ``counts`` those of all calls, by name.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.computed = spark, folder.rstrip("/"), 0
        self.counts: Counter[str] = Counter()

    def through(self, name: str, asked: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Results for ``asked(key, digest)``: the kept ones, and those of ``compute(keys)`` for the others, which are kept from now on.

        ``compute`` gets a table of ``key`` and gives rows of ``key`` and any columns, one at most for each key; a key
        without a row is computed again next time.
        """
        asked, path = settle(asked.select(key, "digest")), f"{self.folder}/{name}"
        known = self._read(path)
        missing = settle(asked if known is None else asked.join(known, [key, "digest"], "left_anti"))
        self.computed = missing.count()
        self.counts[name] += self.computed
        if self.computed or known is None:
            fresh = compute(missing.select(key)).join(missing, key)
            fresh.write.mode("append").parquet(path)
            known = self._read(path)
        # a run that failed between may have left a row twice
        return known.join(asked, [key, "digest"], "left_semi").dropDuplicates([key]).drop("digest")

    def _read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
