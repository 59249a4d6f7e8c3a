"""Spark helpers that several operators of this subpackage use."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
import weakref
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: list = []
_scratch: list[str] = []
_written: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where unset a temporary one.

    The temporary folder serves single-machine sessions such as tests; a cluster must name its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not _own_dirs:
            own = tempfile.TemporaryDirectory(prefix="lodestone-")
            _own_dirs.append(own)
            atexit.register(own.cleanup)
        found = f"file://{_own_dirs[0].name}"
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables and files; it goes when this process ends."""
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def _drop(path: str) -> None:
    url = urlparse(path)
    if url.scheme in ("", "file"):
        shutil.rmtree(url.path, ignore_errors=True)
    elif (spark := SparkSession.getActiveSession()) is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_scratch() -> None:
    for path in _scratch:
        _drop(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once all that was computed from them is written too."""
    for t in tables:
        if (path := _written.pop(t, None)) is not None:
            _drop(path)
            _scratch.remove(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation beyond the stage that runs.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    # the job's shuffle files go once the driver has collected its plan
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most 4 MB, where the session has the default of 64 MB: texts are long, and tasks share memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, "4m")


def tidy(run):
    """``run`` for ``mapInArrow``, after which the worker gives freed memory back; it lives on beside the next task's JVM memory."""

    def wrapped(batches):
        yield from run(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass

    return wrapped


def crc_mod(column: str, n: int) -> Column:
    """``crc32`` of a column's text form, modulo ``n``; a null column counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def free_name(base: str, *taken: list[str]) -> str:
    """``base``, with underscores after it until no column of ``taken`` has that name (in any case)."""
    used = {c.lower() for names in taken for c in names}
    while base.lower() in used:
        base += "_"
    return base


def without_names(columns: list[str], new: list[str]) -> list[str]:
    """Columns to carry, less those whose name a new column takes."""
    off = {c.lower() for c in new}
    return [c for c in columns if c.lower() not in off]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for every vertex of an undirected graph.

    ``edges``: two columns ``a``, ``b`` of one orderable type. Returns ``(id, component)`` for each
    vertex with an edge. Alternates two steps until nothing changes: hang every larger neighbour of
    a vertex on its smallest neighbour, then hang a vertex's smaller neighbours on the smallest one.
    The number of rounds grows with the logarithm of the longest path. Each round is a written table,
    and only a count goes to the driver. Vertices of high degree need no more than partial minima.
    """
    spark = edges.sparkSession
    e = edges.select("a", "b").where("a <> b")
    cur = materialise(e.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), name)
    before = None
    for _ in range(max_rounds):
        both = cur.union(cur.select("m", "v"))
        low = both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("r"))
        # larger neighbours of v hang on v's smallest neighbour or itself
        large = both.where("m > v").join(low, "v").select(F.col("m").alias("v"), F.col("r").alias("m")).where("v <> m").distinct()
        low2 = large.groupBy("v").agg(F.min("m").alias("r"))
        small = large.join(low2, "v").select(F.col("m").alias("v"), F.col("r").alias("m")).where("v <> m")
        nxt = materialise(small.union(low2.select("v", F.col("r").alias("m"))).distinct(), name)
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        discard(cur)
        cur = nxt
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    done = cur.groupBy("v").agg(F.min("m").alias("component")).select(F.col("v").alias("id"), "component")
    roots = done.select(F.col("component").alias("id"), "component").distinct()
    return done.union(roots).distinct()
