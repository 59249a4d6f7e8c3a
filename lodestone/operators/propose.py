"""Which components are worth asking about together, and requests of bounded size for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..functions import paths as P
from . import edges as D
from .settle import discard, settle

#: Surfaces in one request, and how many components may share a token before it tells nothing.
PACK, COMMON = 40, 40


def by_name(c: Column, kind: DataType) -> Column:
    """A column with the fields of all structs within in the order of their names."""
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[by_name(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    return F.transform(c, lambda x: by_name(x, kind.elementType)) if isinstance(kind, ArrayType) else c


def tokens(surfaces: DataFrame) -> DataFrame:
    """``(token, id)``: what a component's surface names, and its own id, so that a mention meets the one mentioned.

    Ids are tokens whole and by their last segment; files by path and name. Tokens are lower-cased and belong to their field's
    family, so that a file read meets the same file written, but not a program of its name.
    """
    s = F.col("surface")
    low = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    named = lambda family, a: F.transform(a, lambda x: F.concat(F.lit(f"{family}:"), x))
    files = F.concat(low(s["consumes_files"]), low(s["produces_files"]))
    ids = F.concat(F.array(F.lower("id"), F.lower(P.basename(F.col("id")))), low(s["explicit_cross_component_mentions"]))
    every = F.concat(
        named("id", ids), named("file", F.concat(files, F.transform(files, P.basename))),
        named("net", low(s["network_endpoints"])), named("data", low(s["data_formats"])), named("tool", low(s["external_tools_spawned"])),
    )
    return surfaces.select("id", F.explode(F.array_distinct(every)).alias("token")).where("token not rlike ':$'").select("token", "id")


def blocks(index: DataFrame, common: int = COMMON) -> DataFrame:
    """``members`` (sorted ids) of each set of components that share a token of at most ``common`` components, each set once."""
    shared = index.groupBy("token").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= common))
    return index.join(shared.select("token"), "token").groupBy("token").agg(F.array_sort(F.collect_list("id")).alias("members")).select("members").distinct()


def coverage(index: DataFrame, common: int = COMMON) -> DataFrame:
    """One row: token pairs of components ``met`` in blocks, ``all`` of them, and ``recall``, their ratio (1 without any)."""
    n = index.groupBy("token").agg(F.count("*").alias("n")).select("n", (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    total = n.agg(F.coalesce(F.sum(F.when(F.col("n") <= common, F.col("pairs"))), F.lit(0.0)).alias("met"), F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("all"))
    return total.withColumn("recall", F.when(F.col("all") > 0, F.col("met") / F.col("all")).otherwise(1.0))


def packed(members: DataFrame, pack: int = PACK) -> DataFrame:
    """``(request, id)``: sets of ``members`` packed into requests of at most ``pack`` components, or of one set that is larger.

    Sets of one first member stand together; along the sets of a bucket, a request ends before the one that would overfill it
    even if no component were shared. Buckets are as many as keep the requests filled.
    """
    total = members.agg(F.sum(F.size("members"))).first()[0] or 0
    buckets = max(1, total // (16 * pack))
    at = F.pmod(F.xxhash64(F.element_at("members", 1)), F.lit(buckets))
    line = Window.partitionBy("_b").orderBy("members").rowsBetween(Window.unboundedPreceding, -1)
    half = max(1, pack // 2)
    # a request takes the sets that begin within one half of its size, and a set of at most the other half ends within it
    placed = members.withColumn("_b", at).withColumn("_s", F.coalesce(F.sum(F.size("members")).over(line), F.lit(0)))
    small = F.size("members") <= half
    name = F.when(small, F.concat_ws("-", F.lit("p"), F.col("_b").cast("string"), F.floor(F.col("_s") / half).cast("string"))).otherwise(F.concat_ws("-", F.lit("s"), F.col("_b").cast("string"), F.col("_s").cast("string")))
    return placed.select(name.alias("request"), F.explode("members").alias("id")).distinct()


def records(requests: DataFrame, surfaces: DataFrame) -> DataFrame:
    """``(request, inputs)``: the surfaces of each request's components, by id, as key-sorted JSON; ``surfaces(id, surface)``."""
    kind = surfaces.schema["surface"].dataType
    one = requests.join(surfaces, "id", "left").select("request", F.struct("id", by_name(F.col("surface"), kind).alias("surface")).alias("r"))
    grouped = one.groupBy("request").agg(F.array_sort(F.collect_list(F.struct(F.col("r.id").alias("id"), F.col("r.surface").alias("surface"))), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("SURFACE_RECORDS"))
    return grouped.select("request", F.to_json(F.struct("SURFACE_RECORDS")).alias("inputs"))


def requests_for(surfaces: DataFrame, pack: int = PACK, common: int = COMMON) -> DataFrame:
    """``(request, id)`` for a whole catalogue ``surfaces(id, surface)``: one request if it fits, none for fewer than two components, else blocks."""
    n = surfaces.limit(pack + 1).count()
    if n < 2:
        return surfaces.select(F.lit("").alias("request"), "id").where("1 = 0")
    if n <= pack:
        return surfaces.select(F.lit("all").alias("request"), "id")
    index = settle(tokens(surfaces))
    sets = settle(blocks(index, common))
    out = settle(packed(sets, pack))
    discard(index, sets)
    return out


def edges_of(answers: DataFrame) -> DataFrame:
    """Edges of ``answers(request, response)`` in canonical form, each once: the first in the order of requests and answers."""
    raw = answers.select("request", F.posexplode(D.parse_edges(F.col("response"))).alias("ord", "e")).select(F.struct("request", "ord").alias("ord"), "e.*")
    return D.dedup(D.valid(D.canonical(raw))).drop("ord")
