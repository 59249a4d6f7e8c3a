"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact reranking.

A rotation is learnt on a bounded sample so that the signs of rotated unit vectors make balanced binary
codes (alternating between codes and the orthogonal Procrustes solution). A code is cut into chunks; each pair of
chunks is a table, so two codes that agree in two chunks surely meet. The number of vectors decides the chunks'
width, so that buckets don't grow with it; with eight chunks of eight bits, twelve of twelve or sixteen of sixteen, two
vectors at cosine 0.98 meet in some table with a probability of about 0.99. Vectors that meet are compared by their
original components in double precision. A pair is counted in the first table in which it meets.

Only vectors of one label and one dimension are compared. Equal vectors of one label form a class
from the start.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .collide import colliding, compare_blocks, with_partner
from .shared import connected_components, discard, materialise, tidy

@dataclass(frozen=True)
class ItqParams:
    """``sample`` and ``sample_bytes`` bound the vectors on which the rotation is learnt; all vectors are coded.

    ``shape``: chunks and bits of a chunk; chosen by the number of vectors where it isn't given.
    """

    threshold: float = 0.98
    sample: int = 10_000
    sample_bytes: int = 64 << 20
    rounds: int = 30
    shape: tuple[int, int] | None = None


def code_shape(vectors: int) -> tuple[int, int]:
    """Chunks and bits of a chunk for so many vectors: two chunks tell a few hundred vectors a bucket apart at most."""
    return (8, 8) if vectors <= 1 << 24 else (12, 12) if vectors <= 1 << 32 else (16, 16)


def tables_of(chunks: int) -> list[tuple[int, int]]:
    return list(combinations(range(chunks), 2))


def usable(column: str) -> Column:
    """Vectors that take part: not null or empty, all components finite numbers, not all zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def learn_rotation(x: np.ndarray, rounds: int, total: int = 64) -> np.ndarray:
    """Orthogonal maps [dim, total], of up to 64 directions each, whose signs are balanced codes of unit vectors.

    The leading principal directions are kept; where these are fewer than ``total``, independent rotations fill the code.
    """
    d = x.shape[1]
    rng = np.random.Generator(np.random.PCG64(64))
    vt = np.linalg.eigh(x.T @ x)[1][:, ::-1].T
    parts, left = [], total
    while left > 0:
        keep = min(d, left, 64)
        base = vt[:keep].T
        v = x @ base
        r, _ = np.linalg.qr(rng.normal(size=(keep, keep)))
        for _ in range(rounds if len(x) >= keep else 0):
            u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ wt).T
        parts.append(base @ r)
        left -= keep
    return np.concatenate(parts, axis=1)


def codes(x: np.ndarray, rotation: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Chunks [len(x), chunks] of each vector's code."""
    signs = (x @ rotation >= 0).reshape(len(x), *shape)
    return (signs @ (1 << np.arange(shape[1]))).astype(np.uint16)


def first_table(a: np.ndarray, b: np.ndarray, pos: int, tables: list[tuple[int, int]]) -> np.ndarray:
    """Pairs of codes whose first two equal chunks are those of table ``pos``."""
    i, j = tables[pos]
    a, b = np.ascontiguousarray(a).view(np.uint16), np.ascontiguousarray(b).view(np.uint16)
    ok = (a[:, None, i] == b[None, :, i]) & (a[:, None, j] == b[None, :, j])
    for k in range(j):
        if k != i:
            ok &= a[:, None, k] != b[None, :, k]
    return ok


def near_vectors(payloads: list[bytes], threshold: float) -> np.ndarray:
    """Which vectors have at least the threshold's cosine.

    A matrix product rounds by its shape, so pairs on the edge are taken again one by one: a pair links in all blocks or in none.
    """
    x = np.frombuffer(b"".join(payloads), np.float64).reshape(len(payloads), -1)
    norm = np.sqrt((x * x).sum(axis=1))
    cosine = (x @ x.T) / (norm[:, None] * norm[None, :])
    near = cosine >= threshold
    i, j = np.nonzero(np.abs(cosine - threshold) < 1e-9)
    for lo in range(0, len(i), 4096):
        a, b = i[lo : lo + 4096], j[lo : lo + 4096]
        near[a, b] = (x[a] * x[b]).sum(axis=1) / (norm[a] * norm[b]) >= threshold
    return near


def near_duplicates(vectors: DataFrame, params: ItqParams = ItqParams(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id_col, n_links, component_id, kept`` for each row of ``vectors``.

    Rows whose vector can't take part (null, empty, zero, null or non-finite components) or whose label
    is null link with nothing and are components of their own. ``n_links`` counts rows; ``component_id``
    is the smallest id reachable over links. Repeated rows and equal vectors of one label link with each
    other; of repeated ids all rows are marked as kept if one is. Null ids are left aside when the smallest is
    chosen; a component of nothing else has a null id and is kept. An empty table gives no rows. Other columns are not read, so their
    names don't matter.
    """
    threshold = params.threshold
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    good = usable("v") & F.col("label").isNotNull()
    node = F.unhex(F.md5(F.encode(F.concat_ws("|", F.col("label").cast("string"), F.array_join("v", ",")), "utf-8")))
    signed = materialise(rows.select("id", "label", "v", F.when(good, node).alias("node")), "vectors")
    classes = materialise(signed.where("node is not null").groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("label").cast("string").alias("label"), F.first("v").alias("v")), "classes")

    dims = {r["d"]: r["n"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    main = max(dims, key=lambda d: (dims[d], d)) if dims else 0
    chunks, bits = params.shape or code_shape(sum(dims.values()))
    tables = tables_of(chunks)
    rotation = None
    if main:
        most = max(1, min(params.sample, params.sample_bytes // (8 * main)))
        drawn = classes.where(F.size("v") == main).orderBy("node").select("v").limit(most).toArrow().column(0).combine_chunks()
        x = drawn.flatten().to_numpy(zero_copy_only=False).reshape(-1, main)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        rotation = learn_rotation(x / np.linalg.norm(x, axis=1, keepdims=True), params.rounds, chunks * bits)
    shared = vectors.sparkSession.sparkContext.broadcast((main, rotation))
    words = chunks // 4

    def canonical(a: np.ndarray, b: np.ndarray, pos: int) -> np.ndarray:
        return first_table(a, b, pos, tables)

    def table_keys(batches):
        main, rotation = shared.value
        maps = {main: rotation}
        for b in batches:
            vs = [np.array(v, np.float64) for v in b.column(2).to_pylist()]
            raw = np.empty((len(vs), chunks), np.uint16)
            for d in sorted({len(v) for v in vs}):
                at = [i for i, v in enumerate(vs) if len(v) == d]
                if d not in maps:  # a rare dimension: a seeded rotation without learning
                    maps[d] = learn_rotation(np.eye(d), 0, chunks * bits)
                y = np.stack([vs[i] for i in at])
                raw[at] = codes(y / np.abs(y).max(axis=1, keepdims=True), maps[d], (chunks, bits))
            salt = np.array([hash_label(s) for s in b.column(1).to_pylist()], np.uint64) ^ np.array([len(v) for v in vs], np.uint64)
            wide = raw.astype(np.uint64)
            key = np.stack([tk.pair(tk.mix(salt + np.uint64(t)), wide[:, i] * np.uint64(65536) + wide[:, j]) for t, (i, j) in enumerate(tables)], axis=1)
            n = len(vs)
            pick = pa.array(np.repeat(np.arange(n), len(tables)))
            sig = pa.array([c.tobytes() for c in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(len(tables), dtype=np.int32), n)), b.column(0).take(pick), sig.take(pick)], names=["key", "pos", "node", "signature"])

    keyed = materialise(classes.select("node", "label", "v").mapInArrow(tidy(table_keys), "key bigint, pos int, node binary, signature binary"), "keyed")
    met, counts = colliding(keyed)
    wanted = materialise(with_partner(met, "node", canonical, "signature", words), "wanted")
    discard(keyed, counts)

    def payload(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.array(v, np.float64).tobytes() for v in b.column(2).to_pylist()], pa.binary())], names=["node", "copies", "payload"])

    packed = classes.select("node", "copies", "v").join(wanted.select("node").distinct(), "node", "left_semi").mapInArrow(tidy(payload), "node binary, copies bigint, payload binary")
    members = wanted.join(packed, "node").select("key", "pos", "node", "signature", "copies", "payload")
    found = materialise(compare_blocks(members, "node", words, canonical, lambda p: near_vectors(p, threshold)), "links")
    discard(wanted)
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    info = classes.select("node", "rep", "copies").join(links, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = info.groupBy("component").agg(F.min("rep").alias("head"))
    info = info.join(heads, "component").select("node", "head", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    out = signed.select("id", "node").join(info, "node", "left")
    head = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("head"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), head.cast(dict(rows.dtypes)["id"]).alias("component_id"), F.col("id").eqNullSafe(head).alias("kept"))


def hash_label(label: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(label)
