"""Comparing the items that meet under a key, without emitting pairs.

Near-duplicate search ends alike for texts and vectors: each item stands under several keys, and
items that meet under a key are compared exactly. A pair may meet under several keys, so each pair has
one *canonical* key, a function of the two items' signatures; only there is it counted. Groups of any
size are cut into blocks of bounded rows and bytes, and each pair of blocks goes to a task of its own; no task
gathers a group. What leaves a
group is linear in its items: for every item, how many it links with, and the least item that it
reaches within the block pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, tidy

BLOCK = 512
BLOCK_BYTES = 8 << 20
#: Groups of more items than this skip the search for canonical partners; all of their items go on, straight from the shuffle.
FLAG_MOST = 512


def key_groups(batches, n_keys: int) -> Iterator[pa.Table]:
    """Groups of equal leading columns (longs, sorted) as tables, each whole."""
    parts: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if b.num_rows == 0:
            continue
        k = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)], axis=1)
        cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), b.num_rows]
        for lo, hi in zip(cut, cut[1:], strict=False):
            now = tuple(k[lo])
            if parts and now != last:
                yield pa.Table.from_batches(parts)
                parts = []
            parts.append(b.slice(lo, hi - lo))
            last = now
    if parts:
        yield pa.Table.from_batches(parts)


def colliding(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``keyed`` whose ``key`` has at least two rows, with their number ``n``; and the written table of these numbers.

    A written table has a known size: while it is small, rows meet it where they are, and beyond, the join's
    skewed partitions can be split, which they can't beside an aggregation.
    """
    shared = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    return keyed.join(shared, "key"), shared


def with_partner(keyed: DataFrame, item: str, canonical: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], signature: str, width: int) -> DataFrame:
    """Rows ``(key, pos, item, signature)`` that have a canonical partner under their key; ``keyed`` has their number ``n``.

    ``canonical(a, b, pos)`` tells for signature matrices [n, width] and [m, width] which pairs belong to
    key position ``pos``. Only groups of up to ``FLAG_MOST`` rows meet in a worker; larger ones go on whole,
    which changes no result.
    """
    columns = ["key", "pos", item, signature]

    def run(batches):
        for t in key_groups(batches, 1):
            if t.num_rows < 2:
                continue
            t = t.combine_chunks()
            sig = signatures(t.column(3), width)
            pos = t.column(1)[0].as_py()
            hit = np.zeros(len(sig), bool)
            for lo in range(0, len(sig), 256):
                ok = canonical(sig[lo : lo + 256], sig, pos)
                ok[np.arange(ok.shape[0]), np.arange(ok.shape[0]) + lo] = False
                hit[lo : lo + 256] |= ok.any(axis=1)
            if hit.any():
                yield from t.filter(pa.array(hit)).to_batches()

    small = keyed.where(F.col("n") <= FLAG_MOST).select(*columns)
    met = small.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), small.schema)
    return met.union(keyed.where(F.col("n") > FLAG_MOST).select(*columns))


def signatures(column, width: int) -> np.ndarray:
    """Binary signatures as a matrix of unsigned 64-bit numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, width)


def components_of(link: np.ndarray) -> np.ndarray:
    """Index of the least item that each item of a symmetric link matrix reaches."""
    label = np.arange(len(link))
    while True:
        low = np.where(link, label[None, :], len(link)).min(axis=1, initial=len(link))
        new = np.minimum(label, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def compare_blocks(members: DataFrame, item: str, width: int, canonical: Callable, linked: Callable[[list], np.ndarray], block: int | None = None) -> DataFrame:
    """``(item, links, root)`` for items with a link.

    ``members``: ``key, pos, item, signature, copies, payload``. ``linked(payloads)`` gives the symmetric
    boolean matrix of which payloads are near each other. ``links`` is the sum of the partners'
    ``copies`` over the pairs counted here; an item may have several rows, to be summed up. All pairs of a
    group are compared, since all of their links count; blocks bound what a task holds of it.
    """
    blocks = F.greatest(F.ceil(F.count("*") / (block or BLOCK)), F.ceil(F.sum(F.octet_length("payload")) / BLOCK_BYTES))
    # a written table of the few large groups; beside an aggregation the join's skewed partitions couldn't be split
    large = materialise(members.groupBy("key").agg(blocks.alias("_nb")).where(F.col("_nb") > 1), "large")
    m = members.join(large, "key", "left").withColumn("_nb", F.coalesce("_nb", F.lit(1)))
    m = m.withColumn("_my", F.pmod(F.xxhash64(item), "_nb")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)))
    m = m.select("key", F.least("_my", "_other").alias("_lo"), F.greatest("_my", "_other").alias("_hi"), F.col("_my").alias("_side"), "pos", item, "signature", "copies", "payload")

    def run(batches):
        for t in key_groups(batches, 3):
            if t.num_rows < 2:
                continue
            lo, hi = t.column(1)[0].as_py(), t.column(2)[0].as_py()
            sig = signatures(t.column(6), width)
            link = linked(t.column(8).to_pylist())
            pos = t.column(4)[0].as_py()
            for a in range(0, len(sig), 256):
                link[a : a + 256] &= canonical(sig[a : a + 256], sig, pos)
            np.fill_diagonal(link, False)
            if lo != hi:
                side = t.column(3).to_numpy()
                link &= side[:, None] != side[None, :]
            has = link.any(axis=1)
            if has.any():
                items = t.column(5).to_pylist()
                order = np.array(sorted(range(len(items)), key=items.__getitem__))
                root = np.empty(len(items), int)
                root[order] = order[components_of(link[np.ix_(order, order)])]
                copies = t.column(7).to_numpy()
                total = link.astype(np.float64) @ copies
                at = np.flatnonzero(has)
                yield pa.RecordBatch.from_arrays([pa.array([items[i] for i in at], pa.binary()), pa.array(total[at].astype(np.int64)), pa.array([items[root[i]] for i in at], pa.binary())], names=[item, "links", "root"])

    keys = ["key", "_lo", "_hi"]
    return m.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), f"{item} binary, links bigint, root binary")
