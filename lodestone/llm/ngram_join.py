"""N-gram Jaccard join: MinHash banding, then exact verification on the full n-gram sets.

Band and row counts are chosen for a target recall at the threshold. Texts with equal n-gram sets form
one class from the start, so copies meet no comparison. Classes are shuffled on their band hashes;
where some meet, their whole n-gram sets are compared, in blocks. A pair that meets in several bands is
counted in the first. Documents linked directly or over others form a group.

Words are white-space separated and lower-cased in A-Z. A text of fewer than five words has one
n-gram, all of its words; an empty or null text has none and links with nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .collide import colliding, compare_blocks, with_partner
from .shared import connected_components, discard, materialise, text_or_empty, tidy


@dataclass(frozen=True)
class JoinParams:
    n: int = 5
    threshold: float = 0.8
    recall: float = 0.9999
    most_hashes: int = 128


def choose_bands(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """Bands and rows: as many rows a band as the hash budget allows at the target recall.

    A pair of similarity s meets in a band of r rows with probability s^r, so b bands miss it with
    probability (1 - s^r)^b; more rows spare comparisons of pairs below the threshold.
    """
    best = None
    for rows in range(1, 17):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("the hash budget is too small for this recall")
    return best


def ngrams(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram hashes and their rows, with repeats, in row order."""
    h, row = tk.words(buf, off)
    rows = len(off) - 1
    count = np.bincount(row, minlength=rows)
    short = (count > 0) & (count < n)
    first = np.cumsum(count) - count
    total = len(h)
    whole = np.zeros(max(0, total - n + 1), bool)
    if len(whole):
        whole = row[n - 1 :] == row[: total - n + 1]
    g = np.zeros(len(whole), np.uint64)
    for k in range(n):
        g = tk.mix(g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(whole)])
    g, r = g[whole], row[: len(whole)][whole]
    if short.any():
        at = np.flatnonzero(short)
        extra = np.zeros(len(at), np.uint64)
        for k in range(n - 1):
            more = count[at] > k
            extra[more] = tk.mix(extra[more] * np.uint64(0x9E3779B97F4A7C15) + h[first[at[more]] + k])
        g, r = np.concatenate([g, tk.mix(extra + count[at].astype(np.uint64))]), np.concatenate([r, at])
        order = np.argsort(r, kind="stable")
        g, r = g[order], r[order]
    return g, r


def _multipliers(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(1234))
    return rng.integers(0, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, hashes, dtype=np.uint32)


def band_hashes(g: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes [segments, bands] of the n-gram segments that begin at ``starts``."""
    mul, add = _multipliers(bands * rows)
    x = (g >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(starts), b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            acc = tk.mix(acc * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x * mul[k] + add[k], starts))
        out[:, b] = acc
    return out


def first_common(a: np.ndarray, b: np.ndarray, pos: int) -> np.ndarray:
    """Pairs whose first equal band is band ``pos``."""
    ok = a[:, None, pos] == b[None, :, pos]
    for k in range(pos):
        ok &= a[:, None, k] != b[None, :, k]
    return ok


def near_sets(sets: list[bytes], threshold: float) -> np.ndarray:
    """Which of these n-gram sets (sorted unique hashes) have at least the threshold's Jaccard similarity."""
    arrays = [np.frombuffer(s, np.uint64) for s in sets]
    size = np.array([len(a) for a in arrays])
    owner = np.repeat(np.arange(len(arrays)), size)
    values, column, often = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    both = np.zeros((len(arrays), len(arrays)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width, top = 4096, int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, top, width):
        a, z = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(arrays), min(width, top - lo)), np.float32)
        m[owner[a:z], column[a:z] - lo] = 1
        both += m @ m.T
    either = size[:, None] + size[None, :] - both
    return both >= threshold * either - 1e-9


def near_duplicates(documents: DataFrame, params: JoinParams = JoinParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_links, component_id, kept`` for each row of ``documents``.

    ``n_links`` counts the other rows of similarity at or above the threshold, copies included;
    ``component_id`` is the smallest id that is reachable over links; ``kept`` marks the row that
    stands for its group (of repeated equal rows all are marked). Null ids are allowed and sort first.
    An empty table gives no rows. Other columns are not read, so their names don't matter. Of equal similarities
    none goes before another: all links count. A text of any length is compared whole; one task holds its set of n-grams.
    """
    return _flagged(documents, params, id_col, text_col).select(F.col("id").alias(id_col), "n_links", "component_id", "kept")


def drop_near_duplicates(documents: DataFrame, params: JoinParams = JoinParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all columns of ``documents``; rows equal in id and text count as one.

    Null texts are empty ones, which are near nothing and stay. An empty table gives no rows.
    """
    stay = _flagged(documents, params, id_col, text_col).where("kept").select(F.col("id").alias("_id"), F.col("th").alias("_kept")).distinct()
    # all columns travel as one, so that their names don't matter
    docs = documents.select(F.struct(*documents.columns).alias("_d"), F.col(id_col).alias("_i"), F.xxhash64(text_or_empty(text_col)).alias("_h"))
    joined = docs.join(stay, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_kept")), "left_semi")
    return joined.dropDuplicates(["_i", "_h"]).select("_d.*")


def _flagged(documents: DataFrame, params: JoinParams, id_col: str, text_col: str) -> DataFrame:
    """``id, th`` (hash of the text), ``n_links, component_id, kept`` for each row."""
    bands, rows = choose_bands(params.threshold, params.recall, params.most_hashes)
    n, threshold = params.n, params.threshold
    docs = documents.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("th", F.xxhash64("text"))

    def sets_of(column):
        """For each row its distinct n-grams, slice by slice: (first row, list of arrays)."""
        buf, off = tk.utf8(column)
        for lo, hi in tk.slices(off):
            g, r = ngrams(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)
            cut = np.searchsorted(r, np.arange(hi - lo + 1))
            yield lo, [np.unique(g[cut[i] : cut[i + 1]]) for i in range(hi - lo)]

    def print_of(s: np.ndarray) -> bytes | None:
        if not len(s):
            return None
        with np.errstate(over="ignore"):
            return np.array([tk.mix(s).sum(), tk.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(s))], ">u8").tobytes()

    def sign(batches):
        for b in batches:
            fp: list[bytes | None] = []
            sig: list[bytes | None] = []
            for _, sets in sets_of(b.column(2)):
                full = [i for i, s in enumerate(sets) if len(s)]
                got = [None] * len(sets)
                if full:
                    size = np.array([len(sets[i]) for i in full])
                    hashed = band_hashes(np.concatenate([sets[i] for i in full]), np.cumsum(size) - size, bands, rows)
                    for i, v in zip(full, hashed, strict=True):
                        got[i] = v.tobytes()
                fp += [print_of(s) for s in sets]
                sig += got
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], names=["id", "th", "fp", "signature"])

    kind = dict(docs.dtypes)["id"]
    signed = materialise(docs.select("id", "th", "text").mapInArrow(tidy(sign), f"id {kind}, th bigint, fp binary, signature binary"), "signed")
    classes = materialise(signed.where("fp is not null").groupBy("fp").agg(F.min(F.struct("id", "th")).alias("rep"), F.count("*").alias("copies"), F.first("signature").alias("signature")), "classes")

    @F.pandas_udf("array<bigint>")
    def band_keys(s):
        return s.map(lambda v: np.frombuffer(v, np.int64))

    keyed = classes.select("fp", "signature", F.posexplode(band_keys("signature")).alias("pos", "key"))
    slim, counts = colliding(keyed.select("key", "pos", "fp"))
    met = slim.join(classes.select("fp", "signature"), "fp")
    wanted = materialise(with_partner(met, "fp", first_common, "signature", bands), "wanted")

    discard(counts)
    # n-gram sets of the classes that met, from one text of each
    reps = wanted.select("fp").distinct().join(classes, "fp").select(F.col("rep.id").alias("rid"), F.col("rep.th").alias("rth"))
    texts = docs.join(reps, docs["id"].eqNullSafe(F.col("rid")) & (docs["th"] == F.col("rth")), "left_semi").select("text")

    def payloads(batches):
        for b in batches:
            for _, sets in sets_of(b.column(0)):
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([print_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "payload"])

    sets = materialise(texts.mapInArrow(tidy(payloads), "fp binary, payload binary").groupBy("fp").agg(F.first("payload").alias("payload")), "sets")
    members = wanted.join(classes.select("fp", "copies"), "fp").join(sets, "fp").select("key", "pos", "fp", "signature", "copies", "payload")
    found = materialise(compare_blocks(members, "fp", bands, first_common, lambda p: near_sets(p, threshold)), "links")
    discard(wanted, sets)
    groups = connected_components(found.select(F.col("fp").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "fp")
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    info = classes.select("fp", "rep", "copies").join(links, "fp", "left").join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    heads = info.groupBy("component").agg(F.min(F.struct(F.col("rep.id").alias("id"), F.col("fp"), F.col("rep.th").alias("th"))).alias("head"))
    info = info.join(heads, "component").select("fp", "head", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    out = signed.select("id", "th", "fp").join(info, "fp", "left")
    own = F.col("fp").isNull()
    return out.select(
        "id",
        "th",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.when(own, F.col("id")).otherwise(F.col("head.id")).alias("component_id"),
        (own | (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("fp") == F.col("head.fp")) & (F.col("th") == F.col("head.th")))).alias("kept"),
    )
