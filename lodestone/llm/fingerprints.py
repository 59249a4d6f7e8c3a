"""Document fingerprints: bottom-k sketches of word shingles.

A fingerprint holds the ``k`` least of a text's shingle hashes, 48 bits each, in ascending order, eight
characters a hash. Its letters ascend as their values do, so that fingerprints can be merged by comparing
strings: the least ``k`` of two sketches' union are the sketch of both texts' shingles. Sketches tell resemblance
(shared shingles of all), containment and the number of distinct shingles, exactly where a sketch holds fewer
than ``k`` hashes, for then it holds all.

Shingles are five words, white-space separated and lower-cased in A-Z; a text of fewer words has one, all
of them; a text without words has none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .ngram_join import ngrams
from .shared import bound_batches, free_name, materialise, text_or_empty, tidy, without_names

K = 256
WORDS = 5
BITS, CHARS = 48, 8
#: Letters of ascending code point, for six bits each.
_LETTERS = np.frombuffer(b"-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", np.uint8)
_SHIFTS = np.arange(BITS - 6, -1, -6, dtype=np.uint64)
#: Rows of a range of documents, on average; more ranges than this many are not made, they grow instead.
RANGE_ROWS, MOST_RANGES = 2048, 20_000
#: Sampled keys for each range, as for any sort by ranges.
_SAMPLES = 40


def sketches(column: pa.Array, k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """The ``k`` least distinct shingle hashes of each text, ascending."""
    buf, off = tk.utf8(column)
    out: list[np.ndarray] = []
    for lo, hi in tk.slices(off):
        for at in range(lo, hi, 1 << 16):
            to = min(hi, at + (1 << 16))
            g, row = ngrams(buf[off[at] : off[to]], off[at : to + 1] - off[at], words)
            # a row of 16 bits before a hash of 48: one sort for all texts
            key = np.unique((row.astype(np.uint64) << np.uint64(BITS)) | (g >> np.uint64(64 - BITS)))
            ends = np.r_[np.searchsorted(key, np.arange(to - at, dtype=np.uint64) << np.uint64(BITS)), len(key)]
            key &= np.uint64((1 << BITS) - 1)
            out += [key[s : min(e, s + k)] for s, e in zip(ends[:-1], ends[1:], strict=True)]
    return out


def to_text(sketch: np.ndarray) -> str:
    return _LETTERS[(sketch[:, None] >> _SHIFTS) & np.uint64(63)].tobytes().decode()


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated resemblance of the shingle sets; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    twice = np.zeros(len(both), bool)
    twice[1:] = both[1:] == both[:-1]
    last = np.cumsum(~twice) <= k  # of the union's k least
    return float(np.count_nonzero(twice & last) / min(k, np.count_nonzero(~twice)))


def fingerprints(documents: DataFrame, carry: list[str], k: int = K, words: int = WORDS, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``carry`` columns of each row and its ``name``; a null text counts as empty, whose fingerprint is ''.

    Equal texts have equal fingerprints. A new column takes the place of a carried one of its name.
    """
    bound_batches(documents.sparkSession)
    carry = without_names(carry, [name])
    kept = documents.select(*carry, text_or_empty(text_col).alias(inner := free_name("_text", carry)))

    def run(batches):
        for b in batches:
            marks = [to_text(s) for s in sketches(b.column(b.num_columns - 1), k, words)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(marks, pa.string())], names=[*b.schema.names[:-1], name])

    return kept.mapInArrow(tidy(run), kept.drop(inner).withColumn(name, F.lit("")).schema)


def hashes(mark: Column) -> Column:
    """The fingerprint's hashes as ascending strings."""
    n = F.floor(F.length(mark) / CHARS).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(mark, i * CHARS + 1, F.lit(CHARS)))).otherwise(F.array().cast("array<string>"))


def _least(a: Column, b: Column, k: int) -> Column:
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """``likeness`` of two columns of fingerprints; null if one is null."""
    x, y = hashes(a), hashes(b)
    union = _least(x, y, k)
    return F.when((a == "") & (b == ""), 1.0).otherwise(F.size(F.array_intersect(union, F.array_intersect(x, y))) / F.size(union))


def distinct_shingles(mark: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below ``k``; else (k - 1) over the greatest kept hash as a share of all."""
    n = F.floor(F.length(mark) / CHARS)
    last = F.substring(mark, -CHARS, CHARS)
    letters = _LETTERS.tobytes().decode()
    share = sum((F.instr(F.lit(letters), d) - 1).cast("double") * float(64 ** (CHARS - 1 - j)) for j, d in enumerate(F.substring(last, j + 1, 1) for j in range(CHARS)))
    return F.when(n < k, n.cast("double")).otherwise((k - 1) / ((share + 1) / float(1 << BITS)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s distinct shingles that ``b`` has; 1 for an empty ``a``."""
    x, y = hashes(a), hashes(b)
    union = F.array_join(_least(x, y, k), "")
    shared = resemblance(a, b, k) * distinct_shingles(union, k)
    return F.when(a == "", 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def merge(marked: DataFrame, by: list[str], k: int = K, name: str = "fingerprint") -> DataFrame:
    """One fingerprint for each group of rows, that of all their shingles. A group keeps ``k`` hashes in each task before any meet."""
    each = marked.where(F.col(name).isNotNull()).select(*by, F.explode_outer(hashes(F.col(name))).alias("_h")).distinct()
    ranked = each.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_h").asc_nulls_last()))).where(F.col("_r") <= k)
    return ranked.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("_h")), "").alias(name))


def _ranges(keys: DataFrame, order_col: str):
    """A function column of ``(order_col, _tie)``: the number of a row's range, ranges descending; and their number.

    Bounds come from a sample of the keys, a few for each range, as in any sort by ranges.
    """
    rows = keys.count()
    wanted = min(MOST_RANGES, max(1, -(-rows // RANGE_ROWS)))
    share = min(1.0, 1.2 * _SAMPLES * wanted / max(1, rows))
    got = keys.where(F.pmod(F.xxhash64(order_col, "_tie"), F.lit(1 << 20)) <= F.lit(int(share * (1 << 20)))).where(F.col(order_col).isNotNull()).toPandas()
    got = got.sort_values([order_col, "_tie"], ascending=False)
    at = np.unique(np.arange(1, wanted) * len(got) // max(1, wanted)) if len(got) else np.zeros(0, int)
    ids, ties = -got[order_col].to_numpy(np.int64)[at], -got["_tie"].to_numpy(np.int64)[at]

    def number(col: pd.Series, tie: pd.Series) -> pd.Series:
        none = col.isna().to_numpy()
        v, t = -col.fillna(0).to_numpy(np.int64), -tie.to_numpy(np.int64)
        lo, hi = np.searchsorted(ids, v, "left"), np.searchsorted(ids, v, "right")
        for a, b in {(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b > a}:
            own = (lo == a) & (hi == b)
            lo[own] = a + np.searchsorted(ties[a:b], t[own], "right")
        lo[none] = len(ids)
        return pd.Series(lo.astype(np.int32))

    return F.pandas_udf(number, "int")(F.col(order_col).cast("long"), F.col("_tie")), wanted


def beside_next(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """Each row's fingerprint, and that of its text with its second half replaced by the next document's beginning.

    The next document is the one of the next lower integer id; after the least comes the greatest, nulls stand
    last, and equal ids stand by a hash of their text, so that only rows equal in both may swap places. Of a text of n
    code points the last floor(n/2) are replaced by as many of the next text's first ones, or all it has. Null texts are empty.
    Returns the id, ``n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. An only row is its own
    next. An empty table gives no rows.

    Texts are shuffled once, into ranges of ids, and sorted within a task's memory or on its disk; a task holds
    two batches. A range ends with a copy of the next range's first row, which is only looked at.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    base = documents.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    # 63 bits, so that the sign can be turned
    tie = F.shiftrightunsigned(F.xxhash64("_text"), 1).alias("_tie")
    keys = materialise(base.select("_id", tie), "keys")
    number, ranges = _ranges(keys, "_id")
    down = [F.col("_id").desc_nulls_last(), F.col("_tie").desc()]
    firsts = keys.withColumn("_range", number).withColumn("_r", F.row_number().over(Window.partitionBy("_range").orderBy(*down))).where("_r = 1")
    # one row a range; the last range is followed by the first
    heads = [(r["_range"], r["_id"], r["_tie"]) for r in firsts.select("_range", "_id", "_tie").orderBy("_range").collect()]
    peeks = spark.createDataFrame([(heads[i - 1][0], h[1], h[2]) for i, h in enumerate(heads)], "_range int, _pid long, _ptie long")
    here = base.select("_id", tie, "_text")
    ahead = here.join(F.broadcast(peeks), F.col("_id").eqNullSafe(F.col("_pid")) & (F.col("_tie") == F.col("_ptie"))).dropDuplicates(["_range"])
    flagged = here.withColumn("_range", number).select("_range", F.lit(0).alias("_peek"), "_id", "_tie", "_text").unionByName(ahead.select("_range", F.lit(1).alias("_peek"), "_id", "_tie", "_text"))
    dealt = flagged.repartition(max(1, ranges), "_range").sortWithinPartitions("_range", "_peek", *down).select("_range", "_peek", "_id", "_text")
    new = [("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]

    def run(batches):
        held = None  # the row whose next one isn't known yet, with its sketch
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                ids, texts = part.column(2).to_pylist(), part.column(3).to_pylist()
                rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), ids, texts, sketches(part.column(3), k, words), strict=True))
                rows = rows if held is None else [held, *rows]
                held = rows[-1]
                pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[1]]
                edited = [x[3][: len(x[3]) - len(x[3]) // 2] + y[3][: len(x[3]) // 2] for x, y in pairs]
                after = sketches(pa.array(edited, pa.large_string()), k, words)
                columns = [[x[2] for x, _ in pairs], [len(x[3]) for x, _ in pairs], [hashlib.sha256(t.encode()).hexdigest() for t in edited], [to_text(x[4]) for x, _ in pairs], [to_text(s) for s in after]]
                columns += [[likeness(x[4], s, k) for (x, _), s in zip(pairs, after, strict=True)], [likeness(x[4], y[4], k) for x, y in pairs]]
                yield tk.one_batch([id_col, *[n for n, _ in new]], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], columns)

    kind = dict(documents.dtypes)[id_col]
    out = dealt.mapInArrow(tidy(run), ", ".join(f"`{n}` {t}" for n, t in [(id_col, "long"), *new]))
    return out if kind == "bigint" else out.withColumn(id_col, F.col(id_col).cast(kind))
