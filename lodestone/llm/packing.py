"""Best-fit packing by best-two-fit: documents' token ids into sequences of bounded length.

Only lengths matter to the packing, and there are at most ``capacity`` of them. So executors
tokenise and count pieces by length; the driver packs the histogram (at most ``capacity`` numbers,
whatever the corpus); pieces then find their sequence by their rank among pieces of their length.

A bin is filled greedily, always with the longest piece that fits. If a gap stays, its smallest
piece is replaced by two unpacked ones that fit the expanded gap more tightly. While the counts allow
it, the next bins would come out the same, so one step packs them all; each step uses up a length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, text_or_empty, tidy
from .tokenizing import encoder


@dataclass(frozen=True)
class Pattern:
    """``count`` bins that hold pieces of these ``lengths``, in order."""

    lengths: tuple[int, ...]
    count: int


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Pack pieces, given as counts by length (1 to ``capacity``), into bins."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(not 1 <= n <= capacity for n in left):
        raise ValueError("lengths must be between 1 and the capacity")
    there = sorted(left)
    out: list[Pattern] = []
    while there:
        gross: Counter[int] = Counter()
        free = lambda n: left[n] - gross[n]
        items: list[int] = []
        gap = capacity
        while gap > 0:
            at = bisect.bisect_right(there, gap) - 1
            while at >= 0 and free(there[at]) <= 0:
                at -= 1
            if at < 0:
                break
            n = there[at]
            times = min(free(n), gap // n)
            items += [n] * times
            gross[n] += times
            gap -= n * times
        net = gross.copy()
        while gap > 0:
            small = items[-1]
            room = gap + small
            best, pair = small, None
            lo, hi = 0, bisect.bisect_right(there, room) - 1
            while lo <= hi and best < room:
                a, b = there[lo], there[hi]
                if free(a) < (2 if a == b else 1):
                    lo += 1
                elif free(b) < (2 if a == b else 1):
                    hi -= 1
                elif a + b > room:
                    hi -= 1
                else:
                    if a + b > best:
                        best, pair = a + b, (b, a)
                    lo += 1
            if pair is None:
                break
            items.pop()
            items += pair
            items.sort(reverse=True)
            net[small] -= 1
            net.update(pair)
            gross.update(pair)
            gap = room - best
        # as often as every length, before each bin, still has what the bin looked at
        often = min((left[n] - gross[n]) // net[n] + 1 for n in gross if net[n] > 0)
        for n, c in net.items():
            if c:
                left[n] -= c * often
                if not left[n]:
                    there.remove(n)
        out.append(Pattern(tuple(items), often))
    return out


def tokenized_pieces(documents: DataFrame, carry: list[str], capacity: int = 1024, eos: int = 2, tokenizer: str | None = None, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``carry`` columns with ``piece, start, length, ids_crc32`` (and ``ids``) for each piece of each row.

    A document is its text's ids and ``eos``; a null text is the empty one, thus a piece of one id.
    Longer ones than ``capacity`` are cut into pieces of that length, the first of which takes the remainder.
    """
    kept = documents.select(*carry, text_or_empty(text_col).alias("_text"))
    fields = [(c, t) for c, t in kept.dtypes[:-1]] + [("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint")] + [("ids", "array<int>")] * with_ids

    def run(batches):
        encode = encoder(tokenizer)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, text in enumerate(part.column(part.num_columns - 1)):
                    got = np.array([*encode(text.as_py()), eos], "<u4")
                    at, n = 0, len(got) % capacity or min(capacity, len(got))
                    j = 0
                    while at < len(got):
                        own = got[at : at + n]
                        rows.append(k)
                        piece.append(j)
                        start.append(at)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            ids.append(own.astype(np.int32))
                        at, n, j = at + n, capacity, j + 1
                pick = pa.array(rows, pa.int64())
                arrays = [c.take(pick) for c in part.columns[:-1]] + [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=[f[0] for f in fields])

    return kept.mapInArrow(tidy(run), ", ".join(f"`{c}` {t}" for c, t in fields))


def assign_sequences(pieces: DataFrame, capacity: int = 1024, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """``pieces`` (any columns with ``length``) with ``sequence_id`` and ``offset``.

    ``pieces`` is read three times, so hand in a written table. ``order`` columns name a piece; where
    rows agree in them all they may swap places, which changes nothing. Ranks within a length are
    formed in two levels, bucket counts and rows of a bucket, so that a length that a third of all
    pieces share is dealt to many tasks.
    """
    spark = pieces.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, base = [], 0
    seen: Counter[int] = Counter()
    for p in best_two_fit(histogram, capacity):
        offsets: dict[int, list[int]] = {}
        at = 0
        for n in p.lengths:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, offs in offsets.items():
            rows.append((n, seen[n], seen[n] + len(offs) * p.count, base, offs))
            seen[n] += len(offs) * p.count
        base += p.count
    # at most one row for each length and step: bounded by the capacity, not by the data
    plan = spark.createDataFrame(rows, "length long, _from long, _to long, _base long, _offsets array<long>")
    buckets = spark.createDataFrame([(n, max(1, int(c**0.5))) for n, c in sorted(histogram.items())], "length long, _buckets long")
    keyed = pieces.join(F.broadcast(buckets), "length").withColumn("_key", F.xxhash64(*order)).withColumn("_bucket", F.pmod("_key", "_buckets"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = keyed.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_key", *order))).join(starts, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_first") + F.col("_row") - 1)
    hit = ranked.alias("r").join(F.broadcast(plan).alias("p"), (F.col("r.length") == F.col("p.length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    k, uses = F.col("_rank") - F.col("_from"), F.size("_offsets")
    return hit.select(*[F.col(f"r.{c}") for c in pieces.columns], (F.col("_base") + F.floor(k / uses)).cast("long").alias("sequence_id"), F.element_at("_offsets", (k % uses + 1).cast("int")).cast("long").alias("offset"))


def pack(documents: DataFrame, capacity: int = 1024, eos: int = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all rows of ``documents``; one row for each piece: id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    An empty table gives an empty result. Repeated rows are packed as often as they occur.
    A null text is the empty one, a piece of its end token; texts of any length are packed whole; pieces of one length may stand in any
    order. ``id_col`` must not have the name of another column of the result; other columns aren't read.
    """
    pieces = materialise(tokenized_pieces(documents, [id_col], capacity, eos, tokenizer, text_col, with_ids), "pieces")
    return assign_sequences(pieces, capacity, (id_col, "piece", "ids_crc32"))
