"""Charging sessions of any length against a limit, in several tasks a session.

Charges are made in order; one that goes over the limit is rejected and leaves the count, so a running sum can't tell
what is accepted. But what is left only shrinks. While it lies between a power of two and the next one, smaller
charges all fit, larger ones don't, and of those in between the first that fits ends the level, as does
the charge that brings what is left below the power. So a piece of a session is summed up, for each level, by two numbers: the sum of
its small charges, and the least that has to be left for one in between to fit. Where neither ends the level, the piece is
passed over by an addition; a session has at most as many other pieces as the limit has bits.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructType

from ..operators.settle import settle


def charge(costs: list[int], limit: int, used: int) -> tuple[list[bool], list[int]]:
    """Which of ``costs`` are accepted, and what is used after each."""
    ok, after = [], []
    for c in costs:
        fits = used + c <= limit
        if fits:
            used += c
        ok.append(fits)
        after.append(used)
    return ok, after


class Levels:
    """A piece of a session by levels: ``sums`` of the charges below 2^k, ``least`` of what must be left for one from 2^k to 2^(k+1) to fit.

    Both are cut at one above the limit, where they mean the same as any larger number.
    """

    def __init__(self, limit: int):
        self.over = max(limit, 0) + 1
        self.sums = [0] * max(limit, 0).bit_length()
        self.least = [self.over] * len(self.sums)

    def add(self, costs: np.ndarray) -> None:
        # whole numbers of any size where a batch's sum could leave 64 bits
        costs = np.minimum(costs, self.over)
        if self.over.bit_length() + len(costs).bit_length() > 62:
            costs = costs.astype(object)
        for k in range(len(self.sums)):
            small = costs < (1 << k)
            total = self.sums[k] + np.cumsum(np.where(small, costs, 0))
            between = ~small & (costs < (2 << k))
            if between.any():
                self.least[k] = min(self.least[k], int((costs + total)[between].min()))
            self.sums[k] = min(int(total[-1]), self.over)


def passed(used: int, limit: int, sums: list[int], least: list[int]) -> int | None:
    """What is used after a piece, or None if a level ends within it."""
    left = limit - used
    if left <= 0:
        return used
    k = left.bit_length() - 1
    return None if least[k] <= left or left - sums[k] < 1 << k else used + sums[k]


def dealt(requests: DataFrame, limit: int) -> DataFrame:
    """Requests in ranges of ``(session, seq, cost)``, charged where their session begins in the same range, written.

    Rows of a range's first session have null ``accepted``, since it may have begun before; ``place`` is a row's number in its
    range ``part``. One more row a range, without ``place``, has its first session, its last one (``tail``), what that used (null where
    it is the first too), and the ``Levels`` of the first.
    """
    rows = requests.select("session", "seq", F.greatest(F.coalesce(F.col("cost").cast("long"), F.lit(0)), F.lit(0)).alias("cost"))
    kind = rows.schema["session"].dataType
    schema = StructType(rows.schema.fields).add("accepted", BooleanType()).add("used", LongType()).add("part", IntegerType()).add("place", LongType()).add("tail", kind).add("sums", ArrayType(LongType())).add("least", ArrayType(LongType()))
    schema = StructType.fromJson({**schema.jsonValue(), "fields": [{**f, "nullable": True} for f in schema.jsonValue()["fields"]]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, used = TaskContext.get().partitionId(), 0, 0
        first = here = None
        leading, levels, kinds = True, Levels(limit), []
        for b in batches:
            if (n := b.num_rows) == 0:
                continue
            kinds = [b.column(0).type, b.column(1).type]
            costs = b.column(2).to_numpy()
            codes = b.column(0).dictionary_encode("encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), n]
            ok, after = [], []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                now = b.column(0)[lo]
                if first is None:
                    first = now
                elif lo or not now.equals(here):
                    leading, used = False, 0
                here = now
                if leading:
                    levels.add(costs[lo:hi])
                    ok += [None] * (hi - lo)
                    after += [None] * (hi - lo)
                else:
                    fits, sums = charge(costs[lo:hi].tolist(), limit, used)
                    ok += fits
                    after += sums
                    used = sums[-1]
            none = [pa.nulls(n, kinds[0]), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_()), pa.array(after, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(np.arange(place, place + n)), *none], names=schema.names)
            place += n
        if first is not None:
            one = [pa.array([first.as_py()], kinds[0]), pa.nulls(1, kinds[1]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.array([None if leading else used], pa.int64()), pa.array([part], pa.int32()), pa.nulls(1, pa.int64())]
            yield pa.RecordBatch.from_arrays([*one, pa.array([here.as_py()], kinds[0]), pa.array([levels.sums], pa.list_(pa.int64())), pa.array([levels.least], pa.list_(pa.int64()))], names=schema.names)

    # rows of one session and seq fall into one range, the least cost first
    return settle(rows.repartitionByRange("session", "seq").sortWithinPartitions("session", "seq", "cost").mapInArrow(run, schema))


def followed(rows: DataFrame, begin: dict[int, int], limit: int) -> DataFrame:
    """``session, seq, cost, accepted, used, part`` of the ranges' first sessions, from what was used when each range begins."""
    open_rows = rows.where("place is not null and accepted is null").select("session", "seq", "cost", "part", "place")
    # one row a range, so no more rows than tasks
    begins = F.broadcast(rows.sparkSession.createDataFrame(list(begin.items()), "part int, begin long"))
    ordered = open_rows.join(begins, "part").select("session", "seq", "cost", "part", "begin", "place").repartition("part").sortWithinPartitions("part", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, used = None, 0
        for b in batches:
            if b.num_rows == 0:
                continue
            part, costs, first = b.column(3).to_numpy(), b.column(2).to_pylist(), b.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), b.num_rows]
            ok, after = [], []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if part[lo] != here:
                    here, used = part[lo], int(first[lo])
                fits, sums = charge(costs[lo:hi], limit, used)
                ok += fits
                after += sums
                used = sums[-1]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ok, pa.bool_()), pa.array(after, pa.int64()), b.column(3)], names=["session", "seq", "cost", "accepted", "used", "part"])

    kind = dict(ordered.dtypes)
    return ordered.mapInArrow(run, f"session {kind['session']}, seq {kind['seq']}, cost long, accepted boolean, used long, part int")


def begins(rows: DataFrame, limit: int) -> dict[int, int]:
    """What its first session has used when each range of ``rows`` begins. Ranges within which a level ends are read, those of all sessions at once."""
    facts = rows.where("sums is not null").select("part", "session", "tail", "used", "sums", "least").orderBy("part").collect()
    chains: list[tuple[int, deque[Row]]] = []
    before = None
    for f in facts:
        if before is None or not _same(before["tail"], f["session"]):
            chains.append((0, deque([f])))
        elif before["used"] is None:
            chains[-1][1].append(f)
        else:
            chains.append((before["used"], deque([f])))
        before = f
    begin: dict[int, int] = {}
    while chains:
        stopped = []
        for used, pieces in chains:
            while pieces:
                f = pieces.popleft()
                begin[f["part"]] = used
                if pieces and (used := passed(used, limit, f["sums"], f["least"])) is None:
                    stopped.append((f["part"], pieces))
                    break
        if not stopped:
            break
        read = followed(rows, {part: begin[part] for part, _ in stopped}, limit)
        after = {r["part"]: r["used"] for r in read.groupBy("part").agg(F.max("used").alias("used")).collect()}
        chains = [(after[part], pieces) for part, pieces in stopped]
    return begin


def _same(a: object, b: object) -> bool:
    return a == b or (a != a and b != b)


def greedy_charges(requests: DataFrame, limit: int) -> DataFrame:
    """``(session, seq, cost, accepted, used)``: charges of each session in order; one that goes over is rejected and leaves the count.

    A session may be of any length: it lies in ranges of several tasks, and only the ranges within which a level ends (module docstring) wait
    for the one before. Costs that are null or below 0 are 0, of equal ``seq`` the least cost comes first; a null session is a session.
    """
    rows = dealt(requests, limit)
    columns = ["session", "seq", "cost", "accepted", "used"]
    return rows.where("accepted is not null").select(*columns).union(followed(rows, begins(rows, limit), limit).select(*columns))
