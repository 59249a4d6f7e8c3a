"""Training-order materialisation: every sequence gets its global slot, slots are written as fixed-stride shards.

A sequence's number, counted along the input's partitions, goes through a keyed Feistel
permutation of the least even power of two that holds all numbers; numbers that fall outside walk
on through the permutation until they fall inside, which makes it a permutation of exactly the
slots. Shards are ranges of slots; a shard is one file of ids in slots' order, each slot with the same
stride, so any slot is found by arithmetic and reading can go on from any of them.

Numbering needs each partition's count of sequences before any slot is known. The texts are
tokenised twice, once to count and once to write: ids stored in between would take more disk than both
shards and shuffle allow. Reading the same partitions twice must give the same rows in the same order,
as file scans do; hand in a table, not the outcome of a shuffle.

The folder must be a file system that all executors have mounted. A shard is written under another name
and renamed when whole, so a repeated task does no harm.
"""

from __future__ import annotations

import json
import math
import os
import uuid
import zlib
from array import array
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import scratch_path, text_or_empty, tidy
from .tokenizing import TokenCounter, encoder


@dataclass(frozen=True)
class OrderParams:
    """``length`` ids a sequence, the last of a text filled up with ``pad``; ``per_shard`` slots a file."""

    length: int = 256
    eos: int = 2
    pad: int = 0
    key: int = 20240229
    rounds: int = 6
    per_shard: int = 65_536
    id_bytes: int = 2


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """Permutation of 0 .. n-1, by a balanced Feistel network with cycle-walking."""
    x = np.asarray(x).astype(np.uint64)
    if n <= 1:
        return x.astype(np.int64)
    half = np.uint64(max(1, math.ceil((n - 1).bit_length() / 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = tk.mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % (1 << 64)))
    out = x.copy()
    live = np.arange(len(x))
    while len(live):
        v = out[live]
        left, right = v >> half, v & mask
        for k in keys:
            left, right = right, left ^ (tk.mix(right * np.uint64(0xD6E8FEB86659FD93) + k) & mask)
        out[live] = (left << half) | right
        live = live[out[live] >= np.uint64(n)]
    return out.astype(np.int64)


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def materialise_order(documents: DataFrame, folder: str | None = None, params: OrderParams = OrderParams(), tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts' ids in training order; one row for each sequence.

    Columns: ``id_col, sequence`` (of its text, from 0), ``length`` (ids before the filling), ``ids_crc32`` (of these, as
    they are stored), ``slot, shard, byte_offset``. A text is its ids and ``eos``; a null text is the empty
    one. Repeated rows are texts of their own. The shards are written when the result is computed, before any
    of its rows appears; ``reader(folder)`` reads them. ``folder`` is a path or ``file:`` address. Ties can't
    arise: every sequence has a number of its own, by its place in the input. Columns other than the id and the
    text are not read, so their names don't matter. An empty table gives no rows and no shard. A text of any
    length is tokenised whole by one task.
    """
    spark = documents.sparkSession
    url = urlparse(folder or scratch_path(spark, "order"))
    if url.scheme not in ("", "file"):
        raise ValueError(f"shards need a mounted file system, not {url.scheme}:")
    root, p = url.path, params
    kept = documents.select(id_col, text_or_empty(text_col).alias("_text"))
    kind = kept.dtypes[0][1]
    dtype, code = {2: ("<u2", "H"), 4: ("<u4", "I")}[p.id_bytes]
    stride = p.length * p.id_bytes

    def count(batches):
        tokens, n = TokenCounter(encoder(tokenizer)), 0
        for b in batches:
            n += int((-(-(tokens(b.column(1)) + 1) // p.length)).sum())
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([n], pa.int64())})

    # one number for each partition of the input
    counts = {r["part"]: r["n"] for r in kept.mapInArrow(tidy(count), "part bigint, n bigint").collect()}
    base, total = {}, 0
    for part in sorted(counts):
        base[part] = total
        total += counts[part]
    bases = spark.sparkContext.broadcast(base)
    os.makedirs(root, exist_ok=True)
    own = f"{root}/order.json.{uuid.uuid4().hex}"
    with open(own, "w") as f:
        json.dump({"slots": total, "length": p.length, "dtype": dtype, "per_shard": p.per_shard, "key": p.key, "rounds": p.rounds, "pad": p.pad}, f)
    os.replace(own, f"{root}/order.json")

    def number(batches):
        encode, at = encoder(tokenizer), bases.value.get(TaskContext.get().partitionId(), 0)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows, seq, size, crc, data = [], [], [], [], []
                for k, text in enumerate(part.column(1)):
                    ids = array(code, encode(text.as_py()))  # ids that don't fit raise an error
                    ids.append(p.eos)
                    raw = ids.tobytes()
                    for j, at_byte in enumerate(range(0, len(raw), stride)):
                        piece = raw[at_byte : at_byte + stride]
                        rows.append(k)
                        seq.append(j)
                        size.append(len(piece) // p.id_bytes)
                        crc.append(zlib.crc32(piece))
                        data.append(piece)
                slot = feistel(np.arange(at, at + len(rows)), total, p.key, p.rounds)
                at += len(rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(seq, pa.int32()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(slot), pa.array(slot // p.per_shard), pa.array(data, pa.binary())], names=[id_col, "sequence", "length", "ids_crc32", "slot", "shard", "data"])

    fields = f"`{id_col}` {kind}, sequence int, length bigint, ids_crc32 bigint, slot bigint, shard bigint"
    shards = max(1, -(-total // p.per_shard))
    numbered = kept.mapInArrow(tidy(number), f"{fields}, data binary")
    # the shard is the partition: ranges of slots that are even by construction, without a sampling pass
    dealt = numbered.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot")
    pad = np.full(p.length, p.pad, dtype).tobytes()

    def write(batches):
        out, shard, at = None, None, 0
        name = ""

        def close():
            if out is not None:
                out.close()
                if at != min((shard + 1) * p.per_shard, total):
                    raise RuntimeError(f"shard {shard} ends at slot {at}; the input changed between two readings")
                os.replace(name, shard_path(root, shard))

        held = []
        for b in batches:
            slots, data = b.column(4).to_numpy(), b.column(6)
            which = b.column(5).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(which)) + 1), b.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if which[lo] != shard:
                    close()
                    shard, at = int(which[lo]), int(which[lo]) * p.per_shard
                    name = f"{shard_path(root, shard)}.{uuid.uuid4().hex}"
                    out = open(name, "wb")  # noqa: SIM115
                if (slots[lo:hi] != np.arange(at, at + hi - lo)).any():
                    raise RuntimeError(f"slots from {at} on are not complete; the input changed between two readings")
                out.write(b"".join([x + pad[len(x) :] for x in data.slice(lo, hi - lo).to_pylist()]))
                at += hi - lo
            held.append(pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(slots % p.per_shard * stride)], names=[*b.schema.names[:6], "byte_offset"]))
        close()
        yield from held

    return dealt.mapInArrow(tidy(write), f"{fields}, byte_offset bigint")


class OrderReader:
    """Reads slots of a materialised order; a run that stopped goes on from any slot."""

    def __init__(self, folder: str):
        self.root = urlparse(folder).path
        with open(f"{self.root}/order.json") as f:
            self.facts = json.load(f)
        self.slots, self.length = self.facts["slots"], self.facts["length"]

    def read(self, start: int, count: int) -> np.ndarray:
        """Ids [count, length] of consecutive slots."""
        out = np.empty((max(0, min(count, self.slots - start)), self.length), self.facts["dtype"])
        done, per = 0, self.facts["per_shard"]
        while done < len(out):
            shard, at = divmod(start + done, per)
            n = min(per - at, len(out) - done)
            data = np.memmap(shard_path(self.root, shard), self.facts["dtype"], "r").reshape(-1, self.length)
            out[done : done + n] = data[at : at + n]
            done += n
        return out


def reader(folder: str) -> OrderReader:
    return OrderReader(folder)
