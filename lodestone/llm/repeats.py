"""Removal of repeated passages: everything covered by a string of ``width`` symbols that also starts elsewhere.

Symbols are bytes or words. Suffix arrays of shards decide which windows repeat; the steps around them
keep the shards small and independent of each other.

1. Each window of ``width`` symbols has an anchor: the position of the least ``gram``-symbol hash within it,
   the leftmost of equals. Equal windows have equal anchor strings at equal offsets. Consecutive windows with one
   anchor form a run. Anchors that occur once in the corpus can't hold a repeated window.
2. Runs of one anchor with one 128-bit digest of all that their windows cover are of one kind. Of a kind
   with several runs, two go to a shard; neighbouring runs that pair the same two places travel as one
   passage, so that nothing is sent twice. There a suffix array (Larsson-Sadakane), sorted to the
   width of a window, tells whether their windows start elsewhere; the other runs of a kind follow the two.
3. Of an anchor with several kinds, one string of each kind goes to the shard of the anchor. What it
   shares there with no other string is cut off; a suffix array tells the repeated windows.
4. An anchor with more kinds than a shard takes is dealt to several shards. Each hands on the sorted keys of
   its distinct windows, cut into as many ranges as the anchor has shards; a range's lists are merged by
   binary search, and the keys found in several shards go back to them.

Matches never cross documents; strings are judged on the input. A document is taken in steps of about half a
million symbols, so its length doesn't bound what a step needs of memory. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .collide import key_groups
from .shared import discard, free_name, materialise, text_or_empty, tidy, without_names
from .suffixes import repeated_around, repeated_starts

_STEP = 1 << 19
#: An odd base and its inverse modulo 2**64 make hashes of equal strings equal wherever they stand.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPREAD = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}
#: An anchor carries the digests of at most so many repeated kinds of runs; beyond, runs are joined with them.
_FEW = 64


@dataclass(frozen=True)
class RepeatParams:
    """``unit`` is "byte" or "word"; ``width`` and ``gram`` count such symbols.

    ``shard_bytes`` and ``shard_runs`` bound what one suffix array takes, ``passage`` how many symbols travel as one string.
    """

    width: int = 400
    gram: int = 64
    unit: str = "byte"
    shard_bytes: int = 2 << 20
    shard_runs: int = 3000
    passage: int = 1024


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


class Hashes:
    """Hashes of any substring of a buffer of symbols (bytes, or 64-bit hashes of words), in constant time each."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        values = _SPREAD[symbols] if symbols.dtype == np.uint8 else symbols
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _power(_BASE, self.n), dtype=np.uint64)])

    def grams(self, k: int) -> np.ndarray:
        m = max(0, self.n - k + 1)
        return tk.mix((self.sum[k : k + m] - self.sum[:m]) * _power(_INVERSE, m))


def symbols_of(column, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a text column and each row's offset among them."""
    buf, off = tk.utf8(column)
    if unit == "byte":
        return buf, off
    hashes, sizes = [], []
    for lo, hi in tk.slices(off):
        h, row = tk.words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower=False)
        hashes.append(h)
        sizes.append(np.bincount(row, minlength=hi - lo))
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.r_[0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))].astype(np.int64)


def anchors(symbols: np.ndarray, off: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows: row, first and last start, anchor position (all within ``symbols``), anchor hash, digest of all they cover [runs, 2]."""
    n = len(symbols)
    none = (*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64)), np.zeros((0, 2), np.int64))
    if n < width:
        return none
    bits = max(1, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    g = Hashes(symbols).grams(gram)
    ranked = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    # least value in each span of grams: the end of one block and the beginning of the next cover any span
    span = width - gram + 1
    blocks = -(-len(g) // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(g)] = ranked
    grid = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - width + 1
    anchor = (np.minimum(back[:starts], ahead[span - 1 : span - 1 + starts]) & low).astype(np.int64)
    row_of = np.repeat(np.arange(len(off) - 1), np.diff(off))[:starts]
    valid = np.arange(starts) + width <= off[row_of + 1]
    at = np.flatnonzero(valid)
    if not len(at):
        return none
    a, r = anchor[at], row_of[at]
    new = np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1]) | (np.diff(at) != 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1
    lo, hi, p = at[first], at[last], a[first]
    data = memoryview(np.ascontiguousarray(symbols)).cast("B")
    unit = symbols.itemsize
    digest = b"".join([xxhash.xxh3_128_digest(data[s:e], seed=k) for s, e, k in zip((lo * unit).tolist(), ((hi + width) * unit).tolist(), (p - lo).tolist(), strict=True)])
    return r[first], lo, hi, p, g[p], np.frombuffer(digest, np.int64).reshape(-1, 2)


def _parts(off: np.ndarray, width: int) -> Iterator[tuple[int, int, int, int]]:
    """``(row_lo, row_hi, byte_lo, byte_hi)``: slices of whole rows, and long rows in overlapping steps."""
    for lo, hi in tk.slices(off, _STEP):
        if hi == lo + 1 and off[hi] - off[lo] > 2 * _STEP:
            at = int(off[lo])
            while at + width <= off[hi]:
                yield lo, hi, at, int(min(off[hi], at + _STEP + width - 1))
                at += _STEP
        else:
            yield lo, hi, int(off[lo]), int(off[hi])


def _strings(t: pa.Table, unit: str) -> list[np.ndarray]:
    """The strings of a shard: bytes, or for words their ranks within the shard."""
    if unit == "byte":
        return [np.frombuffer(x, np.uint8) for x in t.column("symbols").to_pylist()]
    words = [np.frombuffer(x, np.uint64) for x in t.column("symbols").to_pylist()]
    ranks = np.unique(np.concatenate(words), return_inverse=True)[1].astype(np.uint32)
    return np.split(ranks, np.cumsum([len(w) for w in words])[:-1])


def _spans(ids: pa.Array, ths: pa.Array, at: list[int], a: list[int], size: list[int]) -> Iterator[pa.RecordBatch]:
    pick = pa.array(at, pa.int64())
    yield from pa.table([ids.take(pick), ths.take(pick), pa.array([[x] for x in a], pa.list_(pa.int64())), pa.array(size, pa.int64())], names=["id", "th", "los", "size"]).to_batches()


def _passages(role: np.ndarray, other: np.ndarray, shift: np.ndarray, lo: np.ndarray, follow: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last run of each passage: sorted runs that pair the same two places one after another, split about every ``most`` symbols.

    ``follow`` is where a run's successor begins. Both places split alike.
    """
    if not len(role):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    apart = (role[1:] != role[:-1]) | (other[1:] != other[:-1]) | (shift[1:] != shift[:-1]) | (lo[1:] != follow[:-1])
    head = np.flatnonzero(np.r_[True, apart])
    piece = (lo - np.repeat(lo[head], np.diff(np.r_[head, len(role)]))) // most
    head = np.flatnonzero(np.r_[True, apart | (piece[1:] != piece[:-1])])
    return head, np.r_[head[1:], len(role)]


def repeated_spans(docs: DataFrame, p: RepeatParams) -> tuple[DataFrame, list[DataFrame]]:
    """``(id, th, los, size)``: spans of ``size`` symbols from each of ``los``, of repeated windows of ``docs(id, th, text)``; spans may overlap.

    Beside them the written tables that they are read from, to be discarded once the spans are written.
    """
    kind = dict(docs.dtypes)["id"]
    spans = f"id {kind}, th bigint, los array<bigint>, size bigint"
    width, unit = p.width, p.unit

    def scan(batches):
        for b in batches:
            sym, off = symbols_of(b.column(2), unit)
            for rlo, rhi, blo, bhi in _parts(off, width):
                edges = np.clip(off[rlo : rhi + 1] - blo, 0, bhi - blo)
                r, lo, hi, at, f, w = anchors(sym[blo:bhi], edges, width, p.gram)
                if len(r):
                    # runs that repeat within the part of a document, as in periodic text, travel as one row
                    order = np.lexsort((lo, w[:, 1], w[:, 0], f, r))
                    r, lo, hi, at, f, w = (x[order] for x in (r, lo, hi, at, f, w))
                    first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (f[1:] != f[:-1]) | (w[1:] != w[:-1]).any(axis=1)])
                    starts = lo + (blo - off[rlo + r])
                    pick = pa.array(r[first] + rlo)
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(r)], pa.int32()), pa.array(starts))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pick), b.column(1).take(pick), pa.array(f[first].view(np.int64)), *(pa.array(np.ascontiguousarray(w[first, k])) for k in (0, 1)), pa.array((hi - lo)[first] + width), pa.array((at - lo)[first]), lists],
                        names=["id", "th", "f", "w1", "w2", "size", "rel", "los"],
                    )

    runs = materialise(docs.select("id", "th", "text").mapInArrow(tidy(scan), f"id {kind}, th bigint, f bigint, w1 bigint, w2 bigint, size bigint, rel bigint, los array<bigint>"), "runs")
    # kinds of runs of the anchors that occur more than once: how many runs, the first and the last of them
    place = lambda lo: F.struct("id", "th", lo.alias("lo"), "size", "rel")
    every = runs.groupBy("f", "w1", "w2").agg(F.sum(F.size("los")).alias("n"), F.min(place(F.element_at("los", 1))).alias("one"), F.max(place(F.element_at("los", -1))).alias("two"))
    often = runs.groupBy("f").agg(F.sum(F.size("los")).alias("_n")).where("_n > 1").select("f")
    kinds = materialise(every.join(often, "f", "left_semi"), "kinds")
    several = kinds.groupBy("f").agg(F.count("*").alias("kinds")).where("kinds > 1")
    total, both = kinds.agg(F.sum("one.size"), F.sum(F.when(F.col("n") > 1, F.col("one.size") - width + 1))).first()
    if not total:
        return runs.select("id", "th", "los", "size").limit(0), [runs, kinds]
    symbol = 1 if unit == "byte" else 8
    shards = max(1, -(-int(total) * symbol // p.shard_bytes))
    pair_shards = max(1, -(-int(both or 0) * 3 * symbol // p.shard_bytes))

    # what each document hands to the shards: its runs that stand for a kind, and those that prove that a kind repeats
    alone = kinds.join(several, "f").select(F.col("one.*"), F.lit(0).alias("role"), "f", "w1", "w2", "n", F.ceil(F.col("kinds") / p.shard_runs).alias("subs"), F.lit(0).cast("long").alias("other"), F.lit(0).cast("long").alias("other_lo"))
    twice = kinds.where("n > 1")

    def proof(own: str, other: str, role: int) -> DataFrame:
        return twice.select(F.col(f"{own}.*"), F.lit(role).alias("role"), "f", "w1", "w2", "n", F.lit(1).cast("long").alias("subs"), F.xxhash64(f"{other}.id", f"{other}.th").alias("other"), F.col(f"{other}.lo").alias("other_lo"))

    fields = ("role", "other", "lo", "other_lo", "f", "w1", "w2", "n", "subs", "size", "rel")
    wanted = alone.unionByName(proof("one", "two", 1)).unionByName(proof("two", "one", 2))
    lists = wanted.groupBy("id", "th").agg(F.collect_list(F.struct(*fields)).alias("runs"))
    joined = docs.alias("d").join(lists.alias("l"), F.col("d.id").eqNullSafe(F.col("l.id")) & (F.col("d.th") == F.col("l.th"))).select("d.id", "d.th", "d.text", "l.runs").dropDuplicates(["id", "th"])

    def cut(batches):
        for b in batches:
            symbols, off = symbols_of(b.column(2), unit)
            ends = np.r_[0, np.cumsum(pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False))]
            every = {name: x.to_numpy(zero_copy_only=False) for name, x in zip(fields, b.column(3).flatten().flatten(), strict=True)}
            held, size = [], 0
            for k in range(b.num_rows):
                sym = symbols[off[k] : off[k + 1]]
                c = {name: x[ends[k] : ends[k + 1]] for name, x in every.items()}
                end = c["lo"] + c["size"]
                single = np.flatnonzero(c["role"] == 0)
                pair = np.flatnonzero(c["role"] > 0)
                shift = c["other_lo"] - c["lo"]
                pair = pair[np.lexsort((c["lo"][pair], shift[pair], c["other"][pair], c["role"][pair]))]
                head, tail = _passages(c["role"][pair], c["other"][pair], shift[pair], c["lo"][pair], end[pair] - width + 1, p.passage)
                first, last = np.r_[single, pair[head]].astype(np.int64), np.r_[single, pair[tail - 1]].astype(np.int64)
                members = [[]] * len(single) + [pair[a:z] if c["role"][pair[a]] == 1 else [] for a, z in zip(head, tail, strict=True)]
                parts = [sym[a:z].tobytes() for a, z in zip(c["lo"][first], end[last], strict=True)]
                held.append((k, parts, *(c[name][first] for name in ("role", "f", "w1", "n", "subs", "lo", "rel")), *([value[x].tolist() if len(x) else [] for x in members] for value in (c["f"], c["w1"], c["w2"], c["lo"], end))))
                size += sum(map(len, parts))
                if size >= p.shard_bytes or k + 1 == b.num_rows:
                    rows, parts, *columns = zip(*held, strict=True)
                    pick = pa.array(np.repeat(np.array(rows), [len(x) for x in parts]))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pick), b.column(1).take(pick), *(pa.array(np.concatenate(x), pa.int64()) for x in columns[:7]), pa.array([x for part in parts for x in part], pa.binary()), *(pa.array([x for part in column for x in part], pa.list_(pa.int64())) for column in columns[7:])],
                        names=["id", "th", "role", "f", "w1", "n", "subs", "lo", "rel", "symbols", "fs", "w1s", "w2s", "los", "ends"],
                    )
                    held, size = [], 0

    lists_of = ", ".join(f"{x} array<bigint>" for x in ("fs", "w1s", "w2s", "los", "ends"))
    strings = joined.mapInArrow(tidy(cut), f"id {kind}, th bigint, role bigint, f bigint, w1 bigint, n bigint, subs bigint, lo bigint, rel bigint, symbols binary, {lists_of}")
    # the shard of an anchor or of a passage's first run; an anchor of too many kinds has shards of its own, numbered below zero
    own = F.when(F.col("role") > 0, F.lit(shards) + F.pmod(F.xxhash64("f", "w1"), F.lit(pair_shards)))
    own = own.when(F.col("subs") > 1, F.lit(-1) - F.pmod(F.xxhash64("f", F.pmod(F.xxhash64("w1"), "subs")), F.lit(1 << 62))).otherwise(F.pmod(F.xxhash64("f"), F.lit(shards)))
    strings = materialise(strings.withColumn("shard", own.cast("long")).drop("role", "w1"), "strings")
    singles = strings.where(f"shard < {shards}").select("shard", "f", "id", "th", "n", "subs", "lo", "rel", "symbols")

    def prove(batches):
        """The kinds whose windows all start elsewhere in the shard."""
        for t in key_groups(batches, 1):
            marks = repeated_starts(_strings(t, unit), width)
            got = [[], [], []]
            for i, (lo, los, ends) in enumerate(zip(*(t.column(x).to_pylist() for x in ("lo", "los", "ends")), strict=True)):
                ok = [k for k, (a, z) in enumerate(zip(los, ends, strict=True)) if marks[i][a - lo : z - lo - width + 1].all()]
                for x, name in zip(got, ("fs", "w1s", "w2s"), strict=True):
                    values = t.column(name)[i].as_py()
                    x += [values[k] for k in ok]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=["f", "w1", "w2"])

    passages = strings.where(f"shard >= {shards}").select("shard", "lo", "symbols", "fs", "w1s", "w2s", "los", "ends")
    proven = passages.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidy(prove), "f bigint, w1 bigint, w2 bigint")
    proven = materialise(proven.distinct(), "proven")
    discard(kinds)
    # all runs of the proven kinds; where an anchor has few of these, they travel with it
    by_anchor = proven.groupBy("f").agg(F.count("*").alias("several"))
    few = proven.join(by_anchor.where(F.col("several") <= _FEW), "f").groupBy("f").agg(F.collect_list(F.struct("w1", "w2")).alias("kinds"))
    found = runs.join(few, "f").where(F.array_contains("kinds", F.struct("w1", "w2"))).select("id", "th", "los", "size")
    crowded = materialise(by_anchor.where(F.col("several") > _FEW).select("f"), "crowded")
    if not crowded.isEmpty():
        # these anchors are not many, so runs of others drop out where they are
        many = proven.join(crowded, "f", "left_semi")
        found = found.union(runs.join(crowded, "f", "left_semi").join(many, ["f", "w1", "w2"], "left_semi").select("id", "th", "los", "size"))

    def windows_of(t: pa.Table, where: list[np.ndarray]):
        """Spans (of single runs) for the window starts that are marked."""
        n, lo = t.column("n").to_pylist(), t.column("lo").to_pylist()
        rows, a, z = [], [], []
        for i, mark in enumerate(where):
            if n[i] > 1 or not mark.any():
                continue
            edge = np.flatnonzero(np.diff(np.r_[False, mark, False].astype(np.int8)))
            rows += [i] * (len(edge) // 2)
            a += (edge[::2] + lo[i]).tolist()
            z += (edge[1::2] - 1 - edge[::2] + width).tolist()
        yield from _spans(t.column("id"), t.column("th"), rows, a, z)

    def search(batches):
        for t in key_groups(batches, 1):
            yield from windows_of(t, repeated_around(_strings(t, unit), t.column("f").to_pylist(), t.column("rel").to_pylist(), width))

    parts = singles.repartition("shard").sortWithinPartitions("shard")
    found = found.union(parts.mapInArrow(tidy(search), spans))
    hot = singles.where("shard < 0")
    if hot.isEmpty():
        return found, [runs, strings, proven, crowded]

    # across the shards of one anchor: sorted window keys, cut into ranges and merged by binary search
    def window_keys(t: pa.Table) -> list[np.ndarray]:
        strings = [np.frombuffer(x, np.uint8 if unit == "byte" else np.uint64) for x in t.column("symbols").to_pylist()]
        size = np.array([len(s) for s in strings])
        at = np.cumsum(size) - size
        grams = Hashes(np.concatenate(strings)).grams(width)
        return [grams[a : a + n - width + 1] for a, n in zip(at, size, strict=True)]

    def hand_on(batches):
        for t in key_groups(batches, 1):
            keys = np.unique(np.concatenate(window_keys(t)))
            ranges = t.column("subs")[0].as_py()
            cuts = np.searchsorted(keys, np.array([(k << 64) // ranges for k in range(ranges)], np.uint64))
            cuts = np.r_[cuts, len(keys)]
            f, shard = t.column("f")[0].as_py(), t.column("shard")[0].as_py()
            for k in np.flatnonzero(np.diff(cuts)):
                yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([k]), pa.array([shard]), pa.array([keys[cuts[k] : cuts[k + 1]].tobytes()], pa.binary())], names=["f", "range", "shard", "keys"])

    def merge(batches):
        for t in key_groups(batches, 2):
            lists = [np.frombuffer(x, np.uint64) for x in t.column("keys").to_pylist()]
            all_keys = np.sort(np.concatenate(lists))
            for shard, own in zip(t.column("shard").to_pylist(), lists, strict=True):
                common = own[np.searchsorted(all_keys, own, "right") - np.searchsorted(all_keys, own, "left") > 1]
                if len(common):
                    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([common.tobytes()], pa.binary())], names=["shard", "keys"])

    def mark(batches):
        """Each shard's strings, after the rows (of no ``subs``) that hold the keys it shares."""
        for t in key_groups(batches, 1):
            keys = t.filter(pc.equal(t.column("subs"), 0))
            if keys.num_rows and keys.num_rows < t.num_rows:
                shared = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in keys.column("symbols").to_pylist()]))
                own = t.filter(pc.greater(t.column("subs"), 0))
                yield from windows_of(own, [np.isin(w, shared) for w in window_keys(own)])

    handed = hot.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidy(hand_on), "f bigint, range bigint, shard bigint, keys binary")
    common = handed.repartition("f", "range").sortWithinPartitions("f", "range").mapInArrow(tidy(merge), "shard bigint, keys binary")
    common = common.select("shard", F.lit(0).cast("long").alias("subs"), F.col("keys").alias("symbols"))
    again = hot.unionByName(common, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard")
    return found.union(again.mapInArrow(tidy(mark), spans)), [runs, strings, proven, crowded]


def word_edges(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text begins and ends, in bytes."""
    start, end, _ = tk.runs(~tk.SPACE[np.frombuffer(data, np.uint8)], np.array([0, len(data)]))
    return start, end


def _merged(spans: set[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def cut_repeats(documents: DataFrame, carry: list[str], params: RepeatParams = RepeatParams(), id_col: str = "doc_id", text_col: str = "text", prefix: str = "", as_text: bool = False) -> DataFrame:
    """``carry`` columns of each row with ``n_bytes, n_removed, n_spans`` and ``kept``, the bytes that stay; ``prefix`` sets their names apart.
    With ``as_text``, ``kept`` is text; where a cut fell within a character, what is left of it is gone.

    Spans of words are cut from the first byte of the first to the last byte of the last. A null text is the empty
    one, of which nothing is cut; null ids are allowed. Repeated rows are documents of their own, so
    they lose all that is long enough. An empty table gives no rows. A new column takes
    the place of a carried one of its name (``prefix`` avoids that); other columns are not read. A text of any length
    is held whole by one task, its windows are taken in steps.
    """
    new = [prefix + c for c in ("n_bytes", "n_removed", "n_spans", "kept")]
    carry = without_names(carry, new)
    docs = documents.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    found, tables = repeated_spans(docs, params)
    spans = materialise(found.groupBy("id", "th").agg(F.collect_list(F.struct("los", "size")).alias("spans")), "spans")
    discard(*tables)
    base = documents.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), F.struct(*[F.col(c) for c in carry]).alias("_d")).withColumn("_th", F.xxhash64("_text"))
    both = base.join(spans, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")), "left").select(*[F.col("_d")[c].alias(c) for c in carry], F.col("_text").alias(free_name("_text", carry)), F.col("spans").alias(free_name("spans", carry)))
    types = dict(documents.dtypes)

    def run(batches):
        for b in batches:
            texts, spans = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
            for lo in range(0, b.num_rows, 512):
                size, gone, count, kept = [], [], [], []
                for k in range(lo, min(b.num_rows, lo + 512)):
                    data = (texts[k].as_py() or "").encode()
                    cuts = _merged({(a, a + x["size"]) for x in spans[k].as_py() or () for a in x["los"]})
                    if cuts and params.unit == "word":
                        begin, end = word_edges(data)
                        cuts = [(int(begin[a]), int(end[z - 1])) for a, z in cuts]
                    edges = [0, *(x for c in cuts for x in c), len(data)]
                    size.append(len(data))
                    gone.append(sum(z - a for a, z in cuts))
                    count.append(len(cuts))
                    kept.append(b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, 512) for c in b.columns[:-2]], pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array([x.decode(errors="ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())], names=[*carry, *new])

    out = ", ".join([*(f"`{c}` {types[c]}" for c in carry), *(f"`{c}` {t}" for c, t in zip(new, ("bigint", "bigint", "bigint", "string" if as_text else "binary"), strict=True))])
    return both.mapInArrow(tidy(run), out)


def passages(docs: DataFrame, params: RepeatParams) -> DataFrame:
    """``(id, th, passages)``: how many maximal repeated passages each row of ``docs(id, th, text)`` holds; rows without any are left out.

    Nothing is cut, so no text moves beyond the shards. Texts may be binary and hold broken characters.
    """
    found, tables = repeated_spans(docs, params)
    kind = dict(docs.dtypes)["id"]

    def count(batches):
        for b in batches:
            n = [len(_merged({(a, a + x["size"]) for x in spans for a in x["los"]})) for spans in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["id", "th", "passages"])

    grouped = found.groupBy("id", "th").agg(F.collect_list(F.struct("los", "size")).alias("spans"))
    out = materialise(grouped.mapInArrow(tidy(count), f"id {kind}, th bigint, passages bigint"), "passages")
    discard(*tables)
    return out


def cut_and_passages(documents: DataFrame, carry: list[str], short: RepeatParams, params: RepeatParams = RepeatParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``cut_repeats``, with ``kept_sha256`` (of ``kept``) in the place of ``kept``, and ``n_passages``: ``n_spans`` and the passages by ``short`` that repeat within what stays.

    The second search reads what the first one left, so long repeats are not sorted twice; it cuts nothing. A short
    passage whose other copies all lie within removed bytes is therefore not counted.
    """
    carry = without_names(carry, ["n_passages", "kept_sha256"])
    key, th, kept, id_ = (free_name(x, carry, ["id", "passages"]) for x in ("_key", "_th", "_kept", "_id"))
    source = documents.withColumn(key, F.col(id_col))
    cut = cut_repeats(source, [*carry, key], params, id_col, text_col).withColumnRenamed("kept", kept)
    cut = materialise(cut.withColumn("kept_sha256", F.sha2(kept, 256)).withColumn(th, F.xxhash64(kept)), "kept")
    more = passages(cut.select(F.col(key).alias("id"), F.col(th).alias("th"), F.col(kept).alias("text")).where(F.length("text") > 0), short)
    both = cut.drop(kept).join(more.select(F.col("id").alias(id_), F.col("th").alias("_other"), "passages"), F.col(key).eqNullSafe(F.col(id_)) & (F.col(th) == F.col("_other")), "left")
    return both.select(*carry, "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_spans") + F.coalesce("passages", F.lit(0))).alias("n_passages"))


def without_repeats(documents: DataFrame, params: RepeatParams = RepeatParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``documents``, repeated passages cut from the text; ``n_chars``, where there is such a column, follows it.

    Where a cut falls within a character, what is left of that character goes too. All rows stay.
    """
    columns = documents.columns
    others = [c for c in columns if c != text_col]
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in others):
        prefix += "_"
    out = cut_repeats(documents, others, params, id_col, text_col, prefix, as_text=True).withColumnRenamed(f"{prefix}kept", text_col)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col(f"{prefix}n_removed") > 0, F.length(text_col).cast(dict(documents.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*columns)

