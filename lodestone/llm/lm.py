"""N-gram language model in an Elias-Fano trie, counted over the whole training corpus.

Level 1 is the sorted sequence of the training tokens' hashes; a token's place is its id. Level 2 is the
sequence of (context id, token id), level 3 that of (place of the pair before, place of the last token
among the successors of the middle one): ids relative to their context, which are small. Every level is cut into
shards of bounded size by key ranges; a level's shard holds its sequence, the monotone pointers to
where each parent's children begin, and a 16-bit code of each n-gram's discounted probability (steps of
10 ** -0.0005, so the logarithm of a stored probability is off by 0.00025 at most); level 2 holds the counts too. Shards
are files in the shared folder, written whole or not at all, and memory-mapped by whoever searches them, so a
model may outgrow any memory.

Probabilities interpolate by absolute discounting:
P(w|u,v) = max(c(uvw) - D, 0) / c(uv) + D T(uv) / c(uv) * P(w|v), likewise for P(w|v), down to
P(w) = (c(w) + 1) / (N + V + 1); T counts distinct successors and comes from the pointers.

Counting goes level by level. Scans sort their keys, add up equal ones and send, for each shard, one
compressed list; a task per shard merges the lists. All of the corpus is counted, nothing is pruned.

The shared folder must be a file system that executors have mounted (a ``file:`` address).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .collide import key_groups
from .eliasfano import EliasFano, build, map_arrays, write_arrays
from .shared import free_name, scratch_path, text_or_empty, tidy, without_names

END = tk.mix(np.array([0xE17D], np.uint64))[0]
#: Texts are taken in slices of this many bytes; longer slices repeat more words and search more cheaply.
SLICE = 8 << 20


@dataclass(frozen=True)
class LmParams:
    order: int = 3
    discount: float = 0.75
    shard_tokens: int = 3_000_000
    vocabulary_shard_bytes: int = 16 << 20


# ---- keys and counts of a scan


def _packed(a: np.ndarray) -> bytes:
    """Sorted numbers or counts, compressed: differences, byte plane by byte plane."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unpacked(b: bytes, dtype, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(-1, n).T).reshape(-1).view(dtype)


class Counter:
    """Adds up keys and hands them on by shard, in batches of ``(shard, n, keys, counts)``."""

    def __init__(self, bounds: np.ndarray, most: int = 4_000_000):
        self.bounds, self.most, self.kept, self.size = bounds, most, [], 0

    def add(self, keys: np.ndarray):
        self.kept.append(keys)
        self.size += len(keys)
        if self.size >= self.most:
            yield from self.flush()

    def flush(self):
        if not self.size:
            return
        keys, counts = np.unique(np.concatenate(self.kept), return_counts=True)
        self.kept, self.size = [], 0
        cut = np.r_[0, np.searchsorted(keys, self.bounds), len(keys)]
        for s in np.flatnonzero(np.diff(cut)):
            k, c = keys[cut[s] : cut[s + 1]], counts[cut[s] : cut[s + 1]].astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([len(k)]), pa.array([_packed(np.diff(k, prepend=np.uint64(0)))], pa.binary()), pa.array([_packed(c)], pa.binary())], names=["shard", "n", "keys", "counts"])


_COUNTED = "shard bigint, n bigint, keys binary, counts binary"


def _merged(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for n, k, c in zip(t.column("n").to_pylist(), t.column("keys").to_pylist(), t.column("counts").to_pylist(), strict=True):
        keys.append(np.cumsum(_unpacked(k, np.uint64, n), dtype=np.uint64))
        counts.append(_unpacked(c, np.uint32, n))
    key, count = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    del keys, counts
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(count, first)


# ---- codes of probabilities, and counts

_STEP = 0.0005


def encode_probability(p: np.ndarray) -> np.ndarray:
    """Codes 1 to 65535 for steps of 10 ** -0.0005 from 1 down to 10 ** -32; 0 is no probability at all."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(-np.log10(p) / _STEP) + 1, 1, 65535), 0).astype(np.uint16)


DECODED = np.r_[0.0, 10.0 ** (-_STEP * np.arange(65535))]


def count_arrays(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Exact counts, a byte each; those that a byte can't hold stand beside them with their places."""
    large = np.flatnonzero(counts >= 255)
    return {"few": np.minimum(counts, 255).astype(np.uint8), "many_at": large, "many": counts[large].astype(np.int64)}


def read_counts(arrays: dict[str, np.ndarray], i: np.ndarray) -> np.ndarray:
    out = arrays["few"][i].astype(np.int64)
    at = np.flatnonzero(out == 255)
    out[at] = arrays["many"][np.searchsorted(arrays["many_at"], i[at])]
    return out


# ---- the trie


@dataclass(frozen=True)
class Trie:
    """Where the shards are and how keys are dealt to them; a few numbers for each shard."""

    folder: str
    tokens: int
    words: int
    documents: int
    discount: float
    vocabulary: tuple  # base of each hash range
    bounds2: np.ndarray
    bases2: np.ndarray
    degree_bits: int
    bounds3: np.ndarray | None
    bases3: np.ndarray | None


def hash_bounds(ranges: int) -> np.ndarray:
    """Bounds between equal ranges of 64-bit hashes."""
    return np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)


class Level:
    """One level's shards, opened as they are needed."""

    def __init__(self, folder: str, name: str, bounds: np.ndarray, bases: np.ndarray):
        self.path, self.bounds, self.bases, self.open = f"{folder}/{name}", bounds, bases, {}

    def shard(self, s: int):
        if s not in self.open:
            arrays, facts = map_arrays(f"{self.path}-{s}")
            self.open[s] = (arrays, facts, EliasFano(arrays, "k_"), EliasFano(arrays, "p_") if "p_meta" in arrays else None)
        return self.open[s]

    def _by_shard(self, shard: np.ndarray):
        sorted_ = len(shard) < 2 or bool((shard[1:] >= shard[:-1]).all())
        order = np.arange(len(shard)) if sorted_ else np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0, True]) if len(shard) else []
        for a, b in zip(cut, cut[1:], strict=False):
            s = int(shard[order[a]])
            if self.bases[s + 1] > self.bases[s]:
                yield s, order[a:b]

    def find(self, keys: np.ndarray, *payloads) -> tuple[np.ndarray, ...]:
        """Place in the level (-1: absent) of each key, and payloads: names of arrays, or functions of a shard's arrays and places in it."""
        place, got = np.full(len(keys), -1, np.int64), [np.zeros(len(keys), np.int64) for _ in payloads]
        for s, at in self._by_shard(np.searchsorted(self.bounds, keys, "right")):
            arrays, _, seq, _ = self.shard(s)
            i = seq.find(keys[at])
            hit = i >= 0
            place[at[hit]] = i[hit] + self.bases[s]
            for out, what in zip(got, payloads, strict=True):
                out[at[hit]] = what(arrays, i[hit]) if callable(what) else arrays[what][i[hit]]
        return place, *got

    def start(self, parent: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Place of the first child of each parent; ``key`` is the least key that a child may have."""
        shard = np.searchsorted(self.bounds, key, "right")
        out = self.bases[shard].copy()
        for s, at in self._by_shard(shard):
            _, facts, _, ptr = self.shard(s)
            i = parent[at] - facts["parent"]
            out[at] += np.where(i < 0, 0, ptr.access(np.clip(i, 0, ptr.n - 1)).astype(np.int64))
        return out


class Model:
    """Looks up texts in a trie."""

    def __init__(self, t: Trie):
        self.t = t
        self.width = t.words + 1  # ids, and one more for the beginning of a text
        bases = np.array(t.vocabulary, np.int64)
        self.level1 = Level(t.folder, "l1", hash_bounds(len(bases) - 1), bases)
        self.level2 = Level(t.folder, "l2", t.bounds2, t.bases2)
        self.level3 = Level(t.folder, "l3", t.bounds3, t.bases3) if t.bounds3 is not None else None

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct ids (-1: unknown; the beginning of a text last) with their counts, and the place of each token among them."""
        own, back = np.unique(hashes, return_inverse=True)
        place, count = self.level1.find(own, "count")
        return np.r_[place, self.t.words], np.r_[count, self.t.documents], back

    @staticmethod
    def contexts(back: np.ndarray, first: np.ndarray, beginning: int) -> np.ndarray:
        """The place, among the distinct ids, of the token before each token."""
        out = np.r_[0, back[:-1]]
        out[first] = beginning
        return out

    def key2(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return v.astype(np.uint64) * np.uint64(self.width) + w.astype(np.uint64)

    def starts2(self, ident: np.ndarray) -> np.ndarray:
        """Where the children of each id begin in level 2; of unknown ids, 0."""
        out = np.zeros(len(ident), np.int64)
        at = np.flatnonzero(ident >= 0)
        out[at] = self.level2.start(ident[at], self.key2(ident[at], np.zeros(len(at), np.int64)))
        return out

    def pairs(self, v: np.ndarray, w: np.ndarray, *payloads) -> tuple[np.ndarray, ...]:
        """Of pairs of ids (-1: unknown): place in level 2 (-1: absent) and payloads."""
        out = [np.full(len(v), -1, np.int64), *(np.zeros(len(v), np.int64) for _ in payloads)]
        at = np.flatnonzero((v >= 0) & (w >= 0))
        if len(at):
            keys, back = np.unique(self.key2(v[at], w[at]), return_inverse=True)
            for x, got in zip(out, self.level2.find(keys, *payloads), strict=True):
                x[at] = got[back]
        return tuple(out)

    def key3(self, node: np.ndarray, rel: np.ndarray) -> np.ndarray:
        return (node.astype(np.uint64) << np.uint64(self.t.degree_bits)) | rel.astype(np.uint64)

    def successors3(self, node: np.ndarray) -> np.ndarray:
        own, back = np.unique(node, return_inverse=True)
        zero = np.zeros(len(own), np.int64)
        return (self.level3.start(own + 1, self.key3(own + 1, zero)) - self.level3.start(own, self.key3(own, zero)))[back]

    def score(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a stream of texts' tokens (``first`` marks where a text begins): known, base log10 and model log10 of each."""
        t, d = self.t, self.t.discount
        own, often1, back = self.ids(hashes)
        before1 = self.contexts(back, first, len(own) - 1)
        ident, count = own[back], often1[back]
        known = ident >= 0
        p = (count + 1) / (t.tokens + t.words + 1)
        base = np.log10(p)
        context, total = own[before1], often1[before1].astype(float)
        place, code, pair_count = self.pairs(context, ident, "code", read_counts)
        begin = self.starts2(own)
        follow = self.starts2(np.where(own >= 0, own + 1, -1)) - begin
        seen = np.flatnonzero((context >= 0) & (total > 0))
        p2 = p.copy()
        p2[seen] = DECODED[code[seen]] + d * follow[before1[seen]] / total[seen] * p[seen]
        if self.level3 is None:
            return known, base, np.log10(p2)
        rel = np.where(place >= 0, place - begin[before1], -1)
        # the pair before each token: its place and its count
        before = np.r_[np.int64(-1), place[:-1]]
        before[first] = -1
        often = np.r_[0, pair_count[:-1]]
        seen = np.flatnonzero((before >= 0) & (often > 0))
        p3 = p2.copy()
        if len(seen):
            alpha = np.zeros(len(seen))
            inner = np.flatnonzero(rel[seen] >= 0)
            keys, back = np.unique(self.key3(before[seen[inner]], rel[seen[inner]]), return_inverse=True)
            _, c3 = self.level3.find(keys, "code")
            alpha[inner] = DECODED[c3[back]]
            p3[seen] = alpha + np.minimum(1.0, d * self.successors3(before[seen]) / often[seen]) * p2[seen]
        return known, base, np.log10(p3)


_models: dict[str, Model] = {}


def _model(t: Trie) -> Model:
    if t.folder not in _models:
        _models.clear()
        _models[t.folder] = Model(t)
    return _models[t.folder]


def _streams(column):
    """``(row_lo, row_hi, hashes, first, size)`` of slices of texts, each text's tokens followed by the end token."""
    buf, off = tk.utf8(column)
    for lo, hi in tk.slices(off, SLICE):
        hashes, counts = [], np.zeros(hi - lo, np.int64)
        for a, b in tk.slices(off[lo : hi + 1]):
            h, row = tk.words(buf[off[lo + a] : off[lo + b]], off[lo + a : lo + b + 1] - off[lo + a])
            n = np.bincount(row, minlength=b - a)
            counts[a:b] = n
            hashes.append(np.insert(h, np.cumsum(n), END))
        size = counts + 1
        start = np.cumsum(size) - size
        stream = np.concatenate(hashes)
        yield lo, hi, stream, start, size


def build_trie(documents: DataFrame, training: Column, params: LmParams = LmParams(), text_col: str = "text") -> Trie:
    """Count the texts of the rows for which ``training`` holds and write the trie's shards to the shared folder.

    A null text is the empty one, a text of its end token alone; texts of any length are counted whole, repeated rows as often
    as they occur. Of an empty table the trie holds nothing.
    """
    spark = documents.sparkSession
    url = urlparse(scratch_path(spark, "trie"))
    if url.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir must be a mounted file system to hold memory-mapped files, not {url.scheme}:")
    folder = url.path
    texts = documents.where(training).select(text_or_empty(text_col).alias("text"))
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ranges = 1 << max(0, min(16, math.ceil(math.log2(max(1, size / params.vocabulary_shard_bytes)))))
    d, most = params.discount, params.shard_tokens

    def count_words(batches):
        c = Counter(hash_bounds(ranges))
        for b in batches:
            for _, _, h, _, _ in _streams(b.column(0)):
                yield from c.add(h)
        yield from c.flush()

    def write_words(batches):
        for t in key_groups(batches, 1):
            s = t.column("shard")[0].as_py()
            keys, counts = _merged(t)
            write_arrays(f"{folder}/l1-{s}", {**{f"k_{k}": v for k, v in build(keys, 1 << 64).items()}, "count": counts})
            # where this range's tokens as contexts fill a shard of level 2, and tokens that fill several
            ahead = counts.copy()
            ahead[keys == END] = 0
            step = np.cumsum(ahead) // most
            cuts = np.flatnonzero(np.diff(step, prepend=0) > 0) + 1
            heavy = np.flatnonzero(ahead > most)
            at = int(np.searchsorted(keys, END))
            ends = int(counts[at]) if at < len(keys) and keys[at] == END else 0
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([len(keys)]), pa.array([int(counts.sum())]), pa.array([ends]), pa.array([cuts], pa.list_(pa.int64())), pa.array([heavy], pa.list_(pa.int64())), pa.array([ahead[heavy]], pa.list_(pa.int64()))], names=["s", "n", "tokens", "ends", "cuts", "heavy", "load"])

    def dealt(counted: DataFrame) -> DataFrame:
        return counted.repartition("shard").sortWithinPartitions("shard")

    facts = {r["s"]: r for r in dealt(texts.mapInArrow(tidy(count_words), _COUNTED)).mapInArrow(tidy(write_words), "s bigint, n bigint, tokens bigint, ends bigint, cuts array<bigint>, heavy array<bigint>, load array<bigint>").collect()}
    bases = np.r_[0, np.cumsum([facts[s]["n"] if s in facts else 0 for s in range(ranges)])]
    words, tokens, docs = int(bases[-1]), sum(r["tokens"] for r in facts.values()), sum(r["ends"] for r in facts.values())
    width = words + 1
    cuts = {(words, 0)} if words else set()

    def split(v: int, load: int) -> None:
        parts = -(-load // most)
        cuts.update((v, width * k // parts) for k in range(parts))
        cuts.add((v + 1, 0))

    for s, r in facts.items():
        cuts.update((int(bases[s]) + c, 0) for c in r["cuts"])
        for v, load in zip(r["heavy"], r["load"], strict=True):
            split(int(bases[s]) + v, load)
    if docs > most:
        split(words, docs)
    bounds2 = np.array(sorted(v * width + w for v, w in cuts if 0 < v * width + w < width * width), np.uint64)
    trie = Trie(folder, tokens, words, docs, d, tuple(int(x) for x in bases), bounds2, np.zeros(len(bounds2) + 2, np.int64), 1, None, None)

    def count_pairs(batches):
        m, c = Model(trie), Counter(bounds2)
        for b in batches:
            for _, _, h, first, _ in _streams(b.column(0)):
                own, _, back = m.ids(h)
                yield from c.add(m.key2(own[m.contexts(back, first, len(own) - 1)], own[back]))
        yield from c.flush()

    def write_pairs(batches):
        m = Model(trie)
        for t in key_groups(batches, 1):
            s = t.column("shard")[0].as_py()
            keys, counts = _merged(t)
            parent = (keys // np.uint64(width)).astype(np.int64)
            lo, hi = int(parent[0]), int(parent[-1])
            begin = np.searchsorted(parent, np.arange(lo, hi + 2))
            own = np.unique(parent)
            total = np.full(len(own), float(docs))
            words_only = own < words
            total[words_only] = _counts_of(m.level1, own[words_only])
            alpha = (counts - d) / total[np.searchsorted(own, parent)]
            write_arrays(f"{folder}/l2-{s}", {**{f"k_{k}": v for k, v in build(keys, width * width).items()}, **{f"p_{k}": v for k, v in build(begin, len(keys) + 1).items()}, "code": encode_probability(alpha), **count_arrays(counts)}, parent=lo)
            ahead = counts.copy()
            step = np.cumsum(ahead) // most
            heavy = np.flatnonzero(ahead > most)
            degree = np.diff(begin)
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([len(keys)]), pa.array([lo]), pa.array([hi]), pa.array([int(degree[0])]), pa.array([int(degree[-1])]), pa.array([int(degree.max())]), pa.array([np.flatnonzero(np.diff(step, prepend=0) > 0) + 1], pa.list_(pa.int64())), pa.array([heavy], pa.list_(pa.int64())), pa.array([ahead[heavy]], pa.list_(pa.int64()))], names=["s", "n", "lo", "hi", "dlo", "dhi", "dmax", "cuts", "heavy", "load"])

    facts = {r["s"]: r for r in dealt(texts.mapInArrow(tidy(count_pairs), _COUNTED)).mapInArrow(tidy(write_pairs), "s bigint, n bigint, lo bigint, hi bigint, dlo bigint, dhi bigint, dmax bigint, cuts array<bigint>, heavy array<bigint>, load array<bigint>").collect()} if words else {}
    bases2 = np.r_[0, np.cumsum([facts[s]["n"] if s in facts else 0 for s in range(len(bounds2) + 1)])]
    # a parent whose children lie in several shards is the first or last of each
    edge: dict[int, int] = {}
    for r in facts.values():
        edge[r["lo"]] = edge.get(r["lo"], 0) + r["dlo"]
        if r["hi"] != r["lo"]:
            edge[r["hi"]] = edge.get(r["hi"], 0) + r["dhi"]
    degree = max([1, *edge.values(), *(r["dmax"] for r in facts.values())])
    bits = int(degree).bit_length()
    trie = Trie(folder, tokens, words, docs, d, trie.vocabulary, bounds2, bases2, bits, None, None)
    if params.order < 3 or not words:
        return trie
    if int(bases2[-1]).bit_length() + bits > 64:
        raise ValueError("too many pairs for 64-bit keys")
    cuts3: set[int] = set()
    for s, r in facts.items():
        cuts3.update((int(bases2[s]) + c) << bits for c in r["cuts"])
        for v, load in zip(r["heavy"], r["load"], strict=True):
            parts = -(-load // most)
            cuts3.update(((int(bases2[s]) + v) << bits) + (k << bits) // parts for k in range(parts))
            cuts3.add((int(bases2[s]) + v + 1) << bits)
    bounds3 = np.array(sorted(c for c in cuts3 if 0 < c < int(bases2[-1]) << bits), np.uint64)
    trie2 = trie

    def count_triples(batches):
        m, c = Model(trie2), Counter(bounds3)
        for b in batches:
            for _, _, h, first, _ in _streams(b.column(0)):
                own, _, back = m.ids(h)
                before = m.contexts(back, first, len(own) - 1)
                (place,) = m.pairs(own[before], own[back])
                node = np.r_[np.int64(-1), place[:-1]]
                node[first] = -1
                at = np.flatnonzero(node >= 0)
                yield from c.add(m.key3(node[at], place[at] - m.starts2(own)[before[at]]))
        yield from c.flush()

    def write_triples(batches):
        for t in key_groups(batches, 1):
            s = t.column("shard")[0].as_py()
            keys, counts = _merged(t)
            parent = (keys >> np.uint64(bits)).astype(np.int64)
            lo, hi = int(parent[0]), int(parent[-1])
            begin = np.searchsorted(parent, np.arange(lo, hi + 2))
            # c(uv) as a context; its children lie in this shard but for parents that were split or sit on an edge
            total = np.add.reduceat(counts, np.searchsorted(parent, np.unique(parent)))[np.searchsorted(np.unique(parent), parent)]
            total = np.maximum(total, _pair_counts(Model(trie2), np.array([lo, hi]))[(parent == hi).astype(int)] * ((parent == lo) | (parent == hi)))
            universe = int(bases2[-1]) << bits
            write_arrays(f"{folder}/l3-{s}", {**{f"k_{k}": v for k, v in build(keys, universe).items()}, **{f"p_{k}": v for k, v in build(begin, len(keys) + 1).items()}, "code": encode_probability((counts - d) / total)}, parent=lo)
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([len(keys)])], names=["s", "n"])

    facts3 = {r["s"]: r["n"] for r in dealt(texts.mapInArrow(tidy(count_triples), _COUNTED)).mapInArrow(tidy(write_triples), "s bigint, n bigint").collect()}
    bases3 = np.r_[0, np.cumsum([facts3.get(s, 0) for s in range(len(bounds3) + 1)])]
    return Trie(folder, tokens, words, docs, d, trie.vocabulary, bounds2, bases2, bits, bounds3, bases3)


def _counts_of(level1: Level, ident: np.ndarray) -> np.ndarray:
    """Counts of tokens by their ids."""
    out = np.zeros(len(ident))
    for s, at in level1._by_shard(np.searchsorted(level1.bases, ident, "right") - 1):
        out[at] = level1.shard(s)[0]["count"][ident[at] - level1.bases[s]]
    return out


def _pair_counts(m: Model, place: np.ndarray) -> np.ndarray:
    """Counts of pairs by their places."""
    out = np.zeros(len(place), np.int64)
    for s, at in m.level2._by_shard(np.searchsorted(m.level2.bases, place, "right") - 1):
        out[at] = read_counts(m.level2.shard(s)[0], place[at] - m.level2.bases[s])
    return out


def score_texts(documents: DataFrame, trie: Trie, carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry`` columns of each row with ``n_tokens, n_known, base_score, score`` of its whole text.

    A null text is the empty text, whose one token is the end. With no training text every token has
    probability 1 in both scores. Equal texts have equal scores, repeated rows are scored each for itself, and an
    empty table gives no rows. A text of any length is scored whole. Columns beyond ``carry`` aren't read; a new
    column takes the place of a carried one of its name.
    """
    carry = without_names(carry, ["n_tokens", "n_known", "base_score", "score"])
    shared = documents.sparkSession.sparkContext.broadcast(trie)
    kept = documents.select(*carry, text_or_empty(text_col).alias(free_name("_text", carry)))
    out = ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes[:-1]), "n_tokens bigint, n_known bigint, base_score double, score double"])

    def run(batches):
        m = _model(shared.value)
        for b in batches:
            cols = [[], [], [], []]
            for lo, hi, h, first, size in _streams(b.column(b.num_columns - 1)):
                known, base, model = m.score(h, first)
                cols[0].append(size)
                for c, x in zip(cols[1:], (known.astype(np.int64), base, model), strict=True):
                    c.append(np.add.reduceat(x, first) if len(first) else x[:0])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(np.concatenate(c) if c else np.zeros(0, np.int64 if i < 2 else float)) for i, c in enumerate(cols)]], names=[*carry, "n_tokens", "n_known", "base_score", "score"])

    return kept.mapInArrow(tidy(run), out)
