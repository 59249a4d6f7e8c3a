"""Suffix arrays in numpy: Larsson-Sadakane refinement, to the end or to the width of a window, and repeated windows.

Strings are arrays of symbols: bytes (uint8), or ranks of words (uint32).
"""

from __future__ import annotations

import numpy as np


class Shard:
    """Strings laid out one after another, each followed by an end mark that sorts before any symbol."""

    def __init__(self, strings: list[np.ndarray]):
        size = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(size + 1) - (size + 1)
        self.size = size
        n = int(size.sum() + len(size))
        symbols = np.concatenate(strings) if len(strings) else np.zeros(0, np.uint8)
        self.text = np.zeros(n, np.int16 if symbols.dtype == np.uint8 else np.int32)
        inside = np.ones(n, bool)
        inside[self.start + size] = False
        self.text[inside] = symbols.astype(self.text.dtype) + 1
        #: the end mark of the string that each position belongs to
        self.end = np.repeat((self.start + size).astype(np.int32), size + 1)


def _sorted(shard: Shard, depth: int | None) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of the shard's strings, in order by their first ``depth`` symbols (None: by all), and the places
    among them of those that tie with another: each of these has ``depth`` symbols and shares them all.

    Suffixes are first ranked by as many symbols as fit 63 bits. Each refinement sorts only the groups that still
    tie, by the ranks of the suffixes that start ``h``, ``2 h``, ... further on, which at least doubles the sorted length. A
    suffix that ends sooner ties with none.
    """
    n = len(shard.text)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    # places fit 32 bits: a shard is a few megabytes
    places = np.arange(n, dtype=np.int32)
    bits = max(1, int(shard.text.max()).bit_length())
    h = min(63 // bits, depth or 63)
    key = np.zeros(n, np.int64)
    left = shard.end - places
    for k in range(h):
        key <<= bits
        if k < n:
            key[: n - k] += np.where(left[: n - k] >= k, shard.text[k:], 0)
    sa = np.argsort(key).astype(np.int32)
    key = key[sa]
    # suffixes that reach an end mark differ by their string; they are few, and only they share a key
    short = np.flatnonzero(left[sa] < h)
    sa[short] = sa[short][np.lexsort((sa[short], key[short]))]
    head = np.r_[True, key[1:] != key[:-1]] | (left[sa] < h)
    del key, left
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head, places, 0))
    tied = places[~(head & np.r_[head[1:], True])]
    # as many ranks as fit 63 bits make one number, which sorts faster than several keys
    size = n.bit_length()
    while len(tied) and (depth is None or h < depth):
        at = sa[tied]
        key = rank[at].astype(np.int64)
        step = h
        for k in range(1, 63 // size):
            step = k * h if depth is None else min(k * h, depth - h)
            # beyond the end of a string no rank counts, since the one before tells it from all others
            key = (key << size) | rank[np.minimum(at + step, n - 1)]
            if depth is not None and step == depth - h:
                break
        order = np.argsort(key)
        sa[tied] = at[order]
        key = key[order]
        head = np.r_[True, key[1:] != key[:-1]]
        rank[sa[tied]] = np.maximum.accumulate(np.where(head, tied, 0).astype(np.int32))
        tied = tied[~(head & np.r_[head[1:], True])]
        h += step
    return sa, tied


def suffix_array(shard: Shard) -> np.ndarray:
    """All suffixes of the shard's strings in order; where one string ends, the earlier string sorts first."""
    return _sorted(shard, None)[0]


def repeated_starts(strings: list[np.ndarray], width: int) -> list[np.ndarray]:
    """For each string, which of its window starts (``width`` symbols each) begin a window that also starts elsewhere in the shard."""
    shard = Shard(strings)
    sa, tied = _sorted(shard, width)
    found = np.zeros(len(sa), bool)
    found[sa[tied]] = True
    return [found[a : a + max(0, n - width + 1)] for a, n in zip(shard.start, shard.size, strict=True)]


def reach(parts: list[np.ndarray], group: list[int], most: int) -> np.ndarray:
    """For each string the longest prefix, up to ``most`` symbols, that it shares with another of its group.

    Among sorted strings the neighbours share the longest prefixes.
    """
    out = np.zeros(len(parts), np.int64)
    if not len(parts):
        return out
    unit = 1 if parts[0].dtype == np.uint8 else 4
    data = [p[:most].tobytes() if unit == 1 else p[:most].astype(">u4").tobytes() for p in parts]
    order = sorted(range(len(parts)), key=lambda i: (group[i], data[i]))
    for lo in range(0, len(order), 2048):
        at = order[lo : lo + 2049]
        size = np.array([len(data[i]) for i in at])
        grid = np.zeros((len(at), most * unit), np.uint8)
        grid[np.arange(most * unit) < size[:, None]] = np.frombuffer(b"".join(data[i] for i in at), np.uint8)
        differ = np.concatenate([grid[1:] != grid[:-1], np.ones((len(at) - 1, 1), bool)], axis=1)
        shared = np.minimum(differ.argmax(axis=1), np.minimum(size[1:], size[:-1])) // unit
        g = np.array([group[i] for i in at])
        shared[g[1:] != g[:-1]] = 0
        at = np.array(at)
        out[at[:-1]] = np.maximum(out[at[:-1]], shared)
        out[at[1:]] = np.maximum(out[at[1:]], shared)
    return out


def repeated_around(strings: list[np.ndarray], group: list[int], anchor: list[int], width: int) -> list[np.ndarray]:
    """As ``repeated_starts``, for windows over an anchor: ``anchor`` is its offset, and equal windows have it at equal offsets in strings of one ``group``.

    What a string shares with any other of its group on either side of the anchor bounds where its
    repeated windows lie; the rest is cut off before suffixes are sorted.
    """
    right = reach([s[a:] for s, a in zip(strings, anchor, strict=True)], group, width)
    left = reach([s[:a][::-1] for s, a in zip(strings, anchor, strict=True)], group, width)
    out = [np.zeros(max(0, len(s) - width + 1), bool) for s in strings]
    live = np.flatnonzero(left + right >= width)
    if len(live):
        begin = [anchor[i] - int(left[i]) for i in live]
        found = repeated_starts([strings[i][b : anchor[i] + int(right[i])] for i, b in zip(live, begin, strict=True)], width)
        for i, b, mark in zip(live, begin, found, strict=True):
            out[i][b : b + len(mark)] = mark
    return out
