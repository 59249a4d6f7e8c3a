"""Elias-Fano sequences in numpy, for files that are memory-mapped.

A monotone sequence of n numbers below u keeps the low bits of each number packed, and the high bits in
unary: about 2 + log2(u / n) bits a number. All queries work on arrays of arguments at once.
"""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

_ONE = np.uint64(1)
_BLOCK = 4  # words of high bits for which the ones and zeros before them are kept


def write_arrays(path: str, arrays: dict[str, np.ndarray], **facts) -> None:
    """Write arrays one after another under a JSON head; the file appears whole or not at all."""
    spec, at = {}, 0
    for k, a in arrays.items():
        spec[k] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps({"arrays": spec, "facts": facts}).encode()
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        f.write(b"\0" * (-f.tell() % 64))
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes())
            f.write(b"\0" * (-f.tell() % 64))
    os.replace(own, path)


def map_arrays(path: str) -> tuple[dict[str, np.ndarray], dict]:
    raw = np.memmap(path, np.uint8, "r").view(np.ndarray)  # still mapped; plain arrays slice faster
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    base = -(-(8 + n) // 64) * 64
    return {k: raw[base + at : base + at + size * np.dtype(t).itemsize].view(t) for k, (t, size, at) in head["arrays"].items()}, head["facts"]


def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of the sequence ``values`` (sorted, below ``universe``)."""
    values = values.astype(np.uint64)
    n = len(values)
    bits = max(0, (universe // max(1, n)).bit_length() - 1)
    top = (universe - 1 >> bits) if universe else 0
    high = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
    size = n + top + 1  # every number's one, and a zero after the numbers of each value of the high bits
    flags = np.zeros(-(-size // 64) * 64, np.uint8)
    flags[high] = 1
    words = np.packbits(flags, bitorder="little").view(np.uint64)
    low = np.zeros(-(-n * bits // 64) + 2, np.uint64)
    if bits and n:
        part = values & np.uint64((1 << bits) - 1)
        at = np.arange(n) * bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(low, word, part << shift)
        over = np.flatnonzero(shift + np.uint64(bits) > 64)
        np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
    words = np.r_[words, np.zeros(-len(words) % _BLOCK, np.uint64)]
    ones = np.r_[0, np.cumsum(np.bitwise_count(words).reshape(-1, _BLOCK).sum(axis=1))]
    zeros = np.arange(len(ones)) * (64 * _BLOCK) - ones
    small = np.int32 if len(words) * 64 < 1 << 31 else np.int64
    return {"low": low, "high": words, "ones": ones.astype(small), "zeros": zeros.astype(small), "meta": np.array([n, bits, top], np.int64)}


#: Position of the k-th one of a byte, at 8 * byte + k.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64).reshape(-1)
_EACH = np.uint64(0x0101010101010101)


def _select_in_word(w: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th one of each word: sums over its bytes side by side, then a table for the byte."""
    u = np.uint64
    x = w - ((w >> u(1)) & u(0x5555555555555555))
    x = (x & u(0x3333333333333333)) + ((x >> u(2)) & u(0x3333333333333333))
    upto = ((x + (x >> u(4))) & u(0x0F0F0F0F0F0F0F0F)) * _EACH
    full = ((k * _EACH | u(0x8080808080808080)) - upto) & u(0x8080808080808080)
    shift = np.bitwise_count(full).astype(np.uint64) << u(3)
    rest = k - ((upto << u(8)) >> shift & u(255))
    return shift.astype(np.int64) + _IN_BYTE[((w >> shift & u(255)) << u(3) | rest).astype(np.int64)]


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], prefix: str = ""):
        self.low, self.high, self.ones, self.zeros = (arrays[prefix + k] for k in ("low", "high", "ones", "zeros"))
        self.n, self.bits, self.top = (int(x) for x in arrays[prefix + "meta"])
        self.mask = np.uint64((1 << self.bits) - 1)

    def _select(self, k: np.ndarray, before: np.ndarray, flip: np.uint64) -> np.ndarray:
        """Position of the k-th (from 0) bit that is one, or with ``flip`` of all ones, zero."""
        block = np.searchsorted(before, k, "right") - 1
        left = k - before[block]
        word = block * _BLOCK
        w = self.high[word] ^ flip
        for _ in range(_BLOCK - 1):
            count = np.bitwise_count(w).astype(np.int64)
            on = left >= count
            left -= count * on
            word += on
            w = self.high[word] ^ flip
        return (word << 6) + _select_in_word(w, left.astype(np.uint64))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        got = self.low[word] >> shift
        more = (self.low[word + 1] << _ONE) << (np.uint64(63) - shift)
        return (got | more) & self.mask

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``."""
        if not len(i):
            return np.zeros(0, np.uint64)
        pos = self._select(i, self.ones, np.uint64(0))
        return ((pos - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each number, -1 where it isn't there.

        Numbers of equal high bits stand together; the first of them are looked at one by one, and
        where there are many the rest is searched by halves.
        """
        out = np.full(len(x), -1, np.int64)
        h = (x >> np.uint64(self.bits)).astype(np.int64)
        live = np.flatnonzero(h <= self.top)
        if not len(live) or not self.n:
            return out
        h = h[live]
        want = x[live] & self.mask
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        pos = np.zeros(len(h), np.int64)
        later = np.flatnonzero(h > 0)
        pos[later] = self._select(h[later] - 1, self.zeros, every) + 1
        lo = pos - h
        for _ in range(3):
            on = np.flatnonzero((self.high[pos >> 6] >> (pos & 63).astype(np.uint64)) & _ONE)
            live, pos, lo, want, h = live[on], pos[on], lo[on], want[on], h[on]
            got = self._low(lo)
            hit = got == want
            out[live[hit]] = lo[hit]
            go = np.flatnonzero(got < want)
            live, pos, lo, want, h = live[go], pos[go] + 1, lo[go] + 1, want[go], h[go]
            if not len(live):
                return out
        hi = self._select(h, self.zeros, every) - h
        while len(live):
            go = np.flatnonzero(lo < hi)
            live, lo, hi, want = live[go], lo[go], hi[go], want[go]
            mid = (lo + hi) >> 1
            got = self._low(mid)
            hit = got == want
            out[live[hit]] = mid[hit]
            less = got < want
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            lo = np.where(hit, hi, lo)
        return out
