"""Token ids of a public byte-level BPE tokenizer, in executor tasks.

The vocabulary file stays where the machine has it; its path is a parameter. Ids are those of the
``tokenizers`` library for that file with ``add_special_tokens=False``. That library spends most
of its time on bookkeeping per token, so its file is loaded into ``tiktoken``, which merges the
same ranks over the same split several times faster; probe texts are encoded both ways when a
worker loads the file, and wherever the two would differ, the slower library is used.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textkit as tk

#: Fixed value: the split of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBES = ["", " ", "a", "Hello  world\n\n  it's 12345 ~~ ok", "é ñ ü ß 中文 🙂‍", "\t x\r\n y   ", "!!! $$$%%%\x00\x01", "x" * 300, "naïve|<|x|>"]
_loaded: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes each byte as a letter: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts to ids; falls back to ``tokenizers`` where the fast way isn't proven equal."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(path)
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.marks = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            import tiktoken

            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
            fast = tiktoken.Encoding("bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            if all(fast.encode_ordinary(p) == self.slow.encode(p, add_special_tokens=False).ids for p in _PROBES):
                self.fast = fast

    def __call__(self, text: str) -> list[int]:
        if self.fast is None:
            return self.slow.encode(text, add_special_tokens=False).ids
        try:
            if self.marks is None or self.marks.search(text) is None:
                return self.fast.encode_ordinary(text)
            return [i for part in self.marks.split(text) if part for i in ([self.special[part]] if part in self.special else self.fast.encode_ordinary(part))]
        except BaseException as e:  # the fast splitter gives up on some degenerate texts, with an error of its own kind
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.slow.encode(text, add_special_tokens=False).ids


#: White space as the split sees it, without the plain space.
_BLANK = r"[\t-\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


class TokenCounter:
    """Number of ids of each text of a column, without making the ids of all of it.

    The split never joins what stands on both sides of a space that a non-space follows, so a text's count
    is the sum of its words' counts. Each distinct word of a slice of texts is encoded once, all of them in one
    call, with tabs between them. Texts with white space after a space, and words with a tab or with white space
    at an end, are encoded by themselves.
    """

    def __init__(self, encode: Encoder):
        self.encode = encode

    def __call__(self, column: pa.Array) -> np.ndarray:
        column = column.cast(pa.large_string()).fill_null("")
        out = np.zeros(len(column), np.int64)
        if not len(column):
            return out
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        for lo, hi in tk.slices(off, 16 << 20):
            part = column.slice(lo, hi - lo)
            odd = pc.or_(pc.match_substring(part, "  "), pc.match_substring_regex(part, " " + _BLANK))
            for mark in self.encode.special:
                odd = pc.or_(odd, pc.match_substring(part, mark))
            odd = odd.to_numpy(zero_copy_only=False) if self.encode.fast is not None else np.ones(len(part), bool)
            for i in np.flatnonzero(odd):
                out[lo + i] = len(self.encode(part[i].as_py()))
            at = np.flatnonzero(~odd)
            if len(at):
                words = pc.split_pattern(part.take(pa.array(at)), " ")
                first = words.offsets.to_numpy()[:-1] - words.offsets[0].as_py()
                coded = words.flatten().dictionary_encode()
                index = coded.indices.to_numpy()
                size = self._after_space(coded.dictionary)[index]
                # a text's first word has no space before it
                size[first] = [len(self.encode.fast.encode_ordinary(w)) for w in coded.dictionary.take(pa.array(index[first])).to_pylist()]
                out[lo + at] = np.add.reduceat(size, first)
        return out

    def _after_space(self, words: pa.Array) -> np.ndarray:
        """Number of ids of each word with a space before it."""
        alone = pc.or_(pc.match_substring_regex(words, f"\t|^{_BLANK}|{_BLANK}$"), pc.equal(words, "")).to_numpy(zero_copy_only=False)
        out = np.zeros(len(words), np.int64)
        for i in np.flatnonzero(alone):
            out[i] = len(self.encode.fast.encode_ordinary(" " + words[i].as_py()))
        rest = np.flatnonzero(~alone)
        if len(rest):
            (tab,) = self.encode.fast.encode_ordinary("\t")
            plain = words.take(pa.array(rest)).cast(pa.string())  # of a slice of texts, so short enough
            row = pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain)
            ids = np.frombuffer(array("I", self.encode.fast.encode_ordinary(" " + pc.binary_join(row, "\t ")[0].as_py())), np.uint32)
            ends = np.flatnonzero(ids == tab)
            out[rest] = np.diff(np.r_[-1, ends, len(ids)]) - 1
        return out


def encoder(path: str | None) -> Encoder:
    """The worker's encoder for ``path``; a worker loads it once."""
    path = path or default_path()
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
