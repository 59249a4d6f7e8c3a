"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Workers encode the texts; the alignment itself is relational. Tokens are exploded with their positions, a running sum
of their lengths in bytes gives each token's end, and an equi-join on document and end finds the cuts: the
offsets where tokens of both sides end. A cut's place among its document's cuts is its group's number; the
tokens between two cuts are a group, and the last two of it, which end together, are linked.

Side A is a byte-level BPE file of the ``tokenizers`` library, side B a ``sentencepiece`` model that adds a space before
the text, so A encodes a space and the text. A text takes part if the bytes of both sides' tokens are just
those; a null or empty text, or one with a character that a side writes otherwise (U+2581), has no tokens.

Both encoders are given each distinct word once while a worker remembers it: neither joins what stands on both sides of a
space that follows no space and precedes no white space. That is a property of A's split, and it is read off B's
vocabulary, where no piece has a space behind another character. Otherwise, and in texts with longer blanks, whole
texts are encoded.
"""

from __future__ import annotations

import hashlib
from array import array
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, ShortType, StructField, StructType

from .shared import bound_batches, discard, free_name, materialise, text_or_empty, tidy, without_names
from .tokenizing import _BLANK, _byte_letters, default_path, encoder

#: Words that a worker remembers, and words that are encoded at once.
WORDS_KEPT, WORDS_AT_ONCE = 1 << 18, 1 << 11
#: Bytes of text that a task aligns; beyond so many tasks they grow, and their sorts go to disk.
BYTES_A_TASK, MOST_TASKS = 2 << 20, 50_000
#: Pairs of ids that are broadcast, with 24 bytes each; more are joined by shuffling.
MOST_BROADCAST = 1 << 20
_loaded: dict[tuple[str, str], Pair] = {}


def default_piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Both encoders, each word's ids remembered."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        one = encoder(a_path)
        self.fast, self.slow = one.fast, Tokenizer.from_file(a_path)
        self.slow.encode_special_tokens = True
        letters = _byte_letters()
        vocabulary = self.slow.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        probe = ["a b", "Hello there, world's end of\n12 lines", "é 中文 🙂 ok"]
        self.by_words = self.fast is not None and not any("▁" in p.lstrip("▁") for p in pieces)
        self.by_words = self.by_words and all(self.b.encode(p) == [i for w in p.split(" ") for i in self.b.encode(w)] for p in probe)
        self.begins = np.array([p.startswith("▁") for p in pieces])
        self.sizes = tuple(np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.data = tuple(np.frombuffer(b"".join(x), np.uint8) for x in (self.a_bytes, self.b_bytes))
        #: What is taken off ids, so that two bytes hold them.
        self.shift = 1 << 15 if max(map(len, self.sizes)) <= 1 << 16 else 0
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        none = np.zeros(0, np.int32)
        self.ids, self.size, self.fine = (none, none), (none, none), np.zeros(0, bool)

    def plain(self, text: str) -> list[int]:
        """A's ids of a text; the strings of special tokens are ordinary text."""
        if self.fast is not None:
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # the fast splitter gives up on some degenerate texts, with an error of its own kind
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return self.slow.encode(text, add_special_tokens=False).ids

    def both(self, texts: list[str]) -> list[tuple[list[int], list[int], bool]]:
        """Ids of each side, and whether both have the bytes of a space and the text."""
        out = []
        for t, b in zip(texts, self.b.encode(texts, num_threads=1) if texts else [], strict=True):
            a, own = self.plain(" " + t), (" " + t).encode()
            out.append((a, b, b"".join([self.a_bytes[i] for i in a]) == own and b"".join([self.b_bytes[i] for i in b]) == own))
        return out

    def _bytes(self, side: int, ids: np.ndarray) -> np.ndarray:
        size = self.sizes[side][ids]
        start = np.cumsum(self.sizes[side]) - self.sizes[side]
        return self.data[side][np.repeat(start[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]

    def _words(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray] | None:
        """Each side's ids and their number for every word, and whether the bytes are right; nothing if words can't be told apart."""
        (tab,) = self.fast.encode_ordinary("\t")
        ids, size, fine = [], [], np.ones(len(words), bool)
        joined = np.frombuffer(array("I", self.plain(" " + "\t ".join(words))), np.uint32).astype(np.int32)
        marks = np.flatnonzero(joined == tab)
        if len(marks) != len(words) - 1:
            return None
        size.append((np.diff(np.r_[-1, marks, len(joined)]) - 1).astype(np.int32))
        ids.append(np.delete(joined, marks))
        parts = self.b.encode([" ".join(words[k : k + WORDS_AT_ONCE]) for k in range(0, len(words), WORDS_AT_ONCE)], num_threads=1)
        ids.append(np.concatenate([np.array(p, np.int32) for p in parts]))
        starts = np.flatnonzero(self.begins[ids[1]])
        if len(starts) != len(words) or starts[0] != 0:
            return None
        size.append(np.diff(np.r_[starts, len(ids[1])]).astype(np.int32))
        own = np.frombuffer((" " + " ".join(words)).encode(), np.uint8)
        length = np.array([len(w.encode()) + 1 for w in words])
        first = np.cumsum(length) - length
        for side in (0, 1):
            got = np.add.reduceat(self.sizes[side][ids[side]], np.cumsum(size[side]) - size[side])
            if (got != length).any():
                return None
            fine &= np.add.reduceat(self._bytes(side, ids[side]) != own, first) == 0
        return ids, size, fine

    def _learn(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.slot]
        odd = pc.match_substring_regex(pa.array(new, pa.string()), f"\t|▁|^$|^{_BLANK}|{_BLANK}$").to_numpy(zero_copy_only=False) if new else np.zeros(0, bool)
        even = [w for w, o in zip(new, odd, strict=True) if not o]
        found = self._words(even) if even else None
        rest = [w for w, o in zip(new, odd, strict=True) if o or found is None]
        for group, known in ((even if found is not None else [], found), (rest, None)):
            if not group:
                continue
            if known is None:
                each = self.both(group)
                known = [np.array([i for x in each for i in x[side]], np.int32) for side in (0, 1)], [np.array([len(x[side]) for x in each], np.int32) for side in (0, 1)], np.array([x[2] for x in each])
            self.slot.update(zip(group, range(len(self.slot), len(self.slot) + len(group)), strict=True))
            self.ids, self.size = (tuple(np.concatenate(x) for x in zip(old, more, strict=True)) for old, more in ((self.ids, known[0]), (self.size, known[1])))
            self.fine = np.concatenate([self.fine, known[2]])
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))

    def __call__(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Both sides' ids of all texts, and where each text's begin; none for a text that takes no part."""
        column = column.cast(pa.large_string()).fill_null("")
        n = len(column)
        empty = pc.equal(column, "")
        if self.by_words:
            odd = pc.or_(pc.match_substring(column, "  "), pc.match_substring_regex(column, f" {_BLANK}|^ | $|^{_BLANK}"))
            at = np.flatnonzero(~pc.or_(odd, empty).to_numpy(zero_copy_only=False))
        else:
            at = np.zeros(0, np.int64)
        whole = np.setdiff1d(np.flatnonzero(~empty.to_numpy(zero_copy_only=False)), at)
        got = self.both(column.take(pa.array(whole, pa.int64())).to_pylist())
        counts, flats = [np.zeros(n, np.int64), np.zeros(n, np.int64)], []
        bad = np.zeros(n, bool)
        bad[whole] = [not fine for _, _, fine in got]
        if len(at):
            words = pc.split_pattern(column.take(pa.array(at, pa.int64())), " ")
            first = words.offsets.to_numpy()[:-1] - words.offsets[0].as_py()
            coded = words.flatten().dictionary_encode()
            if len(self.slot) + len(coded.dictionary) > WORDS_KEPT:
                self._forget()
            slot = self._learn(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            bad[at] = np.add.reduceat((~self.fine)[slot].astype(np.int64), first) > 0
        for side in (0, 1):
            lists = {int(k): x[side] for k, x in zip(whole, got, strict=True)}
            if len(at):
                size = self.size[side][slot].astype(np.int64)
                start = (np.cumsum(self.size[side]) - self.size[side])[slot]
                before = np.cumsum(size) - size
                flat = self.ids[side][np.repeat(start - before, size) + np.arange(int(size.sum()))]
                counts[side][at] = np.add.reduceat(size, first)
            else:
                flat = np.zeros(0, np.int32)
            of_plain = counts[side].copy()
            for k, x in lists.items():
                counts[side][k] = len(x)
            off = np.r_[0, np.cumsum(counts[side])]
            if lists:
                values, start = np.empty(off[-1], np.int32), np.r_[0, np.cumsum(of_plain)]
                values[np.repeat(off[:-1] - start[:-1], of_plain) + np.arange(len(flat))] = flat
                for k, x in lists.items():
                    values[off[k] : off[k + 1]] = x
                flat = values
            if bad.any():
                flat = flat[np.repeat(~bad, counts[side])]
                off = np.r_[0, np.cumsum(np.where(bad, 0, counts[side]))]
            flats.append((flat, off))
        return flats


def pair(a_path: str | None, b_path: str | None) -> Pair:
    """The worker's encoders; a worker loads them once."""
    key = (a_path or default_path(), b_path or default_piece_path())
    if key not in _loaded:
        _loaded[key] = Pair(*key)
    return _loaded[key]


def encoded(documents: DataFrame, carry: list[str], a_path: str | None = None, b_path: str | None = None, text_col: str = "text") -> DataFrame:
    """``carry`` columns of each row with ``n_a`` and ``ids``: A's ids and, from place ``n_a`` on, B's, less ``Pair.shift``.

    So they take two bytes each where the vocabularies allow. ``unpacked`` gives both sides. New columns take the place of carried ones.
    """
    bound_batches(documents.sparkSession)
    carry = without_names(carry, ["n_a", "ids"])
    kept = documents.select(*carry, text_or_empty(text_col).alias(free_name("_text", carry)))
    shift = pair(a_path, b_path).shift
    kind, arrow = (ShortType(), pa.int16()) if shift else (IntegerType(), pa.int32())
    schema = StructType([*kept.schema.fields[:-1], StructField("n_a", IntegerType(), False), StructField("ids", ArrayType(kind, False), False)])

    def run(batches):
        encode = pair(a_path, b_path)
        for batch in batches:
            (a, a_off), (b, b_off) = encode(batch.column(batch.num_columns - 1))
            n_a, off = np.diff(a_off), a_off + b_off
            flat = np.empty(len(a) + len(b), np.int32)
            flat[np.repeat(b_off[:-1], n_a) + np.arange(len(a))] = a
            flat[np.repeat(a_off[1:], np.diff(b_off)) + np.arange(len(b))] = b
            ids = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array((flat - shift).astype(arrow.to_pandas_dtype())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_a, pa.int32()), ids], names=schema.names)

    return kept.mapInArrow(tidy(run), schema)


def unpacked(tokens: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``tokens`` with ``a`` and ``b``, the ids of both sides, in place of ``n_a`` and ``ids``."""
    shift = pair(a_path, b_path).shift
    whole = lambda c: F.transform(c, lambda x: x.cast("int") + shift)
    return tokens.withColumns({"a": whole(_side("a")), "b": whole(_side("b"))}).drop("n_a", "ids")


def _side(side: str):
    return F.slice("ids", F.lit(1), F.col("n_a")) if side == "a" else F.slice("ids", F.col("n_a") + 1, F.size("ids") - F.col("n_a"))


def lengths(spark: SparkSession, a_path: str | None = None, b_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(id, n)`` of both vocabularies: a token's bytes, its id less the shift. As many rows as the files have entries."""
    one = pair(a_path, b_path)
    kind = pa.int16() if one.shift else pa.int32()
    return tuple(spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(x)) - one.shift, kind), "n": pa.array(x, pa.int32())})) for x in one.sizes)


@contextmanager
def joins_within(spark: SparkSession):
    """Rows dealt out by document stay where they are for a join on document and end, in plans that run within."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def token_ends(dealt: DataFrame, side: str, sizes: DataFrame) -> DataFrame:
    """``(_k, end, pos)`` of every token of a side (``a`` or ``b``): where it ends, in bytes from the document's start.

    Rows come dealt out by document and sorted by it, so that sorts of tokens find them in order.
    """
    # the outer form keeps filters out of the exchange below, which all readers share
    each = dealt.select("_k", F.posexplode_outer(_side(side)).alias("pos", "id")).where("pos is not null").join(F.broadcast(sizes), "id")
    return each.select("_k", F.sum("n").over(Window.partitionBy("_k").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("end"), "pos")


def align(tokens: DataFrame, tasks: int, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``tokens`` (of ``encoded``, with a unique ``_k`` that isn't null) with ``cut_a`` and ``cut_b``, to be run within ``joins_within``.

    Those are the positions of each group's last token on either side, in order, so that a cut's place among them is the running
    count of cuts; a row without tokens has none. Token arrays are shuffled once, by ``_k``: both sides' tokens, their
    join, its grouping and the join of its result stay in the same tasks.
    """
    dealt = tokens.repartition(tasks, "_k").sortWithinPartitions("_k")
    a, b = (token_ends(dealt, side, sizes).withColumnRenamed("pos", f"cut_{side}") for side, sizes in zip("ab", lengths(tokens.sparkSession, a_path, b_path), strict=True))
    # positions rise with the ends, so that each side's order is that of the cuts
    cuts = a.join(b.hint("merge"), ["_k", "end"]).groupBy("_k").agg(*[F.array_sort(F.collect_list(c)).alias(c) for c in ("cut_a", "cut_b")])
    none = F.array().cast("array<int>")
    return dealt.join(cuts.hint("merge"), "_k", "left").withColumns({c: F.coalesce(c, none) for c in ("cut_a", "cut_b")})


def groups(aligned: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns with ``group``, ``a_ids`` and ``b_ids`` for each group of each row of ``align``'s result, unpacked."""

    def own(side: str):
        last = F.get(f"cut_{side}", F.col("group"))
        before = F.when(F.col("group") > 0, F.get(f"cut_{side}", F.col("group") - 1)).otherwise(-1)
        return F.slice(side, before + 2, last - before).alias(f"{side}_ids")

    return aligned.select(*carry, "a", "b", "cut_a", "cut_b", F.posexplode("cut_a").alias("group", "_")).select(*carry, "group", own("a"), own("b"))


def links(aligned: DataFrame, carry: list[str], kind: str = "end") -> DataFrame:
    """``carry`` columns with ``a_pos, b_pos, a_id, b_id`` for each link of each row of ``align``'s result, unpacked.

    ``end``: the tokens that end together, one pair a group. ``group``: all pairs of a group, which a group of many
    tokens squares; the first is the one that bounds its rows by the tokens.
    """
    if kind == "end":
        each = aligned.select(*carry, "a", "b", F.explode(F.arrays_zip("cut_a", "cut_b")).alias("c")).select(*carry, "a", "b", F.col("c.cut_a").alias("a_pos"), F.col("c.cut_b").alias("b_pos"))
        return each.select(*carry, "a_pos", "b_pos", F.get("a", F.col("a_pos")).alias("a_id"), F.get("b", F.col("b_pos")).alias("b_id"))
    if kind != "group":
        raise ValueError("links are of kind end or group")
    each = aligned.select(*carry, "a", "b", "cut_a", "cut_b", F.posexplode("cut_a").alias("group", "_"))

    def span(side: str):
        last = F.get(f"cut_{side}", F.col("group"))
        return F.sequence(F.when(F.col("group") > 0, F.get(f"cut_{side}", F.col("group") - 1) + 1).otherwise(0), last)

    each = each.select(*carry, "a", "b", F.explode(span("a")).alias("a_pos"), span("b").alias("_s"))
    each = each.select(*carry, "a", "b", "a_pos", F.explode("_s").alias("b_pos"))
    return each.select(*carry, "a_pos", "b_pos", F.get("a", F.col("a_pos")).alias("a_id"), F.get("b", F.col("b_pos")).alias("b_id"))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(), off - off[0]


def summed_up(aligned: DataFrame, carry: list[str], shift: int) -> DataFrame:
    """``carry`` columns of ``align``'s result with ``n_a, n_b, n_groups, groups_sha256`` and the links: ``pairs`` (A's id times 2^32 plus B's) and how ``often``."""
    names = ["n_a", "n_b", "n_groups", "groups_sha256", "pairs", "often"]
    kept = aligned.select(*carry, "n_a", "ids", "cut_a", "cut_b")
    fields = [*kept.dtypes[:-4], *zip(names, ("long", "long", "long", "string", "array<bigint>", "array<int>"), strict=True)]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                (ids, off), (cut_a, c_off), (cut_b, _) = (_flat(part.column(part.num_columns - 3 + k)) for k in range(3))
                n_a = part.column(part.num_columns - 4).to_numpy()
                a_off = np.r_[0, np.cumsum(n_a)]
                b_off = off - a_off
                ids = ids.astype(np.int64) + shift
                of_a = np.arange(len(ids)) - np.repeat(off[:-1], np.diff(off)) < np.repeat(n_a, np.diff(off))
                a, b = ids[of_a], ids[~of_a]
                row = np.repeat(np.arange(part.num_rows), np.diff(c_off))
                ends = [cut + off[row] for cut, off in ((cut_a, a_off), (cut_b, b_off))]
                # a token's place among all: its group, A before B
                place = np.concatenate([2 * np.searchsorted(ends[0], np.arange(len(a))), 2 * np.searchsorted(ends[1], np.arange(len(b))) + 1])
                order = np.argsort(place, kind="stable")
                place = place[order]
                mark = np.zeros(len(place), np.int64)
                if len(place):
                    new = np.r_[True, place[1:] != place[:-1]]
                    mark[new] = 1 + (place[new] & 1)
                    mark[(a_off + b_off)[:-1][np.diff(a_off) > 0]] = 3
                said = pc.binary_join_element_wise(pa.array([",", ";", "|", ""]).take(pa.array(mark)).cast(pa.large_string()), pa.array(np.concatenate([a, b])[order]).cast(pa.large_string()), pa.scalar("", pa.large_string()))
                at = np.frombuffer(said.buffers()[1], np.int64)[said.offset : said.offset + len(said) + 1][a_off + b_off] if len(said) else np.zeros(part.num_rows + 1, np.int64)
                data = memoryview(said.buffers()[2]) if len(said) else b""
                digest = [hashlib.sha256(data[s:e]).hexdigest() if e > s else "" for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                key = (a[ends[0]] << 32) | b[ends[1]]
                found = [np.unique(key[s:e], return_counts=True) for s, e in zip(c_off[:-1], c_off[1:], strict=True)]
                off = np.r_[0, np.cumsum([len(x) for x, _ in found])]
                lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *[x[k] for x in found]]), t)) for k, t in ((0, pa.int64()), (1, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-4], *[pa.array(np.diff(x), pa.int64()) for x in (a_off, b_off, c_off)], pa.array(digest, pa.string()), *lists], names=[f[0] for f in fields])

    return kept.mapInArrow(tidy(run), ", ".join(f"`{c}` {t}" for c, t in fields))


def pair_counts(summed: DataFrame) -> DataFrame:
    """``(pair, count, best)``: how many links hold each pair of ids, and whether no pair with the same B id is held by more."""
    counts = summed.select(F.inline(F.arrays_zip("pairs", "often"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("often").alias("count"))
    top = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    return counts.withColumn("best", F.col("count") == F.max("count").over(top))


def agreement(documents: DataFrame, carry: list[str], a_path: str | None = None, b_path: str | None = None, text_col: str = "text") -> DataFrame:
    """``carry`` columns of each row with ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` counts the links whose pair no other pair of its B id outdoes in the corpus, ties included; ``count_sum`` adds
    up the links' counts. A text that takes no part has zeros and ''. Repeated rows are documents of their own, and an
    empty table gives no rows. Rows are numbered as they are read, so ``documents`` must be a table that reads alike each time. A new column takes the place of a carried one of its name; other columns aren't read.

    A document is aligned in one task, whose sorts go to disk where memory ends. Counts of pairs are at most the
    product of the vocabularies; they are counted before they are broadcast, and beyond ``MOST_BROADCAST`` shuffled.
    """
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    carry = without_names(carry, names)
    spark, shift = documents.sparkSession, pair(a_path, b_path).shift
    total = documents.agg(F.sum(F.octet_length(text_or_empty(text_col)))).first()[0] or 0
    tasks = min(MOST_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BYTES_A_TASK)))
    # carried columns join at the end, so that all readers of the shuffled tokens read the same columns and share it
    numbered = documents.withColumn(key := free_name("_k", documents.columns), F.monotonically_increasing_id())
    aligned = align(encoded(numbered.select(F.col(key).alias("_k"), F.col(text_col).alias("_text")), ["_k"], a_path, b_path, "_text"), tasks, a_path, b_path)
    with joins_within(spark):
        summed = materialise(summed_up(aligned, ["_k"], shift), "summed")
    counts = materialise(pair_counts(summed), "pair-counts")
    known = F.broadcast(counts) if counts.count() <= MOST_BROADCAST else counts
    each = summed.select("_k", F.inline(F.arrays_zip("pairs", "often"))).join(known, F.col("pairs") == F.col("pair"))
    sums = each.groupBy("_k").agg(F.sum("often").alias("n_links"), F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("n_best"), F.sum(F.col("often") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    own = numbered.select(F.col(key).alias("_k"), F.struct(*carry).alias("_d"))
    out = own.join(summed.drop("pairs", "often"), "_k").join(sums, "_k", "left")
    out = materialise(out.select(*[F.col("_d")[c].alias(c) for c in carry], "n_a", "n_b", "n_groups", *[F.coalesce(c, zero).alias(c) for c in ("n_links", "n_best", "count_sum")], "groups_sha256"), "agreement")
    discard(summed, counts)
    return out
