"""Divergence audit, fingerprints and tokenizer alignment against brute force, with odd texts, ties and clashing names."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_text_operators import LOWER, SCHEMA, WORD, corpus

from lodestone.llm import alignment as al
from lodestone.llm import divergence as dv
from lodestone.llm import fingerprints as fp
from lodestone.llm import mixing

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
OTHERS = [(200, "Zebra zebra Ünder", None, None), (201, "zebra", None, None), (202, "zebra UNDER under", "", ""), (203, None, "xx", "a"), (204, "1 2", "xx", "b"), (205, "ünder Zebra", "", "s1")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus() + [(k, t, lang, source, 0, 0.5, "c", 1, 2) for k, t, lang, source in OTHERS]
    return spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit("clash")).coalesce(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


def audit_by_force(rows, min_docs, top):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def parts(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: parts(counts[lang, s]) for s in sources}
        q = parts(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)}
    return out


@pytest.mark.parametrize(("min_docs", "top"), [(3, 200), (1, 5), (50, 200)])
def test_audit(docs, empty, min_docs, top):
    got = dv.audit(docs, min_docs, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = audit_by_force([(r["text"], r["lang"], r["source"]) for r in docs.collect()], min_docs, top)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert dv.audit(empty, min_docs, top).count() == 0


def test_parts_of_counts_beyond_a_long(spark):
    df = spark.createDataFrame([(5 * 10**17, 10**18, 10**9), (0, 10**18, 1)], "c long, t long, v long")
    got = [r[0] for r in df.select(dv.part(F.col("c"), F.col("t"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 1) // (t + v) for c, t, v in ((5 * 10**17, 10**18, 10**9), (0, 10**18, 1))]


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(docs, empty):
    k = 64
    got = fp.fingerprints(docs, docs.columns, k=k).collect()
    assert len(got) == docs.count()
    by = defaultdict(set)
    for r in got:
        by[r["text"] or ""].add(r["fingerprint"])
        n = len(shingles(r["text"]))
        assert len(r["fingerprint"]) == fp.CHARS * min(n, k) and list(r["fingerprint"][i : i + 8] for i in range(0, len(r["fingerprint"]), 8)) == sorted(r["fingerprint"][i : i + 8] for i in range(0, len(r["fingerprint"]), 8))
    assert all(len(x) == 1 for x in by.values()) and by[""] == {""}
    named = fp.fingerprints(docs.withColumnRenamed("lang", "Fingerprint"), ["doc_id", "Fingerprint"])
    assert named.columns == ["doc_id", "fingerprint"]
    assert fp.fingerprints(empty, ["doc_id"]).count() == 0


def test_columns_agree_with_sets(spark, docs):
    texts = [r["text"] for r in docs.select("text").distinct().collect()]
    pairs = spark.createDataFrame(list(zip(texts, texts[1:] + texts[:1], strict=True)), "a string, b string")
    for k, near in ((4096 * 4, 1e-9), (128, 0.2)):
        one = fp.fingerprints(fp.fingerprints(pairs, ["a", "b"], k=k, text_col="a", name="fa"), ["a", "b", "fa"], k=k, text_col="b", name="fb")
        x, y = F.col("fa"), F.col("fb")
        got = one.select("a", "b", fp.resemblance(x, y, k).alias("r"), fp.containment(x, y, k).alias("c"), fp.distinct_shingles(x, k).alias("n")).collect()
        for r in got:
            a, b = shingles(r["a"]), shingles(r["b"])
            assert abs(r["r"] - jaccard(a, b)) <= near and abs(r["c"] - (len(a & b) / len(a) if a else 1.0)) <= 2 * near
            assert r["n"] == len(a) if len(a) < k else abs(r["n"] / len(a) - 1) < 0.4


def test_merged_fingerprints_are_those_of_all_parts(spark, docs):
    k = 100
    marked = fp.fingerprints(docs, ["source"], k=k)
    got = {r["source"]: r["fingerprint"] for r in fp.merge(marked, ["source"], k=k).collect()}
    every = defaultdict(set)
    for r in fp.fingerprints(docs, ["source"], k=10**6).collect():
        every[r["source"]] |= {r["fingerprint"][i : i + 8] for i in range(0, len(r["fingerprint"]), 8)}
    assert got == {s: "".join(sorted(h)[:k]) for s, h in every.items()}


def test_sketches_of_many_short_texts():
    texts = [f"w{k} and some words {k % 7}" if k % 3 else "" for k in range(70_000)]
    got = fp.sketches(pa.array(texts))
    assert len(got) == len(texts) and all(len(s) == (1 if t else 0) for s, t in zip(got, texts, strict=True))
    alone = fp.sketches(pa.array(texts[65_535:65_538]))
    assert all(np.array_equal(a, b) for a, b in zip(alone, got[65_535:65_538], strict=True))


@pytest.mark.parametrize("rows_a_range", [2048, 7])
def test_beside_next(spark, docs, empty, monkeypatch, rows_a_range):
    monkeypatch.setattr(fp, "RANGE_ROWS", rows_a_range)
    # one document a id, so that the order is defined
    own = docs.dropDuplicates(["doc_id"])
    rows = sorted(((r["doc_id"], r["text"] or "") for r in own.collect()), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    got = {r["doc_id"]: r for r in fp.beside_next(own).collect()}
    assert len(got) == len(rows)
    for (k, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fp.to_text(fp.sketches(pa.array([t]))[0]) and r["edited_fingerprint"] == fp.to_text(fp.sketches(pa.array([edited]))[0])
        assert abs(r["near_edited"] - jaccard(shingles(t), shingles(edited))) < 0.15 and abs(r["near_next"] - jaccard(shingles(t), shingles(after))) < 0.15
    # rows of one id, rows alike, a row alone, none
    assert fp.beside_next(docs).count() == docs.count()
    assert fp.beside_next(docs.withColumn("doc_id", F.lit(5))).count() == docs.count()
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id int, text string")
    (r,) = fp.beside_next(one).collect()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"a b c a b c"[:11]).hexdigest() or r["n_chars"] == 11
    assert fp.beside_next(empty).count() == 0


ODD = [None, "", "  two  spaces\n\n x \t y", "has ▁ mark", " lead", "<|endoftext|> </s> <0x41> ok", "a" * 3000, "\n", "é ñ 中文 🙂‍ x  y", "\x00z w", "tail ", "x  y", "one two", "one two"]


def align_by_force(text, one):
    """Ids and groups of a text by the libraries themselves; nothing where the bytes differ."""
    if not text:
        return [], [], []
    a, b = one.slow.encode(" " + text, add_special_tokens=False).ids, one.b.encode(text)
    own = (" " + text).encode()
    parts = [one.a_bytes[i] for i in a], [one.b_bytes[i] for i in b]
    if any(b"".join(p) != own for p in parts):
        return [], [], []
    ends = [list(np.cumsum([len(x) for x in p])) for p in parts]
    groups, last = [], 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        groups.append(tuple(tuple(i for i, e in zip(ids, en, strict=True) if last < e <= cut) for ids, en in ((a, ends[0]), (b, ends[1]))))
        last = cut
    return a, b, groups


@pytest.fixture(scope="module")
def aligned_docs(spark, docs):
    short = docs.where("length(text) < 4000 or text is null").select("doc_id", "text", "lang")
    return short.union(spark.createDataFrame([(1000 + k, t, "n_a") for k, t in enumerate(ODD)], "doc_id long, text string, lang string"))


def test_agreement(spark, aligned_docs, monkeypatch):
    one = al.pair(None, None)
    assert one.by_words
    rows = [(r["doc_id"], r["text"]) for r in aligned_docs.collect()]
    force = {t: align_by_force(t, one) for _, t in rows}
    counts = Counter((a[-1], b[-1]) for _, t in rows for a, b in force[t][2])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)

    def want(t):
        a, b, groups = force[t]
        links = [(x[-1], y[-1]) for x, y in groups]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        return len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else ""

    expected = sorted(((k is not None, k), want(t)) for k, t in rows)
    assert force["has ▁ mark"] == ([], [], []) and force["a" * 3000][0]
    for most in (al.MOST_BROADCAST, 0):
        monkeypatch.setattr(al, "MOST_BROADCAST", most)
        got = al.agreement(aligned_docs.withColumn("n_links", F.lit("clash")), ["doc_id", "n_links"])
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(((r[0] is not None, r[0]), tuple(r)[1:]) for r in got.collect()) == expected
    assert al.agreement(aligned_docs.where("1 = 0"), ["doc_id"]).count() == 0
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_groups_and_links(spark, aligned_docs):
    one = al.pair(None, None)
    unique = aligned_docs.where("doc_id >= 1000")
    keyed = al.encoded(unique.withColumnRenamed("doc_id", "_k"), ["_k", "text"])
    from lodestone.llm.shared import materialise

    with al.joins_within(spark):
        aligned = materialise(al.unpacked(al.align(materialise(keyed, "t"), 3)), "t")
    force = {r["_k"]: align_by_force(r["text"], one) for r in aligned.collect()}
    got = defaultdict(list)
    for r in al.groups(aligned, ["_k"]).orderBy("_k", "group").collect():
        got[r["_k"]].append((tuple(r["a_ids"]), tuple(r["b_ids"])))
    assert dict(got) == {k: x[2] for k, x in force.items() if x[2]}
    ends = Counter((r["_k"], r["a_id"], r["b_id"]) for r in al.links(aligned, ["_k"]).collect())
    assert ends == Counter((k, a[-1], b[-1]) for k, x in force.items() for a, b in x[2])
    every = Counter((r["_k"], r["a_id"], r["b_id"]) for r in al.links(aligned, ["_k"], "group").collect())
    assert every == Counter((k, i, j) for k, x in force.items() for a, b in x[2] for i in a for j in b)
    with pytest.raises(ValueError, match="kind"):
        al.links(aligned, ["_k"], "other")


def test_words_are_forgotten_and_whole_texts_agree(monkeypatch):
    texts = pa.array([t for t in ODD if t] + ["some words here", None, "other words there  now", "some more"])
    one = al.Pair(al.default_path(), al.default_piece_path())

    def lists(column):
        return [[ids[s:e].tolist() for s, e in zip(off[:-1], off[1:], strict=True)] for ids, off in one(column)]

    first = lists(texts)
    assert first == [list(x) for x in zip(*[align_by_force(t.as_py(), one)[:2] for t in texts], strict=True)]
    monkeypatch.setattr(al, "WORDS_KEPT", 1)
    assert lists(texts) == first
    one.by_words = False
    assert lists(texts) == first
    one.fast = None
    assert lists(texts.slice(0, 4)) == [x[:4] for x in first]


def test_rows_of_one_id_and_size_are_mixed_alike(spark):
    """Rows that differ in their text alone keep their places, however they are dealt."""
    texts = ["alpha beta gamma", "delta beta gamma", "beta gamma omega", "one two three"]
    rows = [(1, t, "a") for t in texts] + [(2, "x " * 40, "b"), (3, "y " * 9, "c")]
    seen = set()
    for order, parts in ((rows, 1), (rows[::-1], 3), (rows[2:] + rows[:2], 2)):
        df = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(parts)
        seen.add(tuple(tuple(r) for r in mixing.mix(df, weights=(1.0, 7.0, 2.0)).orderBy("position", "doc_id", "text").collect()))
    assert len(seen) == 1
