"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the 64-bit hashes of its words (letters and digits, lower case), adjacent
word pairs, and pairs with one or two words between; a feature counts once however often it
occurs. Training runs per-coordinate FTRL-proximal updates over a bounded sample of labelled
texts. L1 leaves few weights, so the model is a short sorted table of (hash, weight) which is
broadcast and searched by every scoring task. Whole texts are scored.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .labelled import labelled_sample, train_in_one_task
from .shared import bound_batches, free_name, tidy, without_names

SKIPS = (1, 2, 3)


@dataclass(frozen=True)
class FtrlParams:
    """Rates and bounds of training. ``max_rows`` and ``max_bytes`` bound the sample of labelled texts."""

    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 20.0
    l2: float = 0.02
    epochs: int = 12
    min_df: int = 3
    max_rows: int = 8192
    max_bytes: int = 48 << 20


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and their rows, with repeats, of lower-cased UTF-8 texts."""
    s, e, row = tk.runs(tk.ALNUM[buf], off)
    h = tk.run_hashes(buf, s, e)
    keys, rows = [h], [row]
    for k in SKIPS:
        same = row[k:] == row[:-k]
        keys.append(tk.pair(h[:-k], h[k:], k)[same])
        rows.append(row[k:][same])
    return np.concatenate(keys), np.concatenate(rows)


def fit(texts: list[bytes], labels: list[int], p: FtrlParams) -> bytes:
    """Train on texts in the given order."""
    docs, ys = [], []
    for t, y in zip(texts, labels, strict=True):
        buf = np.frombuffer(t.decode().lower().encode(), np.uint8)
        docs.append(np.unique(features(buf, np.array([0, len(buf)]))[0]))
        ys.append(y)
    # features in fewer than min_df texts can't generalise; count them in a small hashed table first
    df = np.zeros(1 << 24, np.uint8)
    for d in docs:
        i = np.unique(d >> np.uint64(40)).astype(np.int64)
        df[i] += df[i] < 255
    docs = [d[df[(d >> np.uint64(40)).astype(np.int64)] >= p.min_df] for d in docs]
    keys, counts = np.unique(np.concatenate(docs), return_counts=True)
    keys = keys[counts >= p.min_df]
    where = []
    for d in docs:
        d = d[np.isin(d, keys)] if len(keys) < 1000 else d
        i = np.searchsorted(keys, d)
        i[i == len(keys)] = 0
        where.append(i[keys[i] == d] if len(keys) else i[:0])
    z, n = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    bias = len(keys)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        l1 = np.where(i == bias, 0.0, p.l1)
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))

    y = np.array(ys, float)
    # both classes weigh alike, whatever their share of the sample
    pos, neg = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    gain = np.where(y == 1, min(8.0, max(1.0, neg / pos)), min(8.0, max(1.0, pos / neg)))
    order = np.random.Generator(np.random.PCG64(7)).permutation(len(docs))
    for _ in range(p.epochs):
        for d in order:
            i = np.append(where[d], bias)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[d]) * gain[d]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(len(keys) + 1))
    keep = np.flatnonzero(w[:-1])
    out = io.BytesIO()
    np.savez(out, keys=keys[keep], weights=w[keep].astype(np.float32), bias=np.array(w[bias]))
    return out.getvalue()


class Scorer:
    """Scores slices of texts with the sparse weights of a fitted model."""

    def __init__(self, model: bytes | None):
        m = np.load(io.BytesIO(model)) if model else {"keys": np.zeros(0, np.uint64), "weights": np.zeros(0, np.float32), "bias": np.array(-35.0)}
        self.keys, self.weights, self.bias = m["keys"], m["weights"].astype(float), float(m["bias"])
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        total = np.full(len(off) - 1, self.bias)
        if len(self.keys) and len(buf):
            h, row = features(buf, off)
            near = np.flatnonzero(self.sieve[(h >> np.uint64(44)).astype(np.int64)])
            h, row = h[near], row[near]
            at = np.searchsorted(self.keys, h)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == h
            once = np.unique(row[hit].astype(np.int64) * len(self.keys) + at[hit])
            np.add.at(total, once // len(self.keys), self.weights[once % len(self.keys)])
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def toxicity_model(documents: DataFrame, labels: DataFrame, training: Column, params: FtrlParams = FtrlParams(), label: str = "toxic") -> bytes | None:
    """Fit on the labelled rows for which ``training`` (a condition on ``labels``) holds; None without such rows."""
    return train_in_one_task(labelled_sample(documents, labels, label, training, params.max_rows), lambda t, y: fit(t, y, params), params.max_bytes)


def score_toxicity(documents: DataFrame, model: bytes | None, carry: list[str], threshold: float = 0.5, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``carry`` columns of each row of ``documents``, with ``score`` (0 to 1) and ``predicted`` (score >= threshold).

    A null text is the empty text; texts without a known feature get the bias alone, the score of an
    ordinary text. Without a model every score is next to 0. Repeated rows stay, each scored alike;
    columns of the input that are not in ``carry`` are not read. A new column takes the place of a carried one of its name, unless it is renamed.
    An empty table gives no rows. Texts of any length are scored whole.
    """
    bound_batches(documents.sparkSession)
    carry = without_names(carry, [score_col, predicted_col])
    blob = documents.sparkSession.sparkContext.broadcast(model)
    # a text that is carried anyway goes to Python once
    extra = [] if text_col in carry else [F.col(text_col).cast("string").alias(free_name("_text", carry))]
    kept = documents.select(*carry, *extra)
    at, n = (len(carry), len(carry)) if extra else (carry.index(text_col), len(carry))
    out = ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes[:n]), f"`{score_col}` double"])

    def run(batches):
        score = Scorer(blob.value)
        for b in batches:
            buf, off = tk.utf8(pc.utf8_lower(b.column(at)))
            got = [score(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in tk.slices(off)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(np.concatenate(got) if got else np.zeros(0))], names=[*carry, score_col])

    return kept.mapInArrow(tidy(run), out).withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))
