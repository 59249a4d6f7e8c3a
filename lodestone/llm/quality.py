"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated by temperature.

Words and punctuation runs hash to buckets. Each bucket owns a random ternary index vector; its
context vector is the sum of the index vectors met beside it in the sample, so that tokens used
alike get alike vectors. A document is pooled twice: the mean vector of its words, and the mean
vector of its form tokens (letter case and length of each word, punctuation runs, repeats of
preceding words). A network with one hidden layer turns both, and the logarithm of the word
count, into a logit, which is divided by a temperature fitted on texts kept out of training.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .labelled import labelled_sample, train_in_one_task
from .shared import bound_batches, free_name, tidy, without_names


@dataclass(frozen=True)
class QualityParams:
    """Sizes of the model; ``max_rows`` and ``max_bytes`` bound the sample of labelled texts."""

    bucket_bits: int = 15
    dim: int = 32
    window: int = 2
    hidden: int = 32
    epochs: int = 60
    rate: float = 3e-3
    max_rows: int = 8192
    max_bytes: int = 32 << 20


_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_INK = ~tk.SPACE


def _count(mark: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mark)])
    return total[e] - total[s]


def tokens(buf: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and rows, form buckets and rows."""
    shift = np.uint64(64 - bits)
    alnum = tk.ALNUM[buf]
    s, e, row = tk.runs(alnum, off)
    h = tk.run_hashes(tk.LOWER[buf], s, e)
    up, low, dig = _count(_UPPER[buf], s, e), _count(_LOWER[buf], s, e), _count(_DIGIT[buf], s, e)
    size = np.minimum(15, (e - s) // 2)
    form = np.where(dig > 0, 3, np.where((up > 0) & (low == 0), 2, np.where(up > 1, 4, np.where(up == 1, 1, 0))))
    forms = [tk.mix((form * 16 + size).astype(np.uint64) + np.uint64(11))]
    rows = [row]
    for k in (1, 2, 3):
        again = np.flatnonzero((h[k:] == h[:-k]) & (row[k:] == row[:-k])) + k
        forms.append(np.full(len(again), tk.mix(np.array([977 + k], np.uint64))[0]))
        rows.append(row[again])
    ps, pe, prow = tk.runs(_INK[buf] & ~alnum, off)
    forms.append(tk.run_hashes(buf, ps, pe))
    rows.append(prow)
    return (h >> shift).astype(np.int64), row, (np.concatenate(forms) >> shift).astype(np.int64), np.concatenate(rows)


def index_vectors(p: QualityParams) -> np.ndarray:
    """A seeded sparse ternary vector for each bucket."""
    rng = np.random.Generator(np.random.PCG64(41))
    out = rng.integers(0, 6, (1 << p.bucket_bits, p.dim), dtype=np.int8)
    return np.where(out == 0, -1, np.where(out == 1, 1, 0)).astype(np.float32)


def context_vectors(texts: list[bytes], p: QualityParams) -> np.ndarray:
    """Random indexing over the sample: own index vector plus those of neighbours, scaled to length 1."""
    own = index_vectors(p)
    got = np.zeros_like(own)

    def add(b: np.ndarray, row: np.ndarray) -> None:
        if len(b) < 2:
            return
        near = np.zeros((len(b), p.dim), np.float32)
        for k in range(1, p.window + 1):
            same = (row[k:] == row[:-k])[:, None]
            near[k:] += own[b[:-k]] * same
            near[:-k] += own[b[k:]] * same
        order = np.argsort(b, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(b[order]) != 0])
        got[b[order][first]] += np.add.reduceat(near[order], first, axis=0)

    for t in texts:
        buf = np.frombuffer(t, np.uint8)
        for w, row in zip(*(iter(tokens(buf, np.array([0, len(buf)]), p.bucket_bits)),) * 2, strict=True):
            for lo in range(0, len(w), 50_000):
                add(w[lo : lo + 50_000], row[lo : lo + 50_000])
    length = np.linalg.norm(got, axis=1, keepdims=True)
    both = np.divide(got, length, out=np.zeros_like(got), where=length > 0) + own / np.maximum(1, np.linalg.norm(own, axis=1, keepdims=True))
    return (both / np.maximum(1e-9, np.linalg.norm(both, axis=1, keepdims=True))).astype(np.float32)


def pooled(buf: np.ndarray, off: np.ndarray, vectors: np.ndarray, bits: int) -> np.ndarray:
    """Two mean vectors and the logarithm of the word count, for each text."""
    n, dim = len(off) - 1, vectors.shape[1]
    out = np.zeros((n, 2 * dim + 1), np.float32)
    w, wrow, f, frow = tokens(buf, off, bits)
    order = np.argsort(frow, kind="stable")
    for k, (b, row) in enumerate(((w, wrow), (f[order], frow[order]))):
        count = np.bincount(row, minlength=n)
        for lo in range(0, len(b), 1 << 16):
            part = row[lo : lo + (1 << 16)]
            first = np.flatnonzero(np.r_[True, np.diff(part) != 0])
            out[part[first], k * dim : (k + 1) * dim] += np.add.reduceat(vectors[b[lo : lo + (1 << 16)]], first, axis=0)
        out[:, k * dim : (k + 1) * dim] /= np.maximum(1, count)[:, None]
    out[:, -1] = np.log1p(np.bincount(wrow, minlength=n)) / 8
    return out


def _forward(x: np.ndarray, m: dict) -> np.ndarray:
    return np.tanh((x - m["mean"]) / m["std"] @ m["w1"] + m["b1"]) @ m["w2"] + m["b2"]


def fit(texts: list[bytes], labels: list[int], p: QualityParams) -> bytes:
    """Word vectors, network and temperature from texts in the given order."""
    n, y = len(texts), np.array(labels, np.float32)
    vectors = context_vectors(texts, p)
    x = np.concatenate([pooled(np.frombuffer(t, np.uint8), np.array([0, len(t)]), vectors, p.bucket_bits) for t in texts])
    rng = np.random.Generator(np.random.PCG64(5))
    held = rng.random(n) < 0.2
    if held.all() or not held.any() or n < 20:
        held = np.zeros(n, bool)
    xt, yt = x[~held], y[~held]
    d = x.shape[1]
    m = {"mean": xt.mean(0), "std": xt.std(0) + 1e-3, "w1": rng.normal(0, d**-0.5, (d, p.hidden)).astype(np.float32), "b1": np.zeros(p.hidden, np.float32), "w2": rng.normal(0, p.hidden**-0.5, p.hidden).astype(np.float32), "b2": np.zeros((), np.float32)}
    share = float(np.clip(yt.mean(), 0.02, 0.98))
    weight = np.where(yt == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    names = ("w1", "b1", "w2", "b2")
    first, second, step = {k: np.zeros_like(m[k]) for k in names}, {k: np.zeros_like(m[k]) for k in names}, 0
    z = (xt - m["mean"]) / m["std"]
    for _ in range(p.epochs):
        order = rng.permutation(len(z))
        for lo in range(0, len(z), 128):
            i = order[lo : lo + 128]
            hid = np.tanh(z[i] @ m["w1"] + m["b1"])
            g = (1 / (1 + np.exp(-np.clip(hid @ m["w2"] + m["b2"], -30, 30))) - yt[i]) * weight[i] / len(i)
            back = np.outer(g, m["w2"]) * (1 - hid**2)
            grads = {"w1": z[i].T @ back + 1e-4 * m["w1"], "b1": back.sum(0), "w2": hid.T @ g + 1e-4 * m["w2"], "b2": g.sum()}
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                m[k] = m[k] - p.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    m["temperature"] = np.array(1.0)
    if held.any():
        logit, yh = _forward(x[held], m), y[held]
        # labels are weighted as in training, so that the calibrated threshold favours no class
        wh = np.where(yh == 1, 0.5 / share, 0.5 / (1 - share))
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.sum(wh * (np.logaddexp(0, logit / t) - yh * logit / t)) for t in grid]
        m["temperature"] = np.array(grid[int(np.argmin(loss))])
    out = io.BytesIO()
    np.savez(out, vectors=vectors.astype(np.float16), bits=np.array(p.bucket_bits), **m)
    return out.getvalue()


class Scorer:
    def __init__(self, model: bytes | None):
        self.m = dict(np.load(io.BytesIO(model))) if model else None
        if self.m:
            self.m["vectors"] = self.m["vectors"].astype(np.float32)

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.m is None:
            return np.zeros(len(off) - 1)
        x = pooled(buf, off, self.m["vectors"], int(self.m["bits"]))
        return 1 / (1 + np.exp(-np.clip(_forward(x, self.m).astype(float) / float(self.m["temperature"]), -35, 35)))


def quality_model(documents: DataFrame, labels: DataFrame, training: Column, params: QualityParams = QualityParams(), label: str = "quality") -> bytes | None:
    """Fit on the labelled rows for which ``training`` (a condition on ``labels``) holds; None without such rows."""
    return train_in_one_task(labelled_sample(documents, labels, label, training, params.max_rows), lambda t, y: fit(t, y, params), params.max_bytes)


def score_quality(documents: DataFrame, model: bytes | None, carry: list[str], threshold: float = 0.7, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``carry`` columns of each row of ``documents``, with ``score`` (0 to 1) and ``predicted`` (score >= threshold).

    A null text is the empty text, which gets the network's answer for no words at all. Without a
    model every score is 0. Repeated rows stay, each scored alike; columns of the input that are not
    in ``carry`` are not read. A new column takes the place of a carried one of its name, unless it is renamed. An empty table gives no rows.
    Texts of any length are scored whole.
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
            buf, off = tk.utf8(b.column(at))
            got = [score(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in tk.slices(off)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(np.concatenate(got) if got else np.zeros(0))], names=[*carry, score_col])

    return kept.mapInArrow(tidy(run), out).withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))
