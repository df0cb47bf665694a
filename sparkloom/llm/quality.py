"""Quality classifier by positive-unlabelled learning (operator 5).

Trusted positives are rows labelled 1; the unlabelled class is web text of any
kind. A small network is fitted to the non-negative unbiased risk

    prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives as 0))

where the bracket turns negative its gradient is walked back. The prior is estimated
from positives and unlabelled rows alone: a first network tells them apart, and on rows
it was not fitted to, the share of unlabelled rows above a threshold over that of
positives is at least the prior and nearest to it where others are few; its least value
over all thresholds that a fifth of the positives pass is taken. Negatives are used for
nothing but the calibration of scores on the labelled rows.

Only the fit sees a sample: at most ``sample`` labelled and ``sample`` unlabelled
documents, those with the smallest hashes of doc_id. Scoring reads every whole
text, in pieces of 1 MB, inside one Arrow function with no shuffle.

Null texts count as empty and get a score too. Without labels of any kind every
score is 0.5; with positives only, scores stay uncalibrated. Documents with a null
doc_id are scored and never learned from. Repeated rows come out once each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, packed, unpacked

CHUNK = 1 << 20
RATIOS = 13
SIZE = 98 + RATIOS + 1


def _chunks(data: bytes) -> Iterator[bytes]:
    at, n = 0, len(data)
    while at < n:
        end = min(at + CHUNK, n)
        while end < n and data[end] > 32:
            end += 1
        yield data[at:end]
        at = end


def features(text: str | None) -> np.ndarray:
    """Shares of characters, words, repeats and lines of a whole text."""
    out = np.zeros(SIZE)
    data = text.encode("utf-8", "replace") if text else b""
    if not data:
        return out
    bytes_, sums, words_in = np.zeros(256), np.zeros(RATIOS), 0
    for chunk in _chunks(data):
        bytes_ += np.bincount(np.frombuffer(chunk, np.uint8), minlength=256)
        w = chunk.split()
        n = len(w)
        if not n:
            continue
        words_in += n
        size = np.fromiter(map(len, w), np.float64, n)
        lines = chunk.split(b"\n")
        sums += (
            size.sum(), np.sqrt(size).sum(), (size > 12).sum(), (size < 3).sum(),
            len(set(w)) ** 0.5 * n**0.5, sum(map(bytes.__eq__, w, w[1:])), max(Counter(w).values()),
            len(set(zip(w, w[1:], w[2:], strict=False))), sum(map(bytes.isupper, w)), sum(map(bytes.istitle, w)),
            sum(map(bytes.isalnum, w)), len(lines), len(lines) - len(set(lines)),
        )
    n = len(data)
    out[:95] = np.sqrt(bytes_[32:127] / n)
    out[95:98] = np.sqrt([bytes_[10] / n, bytes_[:32].sum() / n, bytes_[192:].sum() / n])
    out[98:-1] = sums / max(words_in, 1)
    out[-1] = np.log1p(n)
    return out


class Model:
    """A standardised input, one hidden layer, and a calibrated logit."""

    def __init__(self, mean, scale, w1, b1, w2, b2, slope=1.0, shift=0.0):
        self.parts = (mean, scale, w1, b1, w2, b2)
        self.slope, self.shift = slope, shift

    def logit(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.parts
        return np.tanh(np.clip((x - mean) / scale, -8, 8) @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logit(x) + self.shift, -30, 30)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(theta: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, list[np.ndarray]]:
    """The unbiased risk's bracket, and the gradient to follow: of the whole risk, or backwards of the bracket where it is negative."""

    def parts(x, slope):
        """Mean over rows of the logistic loss as 0, and the gradient of slope(logit) / rows by the network's parts."""
        h = np.tanh(x @ theta[0] + theta[1])
        z = h @ theta[2] + theta[3]
        d = slope(z) / len(x)
        back = np.outer(d, theta[2]) * (1 - h * h)
        return np.logaddexp(0, z).mean(), [x.T @ back, back.sum(0), h.T @ d, d.sum()]

    loss_u, grad_u = parts(u, _sigmoid)
    loss_p, grad_p = parts(p, _sigmoid)
    rest, minus = loss_u - prior * loss_p, [a - prior * b for a, b in zip(grad_u, grad_p, strict=True)]
    if rest < 0:
        return rest, [-b for b in minus]
    return rest, [prior * a + b for a, b in zip(parts(p, lambda z: _sigmoid(z) - 1)[1], minus, strict=True)]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, hidden: int = 16, batch: int = 512, seed: int = 7) -> Model:
    """Minimise the non-negative risk of the logistic loss with Adam."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 0.02
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    theta = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for k in range(1, steps + 1):
        _, g = risk(theta, p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)], prior)
        for i, own in enumerate(g):
            own = own + 1e-4 * theta[i]
            m[i] = 0.9 * m[i] + 0.1 * own
            v[i] = 0.999 * v[i] + 0.001 * own * own
            theta[i] = theta[i] - 0.01 * (1 - k / (steps + 1)) * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    return Model(mean, scale, *theta)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.2) -> float:
    """The share of positives among the unlabelled rows, from 0.05 to 0.95."""
    ranking = fit(positive[::2], unlabelled[::2], 0.5, steps=500)
    p, u = (np.sort(ranking.logit(x)) if len(x) else np.zeros(1) for x in (positive[1::2], unlabelled[1::2]))
    cuts = p[: max(1, int((1 - least) * len(p)))]
    above = lambda x: 1 - np.searchsorted(x, cuts) / len(x)
    return float(np.clip((above(u) / above(p)).min(), 0.05, 0.95))


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Slope and shift of the logit by Newton's method on the labelled rows."""
    z = model.logit(x)
    design, beta = np.stack((z, np.ones_like(z)), 1), np.array([1.0, 0.0])
    for _ in range(25):
        p = _sigmoid(design @ beta)
        hess = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        beta = beta - np.linalg.solve(hess, design.T @ (p - y) + 1e-3 * (beta - [1.0, 0.0]))
    if beta[0] > 0:
        model.slope, model.shift = map(float, beta)


def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


def train(docs: DataFrame, labels: DataFrame, held_out: Callable[[], Column], sample: int = 6000) -> Model | None:
    """A model from rows that are not held out; None where there are no labels of 1."""
    label = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    label = label.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").cast("int").alias("_label"))
    label = label.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    anyone = docs.where(~held_out() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.lit(None).cast("int").alias("_label"))
    chosen = label.unionByName(anyone.orderBy(F.xxhash64("_id", F.lit(1)), "_id").limit(sample))  # 2 * sample rows at most
    picked = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text")).join(F.broadcast(chosen), "_id")
    rows = picked.select("_id", "_label", F.pandas_udf(_features, "array<double>")("_text").alias("x")).orderBy(F.xxhash64("_id"), "_id", "_label").limit(3 * sample).toPandas()
    known = rows["_label"].notna()
    if not len(rows) or not (rows["_label"] == 1).any() or known.all():
        return None
    x, y = np.stack(rows["x"]), rows["_label"].to_numpy()
    y_known = y[known].astype(float)
    positive, unlabelled = x[y == 1], x[~known]
    model = fit(positive, unlabelled, estimated_prior(positive, unlabelled))
    if (y_known == 0).any():
        calibrate(model, x[known], y_known)
    return model


def score_column(model: Model | None) -> Column:
    """The score of column text."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.stack([features(t) for t in texts]) if len(texts) else np.zeros((0, SIZE))
            yield pd.Series(model.score(x))

    return score(F.col("text").cast("string"))


def scores(docs: DataFrame, labels: DataFrame, held_out: Callable[[], Column], threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels, held_out)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score_column(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def by_crc() -> Column:
    """Held out: crc32 of the id as text is a multiple of 5."""
    return crc_mod("doc_id", 5) == 0


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without those that score below ``threshold``."""
    model = train(docs, labels, by_crc)
    return unpacked(packed(docs, "text").withColumn("score", score_column(model)).where(F.col("score") >= threshold), docs.columns)
