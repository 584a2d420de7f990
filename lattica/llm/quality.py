"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector w over hashed text features and
thresholds that ascend by construction (a first one and positive steps). The expected grade and the
probability of the best grade select documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_only, map_rows, materialize, slices, spread, texts_of
from .toxicity import sample_labels

DIM_BITS = 11


def hashed_features(text: str, bits: int = DIM_BITS) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, at two resolutions: bytes as they are, and byte
    classes (lower, upper, digit, space, other ASCII, rest) over five places. Length of the text does not count."""
    data = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros(1 << bits, np.float32)
    half = 1 << (bits - 1)
    for at, (codes, k) in enumerate(((data, 3), (_CLASS[data], 5))):
        n = len(codes) - k + 1
        if n <= 0:
            continue
        h = np.zeros(n, np.uint32)
        for j in range(k):
            h = h * np.uint32(0x01000193) + codes[j : j + n]
        h = (h * np.uint32(0x9E3779B1)) >> np.uint32(33 - bits)
        out[at * half : (at + 1) * half] = np.sqrt(np.bincount(h, minlength=half) / n)
    return out


def _classes() -> np.ndarray:
    out = np.full(256, 5, np.uint8)
    out[32:128] = 4
    for i in range(10):
        out[48 + i] = 2
    out[97:123], out[65:91], out[[9, 10, 13, 32]] = 0, 1, 3
    return out


_CLASS = _classes()


@dataclass
class OrdinalModel:
    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for all grades but the lowest."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - (x @ self.weights)[:, None], -30, 30)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(np.asarray(self.grades, float))


def objective(x: np.ndarray, k: np.ndarray, row: np.ndarray, w: np.ndarray, raw: np.ndarray, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, its gradient by w, by raw). k: the grade's rank of each row, row: each row's weight; the thresholds are raw[0] and
    positive steps exp(raw[1:]) from there."""
    m = len(raw)
    theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
    full = np.concatenate([[-np.inf], theta, [np.inf]])
    s = x @ w
    lo, hi = full[k] - s, full[k + 1] - s
    a, b = (1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (lo, hi))
    a, b = np.where(np.isfinite(lo), a, 0.0), np.where(np.isfinite(hi), b, 1.0)
    like = np.maximum(b - a, 1e-9)
    da, db = a * (1 - a) / like, b * (1 - b) / like
    gw = (x.T @ (row * (db - da)).astype(x.dtype)) + l2 * w
    gt = np.zeros(m)
    np.add.at(gt, np.minimum(k, m - 1), -row * db * (k < m))
    np.add.at(gt, np.maximum(k - 1, 0), row * da * (k > 0))
    back = np.cumsum(gt[::-1])[::-1]
    return float(-(row * np.log(like)).sum() + l2 / 2 * (w.astype(float) ** 2).sum()), gw, np.concatenate([back[:1], back[1:] * np.exp(raw[1:])])


def fit_ordinal(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 400, rate: float = 0.1) -> OrdinalModel:
    """Full-batch Adam; y holds grades of any values. Grades weigh alike however many rows they have. Fewer than two grades: every tail is 1."""
    grades, k = np.unique(y, return_inverse=True)
    if len(grades) < 2:
        return OrdinalModel(grades.tolist() or [0.0], np.zeros(x.shape[1] if x.ndim == 2 else 1 << DIM_BITS, np.float32), np.zeros(0))
    row = (1 / (len(grades) * np.bincount(k)))[k]
    w, raw = np.zeros(x.shape[1], np.float32), np.zeros(len(grades) - 1)
    raw[0] = -1.0
    state = [(np.zeros_like(w), np.zeros_like(w)), (np.zeros_like(raw), np.zeros_like(raw))]
    for step in range(1, rounds + 1):
        _, gw, gr = objective(x, k, row, w, raw, l2)
        for i, (p, g) in enumerate(((w, gw), (raw, gr))):
            m1, m2 = state[i]
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return OrdinalModel(grades.tolist(), w, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])))


def fit_quality(docs: DataFrame, labels: DataFrame, grade: str = "quality", max_rows: int = 4000) -> OrdinalModel:
    """Fit on at most max_rows graded rows (the first by a hash of doc_id, held-out rows apart); their features come to the driver.
    Null grades are left out; a doc_id with several texts or grades counts once for each; without grades every tail is 1."""
    sample = materialize(sample_labels(docs, labels, grade, max_rows), "quality-sample").repartition(12)

    def run(batches):
        for b in batches:
            yield {"y": b["label"], "x": [hashed_features(t).tobytes() for t in b["text"]]}

    rows = map_rows(sample.select("text", F.col("label").cast("double").alias("label")), run, "y double, x binary").collect()
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float32).reshape(len(rows), 1 << DIM_BITS)
    return fit_ordinal(x, np.array([r.y for r in rows]))


def score_quality(docs: DataFrame, model: OrdinalModel, least_tail: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail (probability of the best grade) and keep, for every row. Null text counts as empty: no features, so the tail is that of the thresholds alone.
    Texts of any length are read whole; repeated rows and null doc_ids are scored like any other; an empty table gives an empty result."""

    def run(batches):
        for b in batches:
            x = np.stack([hashed_features(t) for t in b["text"]])
            tails = model.tails(x)
            best = tails[:, -1] if tails.shape[1] else np.ones(len(x))
            yield {"doc_id": b["doc_id"], "expected_grade": model.expected(tails).astype(float).tolist(), "tail": best.astype(float).tolist(), "keep": (best >= least_tail).tolist()}

    return map_rows(spread(texts_of(docs, id_col, text_col)), run, "doc_id long, expected_grade double, tail double, keep boolean")


def keep_quality(docs: DataFrame, model: OrdinalModel, least_tail: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, whose tail reaches least_tail: decided row by row, without a join, so equal texts
    share their fate and null ones that of empty ones; an empty table gives an empty result."""
    import pyarrow as pa

    def run(batches):
        keep_only()
        for batch in batches:
            for b in slices(batch, 256):
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                tails = model.tails(np.stack([hashed_features(t or "") for t in texts]))
                yield b.filter(pa.array(tails[:, -1] >= least_tail if tails.shape[1] else np.ones(len(texts), bool)))

    return docs.mapInArrow(run, docs.schema)
