"""Text quality by positive-unlabelled learning.

Trusted positives are labelled rows of good quality; the unlabelled side is every document. A linear model of
text statistics minimises the non-negative unbiased risk
    prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)])
with the logistic loss, for which the risk is convex: Newton steps whose sums run over all documents.
The prior is estimated first: a model of positives against unlabelled rows ranks the texts, and the least
ratio of the unlabelled to the positive share above a threshold bounds the prior from above.

Null text counts as empty; very long texts are read whole, and equal rows are scored alike, so there are no ties to break.
Without positives every score is the prior of one half. Other columns of the table, whatever their names, play no
part. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import small_batches, written
from runledger.llm.newton import blobs, matrix, sigmoid, softplus, solve, summed

#: Log-odds bins of the histogram that the prior is read from.
BINS = 400
#: Share of the positives that must lie above a threshold for it to count.
LEAST_ABOVE = 0.1
ROUNDS = 8
_MARKS = b"!|#$%&*?"
_WHITE = bytes([9, 10, 11, 12, 13, 32])
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True


def statistics(text: bytes) -> list[float]:
    """Numbers of a whole text in UTF-8, most of them shares in 0..1."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [1.0, *[0.0] * (STATISTICS - 1)]
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    white = int(counts[list(_WHITE)].sum())
    body = max(1, size - white)
    lengths = np.fromiter(map(len, words), np.int64, n)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 0
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    lines = [x for x in text.split(b"\n") if x]
    mean = lengths.mean()
    marks = [int(counts[c]) / n for c in _MARKS]
    upper = counts[_UPPER].sum() / body
    return [
        0.0,
        math.log1p(n) / 8,
        min(1.0, 5 / n),
        distinct / n,
        distinct / n ** 0.8,
        pairs / max(1, n - 1),
        again,
        min(2.0, mean / 8),
        min(2.0, lengths.std() / 5),
        min(2.0, int(lengths.max()) / 40),
        float(upper),
        float(upper > 0.3),
        counts[_DIGIT].sum() / body,
        counts[128:].sum() / body,
        min(1.0, (int(counts[46]) + int(counts[44])) / n),
        min(1.0, int(counts[46]) / n * 4),
        min(1.0, len(lines) / n * 5),
        1 - len(set(lines)) / max(1, len(lines)),
        *[min(1.0, m) for m in marks],
        min(1.0, sum(marks)),
        float(sum(marks) > 0.2),
        float(again > 0.2),
        float(distinct / n < 0.3),
        float(pairs / max(1, n - 1) < 0.5),
    ]


STATISTICS = 31
#: A constant, the statistics and their squares.
DIMENSIONS = 1 + 2 * STATISTICS


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        s = np.array([statistics(t or b"") for t in texts]).reshape(-1, STATISTICS)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), blobs(np.concatenate([np.ones((len(s), 1)), s, s * s], axis=1))], names=["id", "row", "x"])


def _sums(df: DataFrame, scale: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Rows, sum of sigmoid(g) x, sum of its Hessian, sum of softplus(g)."""
    d = DIMENSIONS

    def part(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0), d) / scale
        g = x @ w
        p = sigmoid(g)
        return np.concatenate([[len(g), softplus(g).sum()], x.T @ p, (x.T @ (x * (p * (1 - p))[:, None])).ravel()])

    t = summed(df, part, 2 + d + d * d)
    return t[0], t[2 : 2 + d], t[2 + d :].reshape(d, d), t[1]


def fit_pu(unlabelled: DataFrame, positive: DataFrame, prior: float, scale: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weights that minimise the non-negative risk; both frames have the feature blob alone."""
    d = DIMENSIONS
    mean = summed(positive, lambda b: np.concatenate([[b.num_rows], (matrix(b.column(0), d) / scale).sum(axis=0)]), 1 + d)
    mean = mean[1:] / max(1.0, mean[0])
    w = np.zeros(d)
    for _ in range(ROUNDS):
        n, gradient, hessian, loss = _sums(unlabelled, scale, w)
        n_p, gradient_p, _, loss_p = _sums(positive, scale, w)
        negative = loss / max(n, 1) - prior * loss_p / max(n_p, 1)
        if negative < 0:
            # The negative part has gone below zero, which only overfitting does: climb it instead.
            step = -0.1 * (gradient / max(n, 1) - prior * gradient_p / max(n_p, 1))
        else:
            # For the logistic loss loss(g) - loss(-g) = -g, so positives enter by their mean alone.
            step = solve(hessian / max(n, 1), gradient / max(n, 1) - prior * mean + ridge * w, ridge)
        w = w - step * min(1.0, 10.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-3:
            break
    return w


def estimate_prior(unlabelled: DataFrame, positive: DataFrame, w: np.ndarray, scale: np.ndarray) -> float:
    """Least ratio of unlabelled to positive rows above a threshold of g, over thresholds with enough positives."""
    d = DIMENSIONS

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        g = np.clip(matrix(batch.column(0), d) / scale @ w, -9.99, 9.99)
        return np.bincount(((g + 10) * BINS / 20).astype(int), minlength=BINS).astype(float)

    u, p = (summed(df, histogram, BINS)[::-1].cumsum() for df in (unlabelled, positive))
    if not p[-1] or not u[-1]:
        return 0.5
    above_u, above_p = u / u[-1], p / p[-1]
    # Both shares are known up to the square root of their counts.
    slack = np.sqrt(1 / u[-1]) + np.sqrt(1 / p[-1])
    ratio = (above_u + slack * np.sqrt(above_u)) / np.maximum(above_p, 1e-9)
    return float(np.clip(ratio[above_p >= LEAST_ABOVE].min(), 0.05, 0.98))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", row_col: str | None = None, threshold: float = 0.7) -> DataFrame:
    """One row per row of docs: <id_col>, score (0 to 1), predicted (1 if score >= threshold).

    labels must hold only the rows to learn from; rows of label 1 are the trusted positives, others
    are not used.
    """
    spark = docs.sparkSession
    small_batches(spark)
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col).cast("long")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), row.alias("row"))
    rows = written(source.mapInArrow(_features, "id long, row long, x binary"), "features")
    # Stored apart from the rows, so that adaptive execution can split an id of very many rows; never broadcast.
    trusted = written(labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("id")).distinct(), "trusted")
    unlabelled, positive = rows.select("x"), written(rows.join(trusted.hint("merge"), "id", "left_semi").select("x"), "positive")
    d = DIMENSIONS
    t = summed(unlabelled, lambda b: np.concatenate([[b.num_rows], (matrix(b.column(0), d) ** 2).sum(axis=0)]), 1 + d)
    scale = np.sqrt(np.maximum(t[1:] / max(t[0], 1), 1e-6))
    # Positives against unlabelled rows in equal parts: the same risk with the prior of one half.
    prior = estimate_prior(unlabelled, positive, fit_pu(unlabelled, positive, 0.5, scale), scale)
    w = fit_pu(unlabelled, positive, prior, scale)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigmoid(matrix(batch.column(2), d) / scale @ w))], names=["id", "row", "score"])

    out = rows.mapInArrow(scored, "id long, row long, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *([] if row_col is None else [F.col("row").alias(row_col)]))
