"""Logistic models fitted by Newton steps whose sums run over all rows in Spark.

A row's features are a float32 blob. Each step is one pass: partitions sum gradients and Hessians in
numpy, Spark adds them up by position, and only d * (d + 1) numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blobs(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a column of float32 blobs."""
    x = np.ascontiguousarray(x, "<f4")
    return pa.array([r.tobytes() for r in x], pa.binary())


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, d).astype(np.float64)


def sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def softplus(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, g)


def summed(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of a vector of `size` numbers, added up in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "v"])

    out = np.zeros(size)
    for row in df.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[row["at"]] = row["v"]
    return out


def solve(hessian: np.ndarray, gradient: np.ndarray, ridge: float) -> np.ndarray:
    d = len(gradient)
    return np.linalg.solve(hessian + ridge * np.eye(d), gradient)


def fit_soft(df: DataFrame, target: Callable[[pa.RecordBatch], np.ndarray], d: int, rounds: int = 7, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic model for soft targets; df's first column is the feature blob."""
    w = np.zeros(d)
    for _ in range(rounds):

        def part(batch: pa.RecordBatch, w=w) -> np.ndarray:
            x = matrix(batch.column(0), d)
            p = sigmoid(x @ w)
            q = target(batch)
            return np.concatenate([[len(p)], x.T @ (p - q), (x.T @ (x * (p * (1 - p))[:, None])).ravel()])

        total = summed(df, part, 1 + d + d * d)
        n = max(total[0], 1.0)
        step = solve(total[1 + d :].reshape(d, d) / n, total[1 : 1 + d] / n + ridge * w, ridge)
        w = w - step * min(1.0, 8.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-3:
            break
    return w
