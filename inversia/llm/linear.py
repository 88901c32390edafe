"""Linear classifiers over hashed features: Spark fits them, numpy scores whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inversia.llm.workspace import LONG_ROWS, few_at_once

FIT_TASKS = 4


def bounded(rows: DataFrame, row: str, most: int) -> DataFrame:
    """About ``most`` of the different values of ``row``, a hash, or all if there are fewer."""
    different = rows.select(row).distinct()
    n = different.count()
    if n <= most:
        return rows
    place = F.pmod(F.xxhash64(F.lit(7), row), F.lit(1 << 52)) / float(1 << 52)
    return rows.where(place < most / n)


def fit_sparse(rows: DataFrame, scale: np.ndarray, l2: float, iterations: int = 25) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a logistic model from ``label``, ``weight`` and ``i``, the
    indices of the features that are present, each of which has the value ``scale[i]``, times its
    entry in ``v`` if there is such a column.

    L-BFGS steps on the mean loss; each is one pass over the (bounded) rows, whose tasks' sums are
    added up before the driver gets them: it holds one vector a step, however many tasks there are.
    (Spark's own fit scales every feature by its deviation, so that in so many steps rare features,
    most of them noise, take the place of frequent ones.)"""
    size, spark = len(scale), rows.sparkSession
    valued = "v" in rows.columns
    rows = rows.select("label", "weight", "i", *(["v"] if valued else [])).coalesce(FIT_TASKS)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast((scale * w[:-1], float(w[-1])))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (own, intercept), gradient = sent.value, np.zeros(size + 1)
            total, weights = 0.0, 0.0
            for batch in batches:
                for at in range(0, len(batch), LONG_ROWS):
                    part = batch.slice(at, LONG_ROWS)
                    y, weight = part.column("label").to_numpy(), part.column("weight").to_numpy()
                    lengths, i = part.column("i").value_lengths().to_numpy(), part.column("i").flatten().to_numpy()
                    row = np.repeat(np.arange(len(y)), lengths)
                    v = part.column("v").flatten().to_numpy() if valued else 1.0
                    z = np.bincount(row, own[i] * v, len(y)) + intercept
                    error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
                    gradient[:-1] += np.bincount(i, error[row] * v, size)
                    gradient[-1] += error.sum()
                    total += float(weight @ (np.logaddexp(0.0, z) - y * z))
                    weights += float(weight.sum())
            vector = np.concatenate([gradient, [total, weights]])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([vector.tobytes()])], ["part", "vector"])

        with few_at_once(spark):
            vector = added(rows.mapInArrow(sums, "part int, vector binary"))
        sent.destroy()
        total, n = vector[-2:]
        gradient = vector[:-2] / n
        gradient[:-1] *= scale
        gradient[:-1] += l2 * w[:-1]
        return float(total / n + l2 / 2 * float(w[:-1] @ w[:-1])), gradient

    w = lbfgs(loss, np.zeros(size + 1), iterations)
    return w[:-1], float(w[-1])


def added(parts: DataFrame) -> np.ndarray:
    """The sum of the vectors (``part``, ``vector``: doubles as bytes) of a few tasks, by part, made in
    one task. It comes as Arrow, which the driver need not turn into rows and pickles of that size."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for batch in batches:
            found |= zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([sum(np.frombuffer(found[i]) for i in sorted(found)).tobytes()])], ["vector"])

    whole = parts.repartition(1).mapInArrow(total, "vector binary").toArrow()
    return np.frombuffer(whole["vector"][0].as_buffer())


def lbfgs(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, iterations: int, tol: float = 1e-6, pairs: int = 10) -> np.ndarray:
    """Where the loss (value and gradient) is least, by limited-memory BFGS with halved steps."""
    value, gradient = loss(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        step, taken = gradient.copy(), []
        for s, y in reversed(moves):
            taken.append((s @ step) / (s @ y))
            step -= taken[-1] * y
        step *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, float(np.linalg.norm(gradient)))
        for (s, y), a in zip(moves, reversed(taken)):
            step += s * (a - (y @ step) / (s @ y))
        length, slope = 1.0, float(gradient @ step)
        following = loss(w - step)
        while following[0] > value - 1e-4 * length * slope and length > 1e-6:
            length /= 2
            following = loss(w - length * step)
        if following[0] >= value:
            break
        move, change = -length * step, following[1] - gradient
        if move @ change > 1e-12:
            moves = [*moves, (move, change)][-pairs:]
        w, gain = w + move, value - following[0]
        value, gradient = following
        if gain < tol * max(abs(value), 1e-3):
            break
    return w


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -500.0, 500.0))))
