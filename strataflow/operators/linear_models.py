"""Logistic and ridge regression by aggregation: every step is one pass that adds up a gradient, or a matrix, of fixed size.

Null features or targets leave a row out of fitting. A table without rows gives weights of zero.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import staged


def linear(x: str, w: np.ndarray, b: float) -> Column:
    """w x + b for an array column."""
    return sum((F.col(x)[i] * F.lit(float(v)) for i, v in enumerate(w)), F.lit(float(b)))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.lit(500.0), F.greatest(F.lit(-500.0), z))))


def _sums(rows: DataFrame, terms: list[Column]) -> list[float]:
    return [v or 0.0 for v in rows.agg(*[F.sum(t).alias(f"s{i}") for i, t in enumerate(terms)]).first()]


def fit_logistic(rows: DataFrame, target: str, features: int, steps: int, rate: float = 0.1, c: float = 1.0, decay: float = 0.0, newton: bool = False) -> tuple[np.ndarray, float]:
    """Weights and bias after `steps` steps from zero, with the L2 penalty 1 / (c n) on the weights alone: by gradient, or, with
    `newton`, by the gradient and the matrix of second derivatives, which takes few steps."""
    rows = rows.select("x", F.col(target).cast("double").alias("y")).where("x is not null and y is not null")
    rows = staged(rows.where(~F.exists("x", lambda v: v.isNull())), "logistic")
    n = rows.count()
    w, b, now = np.zeros(features), 0.0, rate
    if not n:
        return w, b
    penalty = 1.0 / (c * n)
    for step in range(steps):
        p = sigmoid(linear("x", w, b))
        told = rows.select("x", (p - F.col("y")).alias("e"), (p * (1 - p)).alias("s"))
        terms = [F.col("e")] + [F.col("e") * F.col("x")[i] for i in range(features)]
        if newton:
            ext = [F.lit(1.0)] + [F.col("x")[i] for i in range(features)]
            terms += [F.col("s") * ext[i] * ext[j] for i in range(features + 1) for j in range(i, features + 1)]
        got = np.array(_sums(told, terms)) / n
        grad = got[: features + 1] + np.concatenate(([0.0], penalty * w))
        if newton:
            second = np.zeros((features + 1, features + 1))
            second[np.triu_indices(features + 1)] = got[features + 1 :]
            second = second + np.triu(second, 1).T + np.diag([0.0] + [penalty] * features)
            move = np.linalg.solve(second, grad)
        else:
            move = now * grad
        b, w = b - move[0], w - move[1:]
        if decay:
            now = rate / (1.0 + decay * step)
    return w, float(b)


def moments(rows: DataFrame, target: str, features: int, by: str | None = None) -> dict:
    """For each value of `by` (or None): n, the sums of (x, y) and of their products, as one aggregation."""
    both = [F.col("x")[i] for i in range(features)] + [F.col(target)]
    terms = [F.count("*").alias("n")] + [F.sum(t).alias(f"s{i}") for i, t in enumerate(both)]
    terms += [F.sum(both[i] * both[j]).alias(f"q{i}_{j}") for i in range(features + 1) for j in range(i, features + 1)]
    out = {}
    for r in (rows.groupBy(by).agg(*terms) if by else rows.agg(*terms)).collect():  # a row a fold
        square = np.zeros((features + 1, features + 1))
        for i in range(features + 1):
            for j in range(i, features + 1):
                square[i, j] = square[j, i] = r[f"q{i}_{j}"] or 0.0
        out[r[by] if by else None] = (r["n"], np.array([r[f"s{i}"] or 0.0 for i in range(features + 1)]), square)
    return out


def solve_ridge(n: int, sums: np.ndarray, squares: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and bias that make squared errors plus alpha times the squared weights least; the bias is free."""
    if not n:
        return np.zeros(len(sums) - 1), 0.0
    centred = squares - np.outer(sums, sums) / n
    size = len(sums) - 1
    w = np.linalg.solve(centred[:size, :size] + alpha * np.eye(size), centred[:size, size])
    return w, float(sums[size] / n - w @ sums[:size] / n)


def ridge_scores(folds: dict, alphas: list[float]) -> dict[float, float]:
    """The mean R² of each alpha over folds, each held out in turn, from the folds' moments alone."""
    out = {}
    for alpha in alphas:
        scores = []
        for held, (n, sums, squares) in folds.items():
            rest = [v for k, v in folds.items() if k != held]
            w, b = solve_ridge(sum(r[0] for r in rest), sum(r[1] for r in rest), sum(r[2] for r in rest), alpha)
            size = len(w)
            # squared errors by the moments: v = (w, -1) on (x, y), plus b
            v = np.append(w, -1.0)
            sse = v @ squares @ v + 2 * b * (v @ sums) + b * b * n
            sst = squares[size, size] - sums[size] ** 2 / n
            scores.append(1 - sse / sst)
        out[alpha] = float(np.mean(scores))
    return out
