"""Small dense matrices, one a row, solved a batch at a time by LAPACK through numpy.

A matrix is an array of doubles by rows. Matrices of one batch are stacked by size, so a call serves all of a size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

NUMBERS = ArrayType(DoubleType())


def _stacks(matrices: pd.Series):
    """Row numbers and a stack for each size of matrix; nulls and matrices that aren't square are left out."""
    sizes = matrices.map(lambda m: -1 if m is None else math.isqrt(len(m)) if math.isqrt(len(m)) ** 2 == len(m) else -1).to_numpy(int)
    for n in set(sizes.tolist()) - {-1, 0}:
        at = np.flatnonzero(sizes == n)
        yield at, np.stack(matrices.iloc[at].to_list()).reshape(-1, n, n).astype(float)


@F.pandas_udf(NUMBERS)
def solve(matrices: pd.Series, sides: pd.Series) -> pd.Series:
    """x of Ax = b by LU with partial pivoting; null where A is singular."""
    out = [None] * len(matrices)
    for at, a in _stacks(matrices):
        fit = np.array([sides.iloc[i] is not None and len(sides.iloc[i]) == a.shape[1] for i in at])
        fit &= np.linalg.det(a) != 0
        if fit.any():
            b = np.stack([sides.iloc[i] for i in at[fit]]).astype(float)
            for i, x in zip(at[fit], np.linalg.solve(a[fit], b[:, :, None])[:, :, 0], strict=True):
                out[i] = x
    return pd.Series(out, dtype=object)


@F.pandas_udf(DoubleType())
def determinant(matrices: pd.Series) -> pd.Series:
    out = np.full(len(matrices), np.nan)
    for at, a in _stacks(matrices):
        out[at] = np.linalg.det(a)
    return pd.Series(out)


@F.pandas_udf(NUMBERS)
def inverse(matrices: pd.Series) -> pd.Series:
    """By rows; null where the matrix is singular."""
    out = [None] * len(matrices)
    for at, a in _stacks(matrices):
        fit = np.linalg.det(a) != 0
        for i, x in zip(at[fit], np.linalg.inv(a[fit]) if fit.any() else [], strict=True):
            out[i] = x.ravel()
    return pd.Series(out, dtype=object)


@F.pandas_udf(NUMBERS)
def symmetric_eigenvalues(matrices: pd.Series) -> pd.Series:
    """Ascending."""
    out = [None] * len(matrices)
    for at, a in _stacks(matrices):
        for i, x in zip(at, np.linalg.eigvalsh(a), strict=True):
            out[i] = x
    return pd.Series(out, dtype=object)


@F.pandas_udf(ArrayType(StructType().add("re", DoubleType()).add("im", DoubleType())))
def eigenvalues(matrices: pd.Series) -> pd.Series:
    """By real, then imaginary part; complex ones come in pairs."""
    out = [None] * len(matrices)
    for at, a in _stacks(matrices):
        for i, x in zip(at, np.linalg.eigvals(a), strict=True):
            out[i] = [{"re": float(v.real), "im": float(v.imag)} for v in sorted(x, key=lambda v: (round(v.real, 9), v.imag))]
    return pd.Series(out, dtype=object)


def sweep_rows(low: float, mid: float, high: float, sides: np.ndarray) -> np.ndarray:
    """Tridiagonal systems with constant bands, one a row of `sides`, by a forward and a backward sweep over all rows at once."""
    n = sides.shape[-1]
    p, q = np.zeros(n), np.zeros_like(sides)
    for i in range(n):
        scale = mid + (low * p[i - 1] if i else 0)
        p[i] = -high / scale
        q[..., i] = (sides[..., i] - (low * q[..., i - 1] if i else 0)) / scale
    for i in range(n - 2, -1, -1):
        q[..., i] += p[i] * q[..., i + 1]
    return q


def _pull(u: np.ndarray) -> np.ndarray:
    """Second difference along the last axis, zero beyond the ends."""
    wide = np.pad(u, [(0, 0)] * (u.ndim - 1) + [(1, 1)])
    return wide[..., :-2] - 2 * u + wide[..., 2:]


def heat_line(ratio: float, weight: float, steps: int):
    """Heat on lines of inner points with cold ends; weight 1 is implicit, 0.5 Crank and Nicolson's, 0 explicit."""

    @F.pandas_udf(NUMBERS)
    def march(states: pd.Series) -> pd.Series:
        u = np.stack(states.to_list()).astype(float)
        for _ in range(steps):
            sides = u + (1 - weight) * ratio * _pull(u)
            u = sweep_rows(-weight * ratio, 1 + 2 * weight * ratio, -weight * ratio, sides) if weight else sides
        return pd.Series(list(u))

    return march


def heat_plate(ratio: float, steps: int):
    """Heat on square plates of inner points, by rows, with cold borders: alternating directions, half a step each."""

    @F.pandas_udf(NUMBERS)
    def march(states: pd.Series) -> pd.Series:
        u = np.stack(states.to_list()).astype(float)
        n, half = math.isqrt(u.shape[1]), ratio / 2
        u = u.reshape(-1, n, n)
        for _ in range(2 * steps):
            sides = u + half * _pull(u)
            u = sweep_rows(-half, 1 + 2 * half, -half, sides.swapaxes(1, 2))
        return pd.Series(list(u.reshape(len(u), -1)))

    return march


def relax(omega: float, sweeps: int):
    """Laplace's equation on square plates, borders held: successive over-relaxation; omega 1 is Gauss and Seidel's."""

    @F.pandas_udf(NUMBERS)
    def march(states: pd.Series) -> pd.Series:
        u = np.stack(states.to_list()).astype(float)
        n = math.isqrt(u.shape[1])
        u = u.reshape(-1, n, n)
        for _ in range(sweeps):
            for i in range(1, n - 1):
                for j in range(1, n - 1):
                    near = (u[:, i - 1, j] + u[:, i + 1, j] + u[:, i, j - 1] + u[:, i, j + 1]) / 4
                    u[:, i, j] += omega * (near - u[:, i, j])
        return pd.Series(list(u.reshape(len(u), -1)))

    return march


def heat_plate_split(ratio: float, steps: int):
    """Heat on square plates of inner points, by rows, with cold borders: fractional steps, implicit along one axis after the other."""

    @F.pandas_udf(NUMBERS)
    def march(states: pd.Series) -> pd.Series:
        u = np.stack(states.to_list()).astype(float)
        n = math.isqrt(u.shape[1])
        u = u.reshape(-1, n, n)
        for _ in range(2 * steps):
            u = sweep_rows(-ratio, 1 + 2 * ratio, -ratio, u).swapaxes(1, 2)
        return pd.Series(list(u.reshape(len(u), -1)))

    return march


def wave_line(ratio: float, steps: int):
    """Waves on lines of inner points with fixed ends, at rest at first; implicit steps."""

    @F.pandas_udf(NUMBERS)
    def march(states: pd.Series) -> pd.Series:
        old = now = np.stack(states.to_list()).astype(float)
        for _ in range(steps - 1):
            old, now = now, sweep_rows(-ratio, 1 + 2 * ratio, -ratio, 2 * now - old)
        return pd.Series(list(now))

    return march


def sor_factor(columns: int, rows: int) -> float:
    """A factor for over-relaxation on a grid of so many steps."""
    return min(max(2.0 / (1.0 + math.sin(math.pi / max(columns, rows))), 1.0), 1.95)


def orthogonal_series(y, weight, low: float, high: float, terms: int, nodes: int = 32) -> list[tuple[int, float, float]]:
    """(n, coefficient, root mean square left) for the first n powers made orthogonal under a weight. Inner products are sums
    over Gauss nodes, which are exact for polynomials of degrees below twice their number."""
    x, w = np.polynomial.legendre.leggauss(nodes)
    t = (high - low) / 2 * x + (high + low) / 2
    w = w * (high - low) / 2 * weight(t)
    basis: list[np.ndarray] = []
    rest, out = y(t), []
    for n in range(terms):
        phi = t**n
        for other in basis:
            phi = phi - (w * phi * other).sum() / (w * other * other).sum() * other
        c = (w * rest * phi).sum() / (w * phi * phi).sum()
        basis.append(phi)
        rest = rest - c * phi
        out.append((n + 1, float(c), float(np.sqrt((w * rest * rest).sum()))))
    return out
