"""Small dense solves on the driver or by group: n columns, n^2 doubles. The data behind them stay distributed."""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship

#: Columns that one process solves densely; beyond, solve blocks of interactions.
MOST_COLUMNS = 8000


def dense(triangle: DataFrame, n_columns: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(G, r, sum of f^2) from the augmented upper triangle (i, j, v)."""
    if n_columns > MOST_COLUMNS:
        raise ValueError(f"{n_columns} columns are more than {MOST_COLUMNS}: solve in blocks")
    got = triangle.toPandas()
    return from_triangle(got, n_columns)


def from_triangle(got: pd.DataFrame, n_columns: int) -> tuple[np.ndarray, np.ndarray, float]:
    m = np.zeros((n_columns + 1, n_columns + 1))
    m[got["i"].to_numpy(int), got["j"].to_numpy(int)] = got["v"].to_numpy(float)
    m = np.triu(m) + np.triu(m, 1).T
    return m[:n_columns, :n_columns], m[:n_columns, n_columns], float(m[n_columns, n_columns])


def precondition(g: np.ndarray) -> np.ndarray:
    """h_j = 1 / |column j|, 1 for an empty column."""
    size = np.sqrt((g * g).sum(0))
    return np.where(size > 1e-14, 1 / np.where(size > 1e-14, size, 1), 1.0)


def solve(g: np.ndarray, r: np.ndarray, rcond: float = -1.0, ridge: float = 0.0, diagonal: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(solution, singular values): `diagonal` is added before column preconditioning, ridge^2 after it, then least squares."""
    g = g + np.diag(diagonal) if diagonal is not None else g.copy()
    h = precondition(g)
    scaled = g * h
    if ridge:
        scaled = scaled + ridge**2 * np.eye(len(g))
    y, _, _, s = np.linalg.lstsq(scaled, r, rcond=None if rcond < 0 else rcond)
    return h * y, s


def residual(g: np.ndarray, r: np.ndarray, f2: float, x: np.ndarray, norm: float = 1.0) -> float:
    return float((x @ g @ x - 2 * x @ r) / norm + f2)


@dataclasses.dataclass
class Bayes:
    alpha: np.ndarray
    beta: float
    solution: np.ndarray
    residual: float


def bayesian(g: np.ndarray, r: np.ndarray, f2: float, observations: float, norm: float = 1.0, rounds: int = 10, rcond: float = -1.0) -> list[Bayes]:
    """Relevance-vector regularisation: a precision alpha_i for each coefficient and a noise precision beta, in fixed rounds.

    observations is the number of force components. The trace uses the unregularised matrix. One entry for each round,
    the first being the plain solution.
    """
    x, _ = solve(g, r, rcond)
    left = residual(g, r, f2, x, norm)
    n = len(r)
    alpha, beta = np.full(n, n / max(x @ x, 1e-300)), observations / max(left, 1e-300)
    trace = [Bayes(alpha, beta, x, left)]
    for _ in range(rounds):
        x, _ = solve(g, r, rcond, diagonal=alpha * norm / beta)
        left = residual(g, r, f2, x, norm)
        inverse = np.linalg.pinv(g + np.diag(alpha * norm / beta))
        effective = float(np.trace(inverse @ g))
        alpha = 1 / np.maximum(x * x + np.diag(inverse) * norm / beta, 1e-300)
        beta = (observations - effective) / max(left, 1e-300)
        trace.append(Bayes(alpha, beta, x, left))
    return trace


def filtered(a: np.ndarray, b: np.ndarray, ridge: float = 0.0, eps: float = np.finfo(float).eps) -> np.ndarray:
    """Solution of a x = b from its singular values: cut at eps, or filtered by s / (s^2 + ridge^2)."""
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    with np.errstate(divide="ignore"):
        factor = s / (s * s + ridge**2) if ridge else np.where(s > eps, 1 / np.where(s > eps, s, 1), 0.0)
    return vt.T @ (factor * (u.T @ b))


def l_curve(a: np.ndarray, b: np.ndarray, ridges: list[float]) -> pd.DataFrame:
    """(ridge, misfit, size, curvature) for each ridge: norms of the residual and of the solution, and the curve's bend in log-log."""
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    c = u.T @ b
    outside = max(float(b @ b - c @ c), 0.0)
    rows = []
    for ridge in ridges:
        f = s * s / (s * s + ridge**2)
        x = f * c / np.where(s > 0, s, 1)
        rows.append((ridge, np.sqrt((((1 - f) * c) ** 2).sum() + outside), np.sqrt((x * x).sum())))
    out = pd.DataFrame(rows, columns=["ridge", "misfit", "size"])
    p, q = np.log(np.maximum(out["misfit"], 1e-300)), np.log(np.maximum(out["size"], 1e-300))
    if len(out) >= 3:
        t = np.log(np.maximum(out["ridge"], 1e-300))
        p1, q1 = np.gradient(p, t), np.gradient(q, t)
        p2, q2 = np.gradient(p1, t), np.gradient(q1, t)
        out["curvature"] = (p1 * q2 - q1 * p2) / np.maximum((p1 * p1 + q1 * q1) ** 1.5, 1e-300)
    else:
        out["curvature"] = 0.0
    return out


def increment(g: np.ndarray, reference: np.ndarray, current: np.ndarray, x0: np.ndarray, step: float = 1.0, rcond: float = -1.0) -> np.ndarray:
    """x0 + step * solution of G d = reference - current."""
    return x0 + step * solve(g, reference - current, rcond)[0]


def by_group(triangles: DataFrame, n_columns: int, key: str | list[str], ridge: float = 0.0, rcond: float = -1.0) -> DataFrame:
    """(key, col, x): one solve for each replica or block of (key, i, j, v); groups hold one triangle each."""
    ship(triangles.sparkSession)
    keys = [key] if isinstance(key, str) else list(key)
    kinds = "".join(f"{k} {triangles.schema[k].dataType.simpleString()}, " for k in keys)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g, r, _ = from_triangle(group, n_columns)
        x, _ = solve(g, r, rcond, ridge)
        return pd.DataFrame({**{k: [group[k].iloc[0]] * n_columns for k in keys}, "col": np.arange(n_columns, dtype=np.int32), "x": x})

    return triangles.groupBy(*keys).applyInPandas(run, f"{kinds}col int, x double")


def from_factor(factor: DataFrame, n_columns: int, rcond: float = -1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(x, singular values, residual): minimum-norm least squares from the upper triangle R of [A f] (normal.tsqr), without squaring A.

    Singular values of R's first n columns are those of A. Values up to rcond times the largest count as 0 (below 0:
    machine precision times the number of columns), so columns that repeat each other share their coefficient. R is as
    large as one triangle of normal equations, and as those stays on the driver up to MOST_COLUMNS columns.
    """
    if n_columns > MOST_COLUMNS:
        raise ValueError(f"{n_columns} columns are more than {MOST_COLUMNS}: solve in blocks")
    got = factor.toPandas()
    m = np.zeros((n_columns + 1, n_columns + 1))
    m[got["i"].to_numpy(int), got["j"].to_numpy(int)] = got["v"].to_numpy(float)
    u, s, vt = np.linalg.svd(m[:, :n_columns], full_matrices=False)
    cut = (rcond if rcond >= 0 else np.finfo(float).eps * (n_columns + 1)) * s.max(initial=0.0)
    keep = s > cut
    x = vt[keep].T @ ((u[:, keep].T @ m[:, n_columns]) / s[keep])
    return x, s, float(((m[:, :n_columns] @ x - m[:, n_columns]) ** 2).sum())


def block_average(solutions: DataFrame, most: float = 1000.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, col, x, n): mean over blocks of the coefficients that are not 0 and below `most` in size; `by` may name replicas."""
    from pyspark.sql import functions as F

    fine = (F.col("x") != 0) & (F.abs("x") < most)
    return solutions.groupBy(*by, "col").agg(F.coalesce(F.avg(F.when(fine, F.col("x"))), F.lit(0.0)).alias("x"), F.count(F.when(fine, 1)).alias("n"))


def standard_error(values: DataFrame, by: list[str]) -> DataFrame:
    """(by, se): sqrt(sum v^2 - (sum v)^2 / (B + 1)) / (B + 1) over the master and B replicas."""
    from pyspark.sql import functions as F

    n, s, q = F.count("v"), F.sum("v"), F.sum(F.col("v") * F.col("v"))
    return values.groupBy(*by).agg((F.sqrt(F.greatest(q - s * s / n, F.lit(0.0))) / n).alias("se"))
