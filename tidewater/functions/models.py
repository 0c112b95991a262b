"""Linear models fitted from sums of products, and draws: pandas UDFs over one small array for each group.

The sums are the upper triangle, by rows, of the products of (1, x1, ..., xk, y); the first is the number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def unpacked(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """X'X, X'y, y'y and the number of rows."""
    size = int((np.sqrt(8 * len(sums) + 1) - 1) / 2)
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = sums
    full = full + np.triu(full, 1).T
    return full[:-1, :-1], full[:-1, -1], full[-1, -1], full[0, 0]


def fitted(sums: list, ridge: float) -> list | None:
    """[b0, b1, ...]; the penalty leaves the intercept out. Null without rows."""
    if sums is None:
        return None
    a, b, _, n = unpacked(np.asarray(sums, float))
    if not n > 0:
        return None
    return np.linalg.lstsq(a + np.diag([0.0] + [ridge] * (len(b) - 1)), b, rcond=None)[0].tolist()


@F.pandas_udf(ArrayType(DoubleType()))
def linear_reg(sums: pd.Series, ridge: pd.Series) -> pd.Series:
    return pd.Series([fitted(s, r) for s, r in zip(sums, ridge, strict=True)], dtype=object)


def posterior(sums: list, prior: float, noise: float | None) -> list | None:
    """[k, noise variance, mean (k), covariance (k x k)]; an unnamed noise variance is the ridge fit's residual one."""
    if sums is None:
        return None
    a, b, yy, n = unpacked(np.asarray(sums, float))
    if not n > 0:
        return None
    k = len(b)
    if noise is None or np.isnan(noise):
        beta = np.linalg.lstsq(a + prior * np.eye(k), b, rcond=None)[0]
        noise = max(1e-12, yy - 2 * beta @ b + beta @ a @ beta) / max(1.0, n - k)
    cov = np.linalg.pinv(a / noise + prior * np.eye(k))
    return [float(k), float(noise), *(cov @ b / noise).tolist(), *cov.ravel().tolist()]


@F.pandas_udf(ArrayType(DoubleType()))
def bayes_linreg(sums: pd.Series, prior: pd.Series, noise: pd.Series) -> pd.Series:
    return pd.Series([posterior(s, p, v) for s, p, v in zip(sums, prior, noise, strict=True)], dtype=object)


def predicted(model: list, features: list) -> list | None:
    """[mean, standard deviation with the noise] at a feature vector."""
    if model is None or features is None:
        return None
    m, x = np.asarray(model, float), np.concatenate([[1.0], np.asarray(features, float)])
    k = int(m[0])
    if len(x) != k:
        raise ValueError(f"the model has {k - 1} features, not {len(x) - 1}")
    return [float(m[2 : 2 + k] @ x), float(np.sqrt(m[1] + x @ m[2 + k :].reshape(k, k) @ x))]


@F.pandas_udf(ArrayType(DoubleType()))
def bayes_predict(model: pd.Series, features: pd.Series) -> pd.Series:
    return pd.Series([predicted(m, x) for m, x in zip(model, features, strict=True)], dtype=object)


@F.pandas_udf(DoubleType())
def beta_sample(alpha: pd.Series, beta: pd.Series, seed: pd.Series) -> pd.Series:
    """One draw of a Beta distribution for each row, a function of the arguments alone."""
    draw = lambda a, b, s: None if pd.isna(a) or pd.isna(b) or pd.isna(s) else np.random.default_rng([int(s) & (1 << 64) - 1, *np.array([a, b]).view(np.uint64).tolist()]).beta(a, b)
    return pd.Series([draw(*r) for r in zip(alpha, beta, seed, strict=True)], dtype=float)
