"""Vectors and matrices over array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero norm; vectors of different lengths are an error."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    out = F.when(norms != 0, dot(a, b) / norms)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double")).otherwise(out)


def multiply(rows: list[list[float]], v: Column) -> Column:
    return F.array(*[dot(F.array(*map(F.lit, map(float, r))), v) for r in rows])


def mahalanobis(v: Column, mean: list[float], precision: list[list[float]] | None = None, covariance: list[list[float]] | None = None) -> Column:
    p = np.array(precision, float) if precision is not None else np.linalg.inv(np.array(covariance, float))
    d = F.zip_with(v, F.array(*map(F.lit, map(float, mean))), lambda x, m: x.cast("double") - m)
    return F.sqrt(F.greatest(F.lit(0.0), dot(d, multiply(p.tolist(), d))))


def solve(rows: list[list[float]]):
    """Least-squares solution of A x = b for a constant A, by its pseudo-inverse."""
    inverse = np.linalg.pinv(np.array(rows, float))

    @F.pandas_udf("array<double>")
    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda v: None if v is None else (inverse @ np.asarray(v, float)).tolist())

    return run


def poly_fit(degree: int):
    """Ascending coefficients; null with too few points."""

    @F.pandas_udf("array<double>")
    def run(y: pd.Series, x: pd.Series) -> pd.Series:
        def one(ys, xs):
            if ys is None or xs is None or len(ys) <= degree:
                return None
            return np.polynomial.polynomial.polyfit(np.asarray(xs, float), np.asarray(ys, float), degree).tolist()

        return pd.Series([one(a, b) for a, b in zip(y, x, strict=True)])

    return run
