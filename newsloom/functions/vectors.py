"""Vector functions on whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def _rows(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _by_width(a: pd.Series, b: pd.Series, one) -> pd.Series:
    """``one`` on the rows of equal width; null elsewhere."""
    out = np.full(len(a), np.nan)
    usable = [i for i, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None and len(x) == len(y) and len(x)]
    widths: dict[int, list[int]] = {}
    for i in usable:
        widths.setdefault(len(a.iloc[i]), []).append(i)
    for rows in widths.values():
        out[rows] = one(_rows(a.iloc[rows]), _rows(b.iloc[rows]))
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


@F.pandas_udf(T.DoubleType())
def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine similarity; null where a vector is missing, empty, all zero or of another width."""

    def one(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))

    return _by_width(a, b, one)


@F.pandas_udf(T.DoubleType())
def dot(a: pd.Series, b: pd.Series) -> pd.Series:
    """Dot product; null where a vector is missing or of another width."""
    return _by_width(a, b, lambda x, y: np.einsum("ij,ij->i", x, y))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def unit(v: pd.Series) -> pd.Series:
    """A vector at length one; null for null, empty and all-zero vectors."""

    def one(x):
        if x is None or not len(x):
            return None
        x = np.asarray(x, np.float64)
        n = np.linalg.norm(x)
        return (x / n).tolist() if n > 0 else None

    return v.map(one)
