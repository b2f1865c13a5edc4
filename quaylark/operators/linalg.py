"""Dense linear algebra of many matrices (mat_id, row, col, value), a matrix a task's group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TINY = 1e-14
SYMMETRY = 1e-7
EPS = 2.22e-16


def dense(df: pd.DataFrame) -> np.ndarray:
    if not len(df):
        raise ValueError("a right side has no matrix of its id")
    m = np.zeros((int(df["row"].max()) + 1, int(df["col"].max()) + 1))
    m[df["row"], df["col"]] = df["value"]
    return m


def _square(m: np.ndarray) -> np.ndarray:
    if m.shape[0] != m.shape[1]:
        raise ValueError("the matrix isn't square")
    return m


def det(m: np.ndarray) -> float:
    lu_, swaps = lu(_square(m))
    d = np.diag(lu_)
    return 0.0 if (np.abs(d) < TINY).any() else float(np.prod(d)) * (-1) ** sum(i != s for i, s in enumerate(swaps))


def lu(m: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """L and U in one matrix, with partial pivots, and the row each step swapped with."""
    a, swaps = m.astype(float).copy(), []
    for i in range(min(a.shape)):
        p = i + int(np.abs(a[i:, i]).argmax())
        swaps.append(p)
        a[[i, p]] = a[[p, i]]
        if a[i, i] != 0:
            a[i + 1 :, i] /= a[i, i]
            a[i + 1 :, i + 1 :] -= np.outer(a[i + 1 :, i], a[i, i + 1 :])
    return a, swaps


def inverse(m: np.ndarray) -> np.ndarray:
    if abs(det(m)) < TINY:
        raise ArithmeticError("the matrix is singular")
    return np.linalg.inv(m)


def adjugate(m: np.ndarray) -> np.ndarray:
    n = len(_square(m))
    return np.array([[(-1) ** (i + j) * (np.linalg.det(np.delete(np.delete(m, j, 0), i, 1)) if n > 1 else 1.0) for j in range(n)] for i in range(n)])


def cholesky(m: np.ndarray) -> np.ndarray:
    if np.abs(_square(m) - m.T).max() > SYMMETRY:
        raise ValueError("the matrix isn't symmetric")
    try:
        return np.linalg.cholesky(m)
    except np.linalg.LinAlgError as e:
        raise ArithmeticError("the matrix isn't positive definite") from e


def pinv(m: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(m, rcond=max(m.shape) * EPS)


def rank(m: np.ndarray) -> float:
    s = np.linalg.svd(m, compute_uv=False)
    return float((s > s.max(initial=0.0) * max(m.shape) * EPS).sum())


def solve(m: np.ndarray, b: np.ndarray) -> np.ndarray:
    if np.isnan(m).any() or np.isnan(b).any():
        raise ValueError("NaN in the system")
    try:
        return np.linalg.solve(_square(m), b)
    except np.linalg.LinAlgError as e:
        raise ArithmeticError("the matrix is singular") from e


def eigen(m: np.ndarray) -> np.ndarray:
    """Rows of real and imaginary parts of the values."""
    if np.isnan(m).any():
        raise ValueError("NaN in the matrix")
    v = np.linalg.eigvals(_square(m))
    return np.column_stack((v.real, v.imag))


MATRIX = {"inv": inverse, "adj": adjugate, "cholesky": cholesky, "pinv": pinv, "eig": eigen, "lu": lambda m: lu(m)[0], "lu_swaps": lambda m: np.array([lu(m)[1]], float), "q": lambda m: np.linalg.qr(m, "complete")[0], "r": lambda m: np.linalg.qr(m, "complete")[1], "u": lambda m: np.linalg.svd(m)[0], "s": lambda m: np.linalg.svd(m)[1][:, None], "vt": lambda m: np.linalg.svd(m)[2]}
SCALAR = {"det": det, "rank": rank}


def by_matrix(df: DataFrame, f: str | Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The result matrix of each matrix, in the same form. f: a name of MATRIX or SCALAR, or a function."""
    g = f if callable(f) else MATRIX.get(f) or SCALAR[f]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        out = np.atleast_2d(g(dense(p)))
        r, c = np.indices(out.shape)
        return pd.DataFrame({"mat_id": p["mat_id"].iloc[0], "row": r.ravel(), "col": c.ravel(), "value": out.ravel()})

    return df.groupBy("mat_id").applyInPandas(run, "mat_id long, row int, col int, value double")


def solved(df: DataFrame, right: DataFrame) -> DataFrame:
    """(mat_id, idx, value) with matrix times value equal to right (mat_id, idx, value)."""

    def run(key, p: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        m = dense(p)
        v = np.zeros(len(m))
        v[b["idx"]] = b["value"]
        return pd.DataFrame({"mat_id": key[0], "idx": range(len(m)), "value": solve(m, v)})

    return df.groupBy("mat_id").cogroup(right.groupBy("mat_id")).applyInPandas(run, "mat_id long, idx int, value double")
