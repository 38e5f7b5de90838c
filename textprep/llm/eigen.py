"""Eigenvectors of a symmetric matrix by mixed-precision refinement.

The start comes from single precision. Each step multiplies matrices in extended precision to
see how far the vectors are from orthonormal and from diagonalising the matrix, and corrects
both at once (Ogita and Aishima, 2018); the error is squared by every step. Eigenvalues closer
than the step can tell apart form a cluster: its vectors only span the right space, and a small
problem of the cluster's own, shifted to its middle, turns them within that space (2019).
"""

from __future__ import annotations

import numpy as np

STEPS = 12
DONE = 1e-15  # a correction so small leaves its square


def _clusters(values: np.ndarray, close: np.longdouble) -> list[np.ndarray]:
    """Places of eigenvalues that follow each other closer than ``close``, two or more."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > close) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values, vectors`` by falling value, in extended precision; vectors are columns.

    Vectors of equal values are any orthonormal basis of their space. The largest component of
    a vector is positive.
    """
    a = np.asarray(matrix, np.longdouble)
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(len(a), np.longdouble), np.eye(len(a), dtype=np.longdouble)
    a = a / scale
    size = np.sqrt((a * a).sum())
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    unit = np.eye(len(a), dtype=np.longdouble)
    last = np.inf
    least = 8 * len(a) * np.finfo(np.longdouble).eps * size  # rounding of the products
    for _ in range(STEPS):
        r = unit - x.T @ x
        s = x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        close = 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum()))
        close = max(close, least)
        gaps = values[None, :] - values[:, None]
        apart = np.abs(gaps) > close
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1), r / 2)
        x = x + x @ e
        for places in _clusters(values, close):
            own = x[:, places]
            middle = values[places].mean()
            inner = own.T @ (a @ own - middle * own)
            width = np.abs(inner).max()
            if width > least:
                turn = np.linalg.eigh((inner / width).astype(np.float64))[1]
                x[:, places] = own @ turn.astype(np.longdouble)
        now = np.abs(e).max()
        if now < DONE or (last < 1e-4 and now > last / 2):  # the rest is rounding of close values
            break
        last = now
    x = (3 * x - x @ (x.T @ x)) / 2
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order] * scale
    x = x / np.sqrt((x * x).sum(axis=0))
    largest = np.abs(x).argmax(axis=0)
    return values, x * np.where(x[largest, np.arange(len(a))] < 0, -1, 1)
