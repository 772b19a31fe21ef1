"""Tile kernels in NumPy, and their flop counts."""

from __future__ import annotations

import numpy as np


def chol(x: np.ndarray) -> np.ndarray:
    return np.linalg.cholesky(x)


def trsm(low: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Z with Z lowᵀ = y."""
    if not y.any():
        return np.zeros_like(y)
    return np.linalg.solve(low, y.T).T


def trsm_sub(upper: np.ndarray, s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Z with upper Z = x − s, for an upper triangular tile; what lies below its diagonal is not read."""
    return np.linalg.solve(np.triu(upper), x - s)


def syrk(s: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """s − x yᵀ."""
    return s - x @ y.T if x.any() and y.any() else s


def qr_factor(*blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """V, T, R of the blocks stacked: Q = I − V T Vᵀ, V unit lower trapezoidal, R its upper triangle."""
    a = np.vstack(blocks).astype(float)
    m, n = a.shape
    k = min(m, n)
    v, t = np.zeros((m, k)), np.zeros((k, k))
    for c in range(k):
        x = a[c:, c]
        norm = np.linalg.norm(x[1:])
        w = np.zeros(m - c)
        w[0] = 1.0
        if norm == 0:
            tau = 0.0
        else:
            alpha = -np.copysign(np.hypot(x[0], norm), x[0])
            tau = (alpha - x[0]) / alpha
            w[1:] = x[1:] / (x[0] - alpha)
        a[c:, c:] -= tau * np.outer(w, w @ a[c:, c:])
        v[c:, c] = w
        t[:c, c] = -tau * (t[:c, :c] @ (v[:, :c].T @ v[:, c]))
        t[c, c] = tau
    return v, t, np.triu(a[:k])


def qr_leaf(v: np.ndarray, t: np.ndarray, s: np.ndarray, back: bool = False) -> np.ndarray:
    """Qᵀ s, or Q s if ``back``."""
    return s - v @ ((t if back else t.T) @ (v.T @ s))


def qr_trailing(v: np.ndarray, t: np.ndarray, upper: np.ndarray, lower: np.ndarray | None, back: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Qᵀ (or Q) of two stacked tiles. ``upper`` may have more rows than V's first part; the rest is not touched."""
    if lower is None:
        return qr_leaf(v, t, upper, back), None
    k = len(v) - len(lower)
    both = qr_leaf(v, t, np.vstack([upper[:k], lower]), back)
    return np.vstack([both[:k], upper[k:]]), both[k:]


def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of the upper bidiagonal matrix that Householder steps from both sides make of ``a``."""
    a = a.astype(float).copy()
    if a.shape[0] < a.shape[1]:
        a = a.T.copy()
    n = a.shape[1]
    for c in range(n):
        v, t, _ = qr_factor(a[c:, c : c + 1])
        a[c:, c:] = qr_leaf(v, t, a[c:, c:])
        if c < n - 2:
            v, t, _ = qr_factor(a[c, c + 1 :][:, None])
            a[c:, c + 1 :] = qr_leaf(v, t, a[c:, c + 1 :].T).T
    return np.diag(a).copy(), np.diag(a, 1).copy()


#: Flops of a kernel that reads ``tiles`` square tiles of ``b`` by ``b`` (V is as tall as what was factored).
FLOPS = {
    "chol": lambda b, tiles: b**3 / 3,
    "trsm": lambda b, tiles: b**3,
    "syrk": lambda b, tiles: 2 * b**3 + b**2,
    "gemm": lambda b, tiles: 2 * b**3,
    "add_matrices": lambda b, tiles: (tiles - 1) * b**2,
    "identity": lambda b, tiles: 0,
    **dict.fromkeys(("qr_factor", "qr_factor_triangular", "lq_factor"), lambda b, tiles: 2 * tiles * b**3 - 2 * b**3 / 3),
    **dict.fromkeys(("qr_leaf", "lq_leaf"), lambda b, tiles: 3 * b**3 + b**2),
    **dict.fromkeys(("qr_trailing_update", "lq_trailing_update"), lambda b, tiles: 4 * b**3 + b**2),
}
