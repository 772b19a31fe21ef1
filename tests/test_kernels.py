import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilespark.functions import kernels

rng = np.random.default_rng(0)


@settings(max_examples=40, deadline=None)
@given(m=st.integers(1, 9), n=st.integers(1, 9), seed=st.integers(0, 99))
def test_qr_factor(m, n, seed):
    a = np.random.default_rng(seed).normal(size=(m, n))
    v, t, r = kernels.qr_factor(a)
    q = np.eye(m) - v @ t @ v.T
    assert np.allclose(q.T @ q, np.eye(m))
    full = np.zeros((m, n))
    full[: len(r)] = r
    assert np.allclose(q @ full, a) and np.allclose(r, np.triu(r))
    assert np.allclose(kernels.qr_leaf(v, t, a), full)


def test_zero_and_one_column():
    v, t, r = kernels.qr_factor(np.zeros((4, 2)))
    assert not r.any()
    assert np.allclose(abs(kernels.qr_factor(np.ones((4, 1)))[2]), 2)


def test_trailing_update_equals_whole():
    x, s = rng.normal(size=(7, 4)), rng.normal(size=(7, 3))
    v, t, _ = kernels.qr_factor(x)
    a, b = kernels.qr_trailing(v, t, s[:4], s[4:])
    assert np.allclose(np.vstack([a, b]), kernels.qr_leaf(v, t, s))


@pytest.mark.parametrize("shape", [(1, 1), (5, 5), (8, 5), (3, 6)])
def test_bidiagonal_keeps_singular_values(shape):
    a = rng.normal(size=shape)
    d, e = kernels.bidiagonal(a)
    assert np.allclose(np.linalg.svd(np.diag(d) + np.diag(e, 1), compute_uv=False), np.linalg.svd(a, compute_uv=False))


def test_cholesky_kernels():
    x = rng.normal(size=(5, 5))
    a = x @ x.T + np.eye(5)
    low = kernels.chol(a)
    assert np.allclose(kernels.trsm(low, a) @ low.T, a)
    assert not kernels.trsm(low, np.zeros((2, 5))).any()
    assert np.allclose(kernels.syrk(a, low, low), 0)
    z = kernels.trsm_sub(a, x, low)
    assert np.allclose(np.triu(a) @ z, low - x)


def test_reflectors_back_and_forth():
    x, s = rng.normal(size=(7, 4)), rng.normal(size=(7, 3))
    v, t, _ = kernels.qr_factor(x)
    assert np.allclose(kernels.qr_leaf(v, t, kernels.qr_leaf(v, t, s), back=True), s)
