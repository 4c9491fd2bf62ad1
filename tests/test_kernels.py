"""HMM numerics: brute force on tiny sequences, blocked vs loop, EM properties."""

import itertools

import numpy as np
import pytest

from regimekit.plans import hmm_kernels as K


def _brute(X, pi, A, means, cov):
    logB = K.log_density(X, means[None], cov[None])[0]
    T, k = logB.shape
    total, best, post = 0.0, (-np.inf, None), np.zeros((T, k))
    for path in itertools.product(range(k), repeat=T):
        lp = np.log(pi[path[0]]) + logB[0, path[0]]
        for t in range(1, T):
            lp += np.log(A[path[t - 1], path[t]]) + logB[t, path[t]]
        p = np.exp(lp)
        total += p
        for t in range(T):
            post[t, path[t]] += p
        if lp > best[0]:
            best = (lp, path)
    return np.log(total), np.array(best[1]), post / total, logB


@pytest.mark.parametrize("T,k,d,seed", [(1, 2, 1, 0), (4, 2, 2, 1), (6, 3, 2, 2), (5, 3, 1, 3)])
def test_brute_force(T, k, d, seed):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(T, d))
    pi = rng.dirichlet(np.ones(k))
    A = rng.dirichlet(np.ones(k), size=k)
    means = rng.normal(size=(k, d))
    cov = np.stack([np.eye(d) * (0.5 + j) for j in range(k)])
    ll, path, post, logB = _brute(X, pi, A, means, cov)
    got_ll = K.forward(logB[None], pi[None], A[None])[0][0]
    assert got_ll == pytest.approx(ll, abs=1e-10)
    vpath, _ = K.viterbi(logB[None], pi[None], A[None])
    assert list(vpath[0]) == list(path)
    gamma, ll2 = K.posterior(logB[None], pi[None], A[None])
    assert np.abs(gamma[0] - post).max() < 1e-10
    assert ll2[0] == pytest.approx(ll, abs=1e-10)


@pytest.mark.parametrize("T,k,S", [(2, 2, 3), (37, 3, 2), (500, 4, 20), (1001, 2, 40)])
def test_blocked_equals_loop(T, k, S):
    rng = np.random.default_rng(T)
    X = rng.normal(size=(T, 2)) * np.where(rng.random(T) < 0.5, 1.0, 3.0)[:, None]
    mu = rng.normal(size=(S, k, 2))
    cv = np.tile(np.eye(2) * 2.0, (S, k, 1, 1))
    sp = rng.dirichlet(np.ones(k), size=S)
    tm = rng.dirichlet(np.ones(k) * 3, size=(S, k))
    logB = K.log_density(X, mu, cv)
    ll, alpha, scale, B = K.forward(logB, sp, tm)
    beta = K.backward(B, scale, tm)
    g = alpha * beta
    g /= g.sum(2, keepdims=True)
    xi = tm * np.matmul(np.swapaxes(alpha[:, :-1], 1, 2), B[:, 1:] * beta[:, 1:] / scale[:, 1:, None])
    ll2, g2, xi2 = K.forward_backward_blocked(logB, sp, tm)
    assert np.abs(ll - ll2).max() < 1e-8
    assert np.abs(g - g2).max() < 1e-12
    assert np.abs(xi - xi2).max() < 1e-9 * max(1.0, np.abs(xi).max())


def _two_regimes(T=500, seed=0):
    rng = np.random.default_rng(seed)
    st = np.zeros(T, int)
    for t in range(1, T):
        st[t] = st[t - 1] if rng.random() < 0.95 else 1 - st[t - 1]
    X = rng.normal(size=(T, 1)) * np.where(st == 0, 1.0, 5.0)[:, None]
    return X, st


def _run_em(X, S=3, max_iter=60, tol=1e-4, min_covar=1e-3, cov_type="full"):
    rng = np.random.default_rng(7)
    sp = np.full((S, 2), 0.5)
    tm = np.tile(np.array([[0.9, 0.1], [0.1, 0.9]]), (S, 1, 1))
    mu = rng.normal(size=(S, 2, X.shape[1])) * 0.1
    cv = np.tile(np.stack([np.eye(X.shape[1]), 4 * np.eye(X.shape[1])]), (S, 1, 1, 1))
    if cov_type == "diag":
        cv = np.diagonal(cv, axis1=-2, axis2=-1).copy()
    return K.em_fit(X, sp, tm, mu, cv, max_iter=max_iter, tol=tol, min_covar=min_covar, cov_type=cov_type)


def test_em_recovers_two_regimes():
    X, st = _two_regimes()
    sp, tm, mu, cv, ll, n_iter, status, _ = _run_em(X)
    assert set(status) <= {"converged", "max_iter"}
    sd = np.sort(np.sqrt(cv[0, :, 0, 0]))
    assert 0.7 < sd[0] < 1.4 and 3.5 < sd[1] < 6.5
    assert np.allclose(tm.sum(axis=2), 1.0)
    assert np.allclose(sp.sum(axis=1), 1.0)
    # decoded regimes agree with the truth (up to label swap) on most steps
    logB = K.log_density(X, mu[:1], cv[:1])
    path, _ = K.viterbi(logB, sp[:1], tm[:1])
    calm = int(np.argmin(cv[0, :, 0, 0]))
    agree = np.mean((path[0] != calm) == (st == 1))
    assert agree > 0.9


def test_em_likelihood_monotone():
    X, _ = _two_regimes(300, seed=3)
    prev = -np.inf
    for it in range(1, 25):
        ll = _run_em(X, S=1, max_iter=it, tol=-np.inf, min_covar=1e-12)[4][0]
        assert ll >= prev - 1e-8
        prev = ll


def test_em_diag_covariance():
    X, _ = _two_regimes(300, seed=5)
    X = np.hstack([X, X * 0.5 + 0.1])
    out = _run_em(X, cov_type="diag")
    assert out[3].shape == (3, 2, 2)
    assert np.all(out[3] >= 1e-3)


def test_em_failure_is_isolated():
    X = np.zeros((30, 2))
    X[:, 0] = np.nan
    out = _run_em(X)
    assert set(out[6]) == {"failed"}


def test_gemm_density_equals_direct():
    rng = np.random.default_rng(4)
    X = rng.normal(size=(300, 4))
    S, k = 5, 3
    means = rng.normal(size=(S, k, 4))
    A = rng.normal(size=(S, k, 4, 4))
    cov = np.matmul(A, np.swapaxes(A, -1, -2)) + 0.5 * np.eye(4)
    ref = K.log_density(X, means, cov)
    assert np.abs(K.log_density_gemm(X, K.outer_terms(X), means, cov) - ref).max() < 1e-9
    Xs = np.stack([X + i for i in range(S)])
    ref2 = K.log_density(Xs, means, cov)
    assert np.abs(K.log_density_gemm(Xs, K.outer_terms(Xs), means, cov) - ref2).max() < 1e-8
