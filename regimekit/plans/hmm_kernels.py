"""Gaussian HMM numerics used inside grouped Arrow tasks.

Every kernel is batched over a leading axis ``S`` of models (restarts of the
same K), so one task fits a whole chunk of seeds over one copy of the
sequence.  Shapes: ``X (T, D)``, ``means (S, K, D)``, ``covars (S, K, D, D)``
(full) or ``(S, K, D)`` (diag), ``startprob (S, K)``, ``transmat (S, K, K)``.

The forward pass uses linear-domain scaling with a per-step max shift of the
log-densities (no pairwise log-sum-exp), which keeps the cost O(T K^2).
"""

from __future__ import annotations

import numpy as np

LOG_2PI = float(np.log(2.0 * np.pi))
TINY = 1e-300


def full_covars(covars: np.ndarray, cov_type: str) -> np.ndarray:
    if cov_type == "diag":
        return covars[..., :, None] * np.eye(covars.shape[-1])
    return covars


def log_density(X: np.ndarray, means: np.ndarray, covars: np.ndarray, cov_type: str = "full") -> np.ndarray:
    """M1: log N(x_t; mu_k, Sigma_k) for every model, time step and state -> ``(S, T, K)``.

    ``X`` is one shared sequence ``(T, D)`` or one sequence per model ``(S, T, D)``.
    """
    D = X.shape[-1]
    if X.ndim == 2:
        diff = X[None, None, :, :] - means[:, :, None, :]  # (S, K, T, D)
    else:
        diff = X[:, None, :, :] - means[:, :, None, :]
    if cov_type == "diag":
        quad = np.sum(diff * diff / covars[:, :, None, :], axis=-1)
        logdet = np.sum(np.log(covars), axis=-1)
    else:
        chol = np.linalg.cholesky(covars)  # raises LinAlgError when not positive definite
        inv_chol = np.linalg.inv(chol)
        z = np.matmul(diff, np.swapaxes(inv_chol, -1, -2))  # (S, K, T, D)
        quad = np.sum(z * z, axis=-1)
        logdet = 2.0 * np.sum(np.log(np.diagonal(chol, axis1=-2, axis2=-1)), axis=-1)
    out = -0.5 * (D * LOG_2PI + logdet[:, :, None] + quad)
    return np.ascontiguousarray(out.transpose(0, 2, 1))


def outer_terms(X: np.ndarray) -> np.ndarray:
    """``x_t x_t^T`` flattened: ``(T, D*D)`` for one sequence, ``(S, T, D*D)`` per model."""
    D = X.shape[-1]
    return (X[..., :, None] * X[..., None, :]).reshape(*X.shape[:-1], D * D)


def log_density_gemm(X: np.ndarray, XX: np.ndarray, means: np.ndarray, covars: np.ndarray) -> np.ndarray:
    """Full-covariance log-densities ``(S, T, K)`` as matrix products (used inside EM).

    ``(x-mu)^T P (x-mu) = vec(x x^T).vec(P) - 2 x.(P mu) + mu^T P mu`` with the
    precision ``P``: two BLAS products over time instead of ``(S, K, T, D)``
    temporaries.  Same values as ``log_density`` up to rounding.
    """
    S, K, D = means.shape
    chol = np.linalg.cholesky(covars)
    inv_chol = np.linalg.inv(chol)
    prec = np.matmul(np.swapaxes(inv_chol, -1, -2), inv_chol)  # (S, K, D, D)
    logdet = 2.0 * np.sum(np.log(np.diagonal(chol, axis1=-2, axis2=-1)), axis=-1)
    pm = np.matmul(prec, means[..., None])[..., 0]  # (S, K, D)
    const = np.sum(means * pm, axis=-1)  # (S, K)
    # one product per model, so a model's numbers do not depend on how many are in the batch
    t1 = np.matmul(XX, prec.reshape(S, K, D * D).transpose(0, 2, 1))
    t2 = np.matmul(X, pm.transpose(0, 2, 1))
    quad = t1 - 2.0 * t2 + const[:, None, :]
    return -0.5 * (D * LOG_2PI + logdet[:, None, :] + quad)


def _shifted(logB: np.ndarray):
    shift = logB.max(axis=2, keepdims=True)
    shift = np.where(np.isfinite(shift), shift, 0.0)
    return np.exp(logB - shift), shift[..., 0]


def forward(logB: np.ndarray, startprob: np.ndarray, transmat: np.ndarray):
    """M2: scaled forward pass -> (loglik (S,), alpha (S,T,K), scale (S,T), B (S,T,K))."""
    S, T, K = logB.shape
    B, shift = _shifted(logB)
    alpha = np.empty((S, T, K))
    scale = np.empty((S, T))
    ones = np.ones(K)
    a = startprob * B[:, 0]
    c = np.maximum(a @ ones, TINY)
    scale[:, 0] = c
    alpha[:, 0] = a / c[:, None]
    # per-step einsum and a mat-vec row sum: about 2x cheaper than batched K x K matmuls
    for t in range(1, T):
        a = np.einsum("si,sij->sj", alpha[:, t - 1], transmat) * B[:, t]
        c = np.maximum(a @ ones, TINY)
        scale[:, t] = c
        alpha[:, t] = a / c[:, None]
    loglik = np.log(scale).sum(axis=1) + shift.sum(axis=1)
    return loglik, alpha, scale, B


def backward(B: np.ndarray, scale: np.ndarray, transmat: np.ndarray) -> np.ndarray:
    S, T, K = B.shape
    beta = np.empty((S, T, K))
    beta[:, T - 1] = 1.0
    for t in range(T - 2, -1, -1):
        beta[:, t] = np.einsum("sij,sj->si", transmat, B[:, t + 1] * beta[:, t + 1]) / scale[:, t + 1, None]
    return beta


def posterior(logB: np.ndarray, startprob: np.ndarray, transmat: np.ndarray):
    """M4: state posteriors ``(S, T, K)`` and the log-likelihood."""
    loglik, gamma, _ = e_step(logB, startprob, transmat)
    return gamma, loglik


def viterbi(logB: np.ndarray, startprob: np.ndarray, transmat: np.ndarray, valid: np.ndarray | None = None):
    """M3: most likely path per model ``(S, T)`` and its log-probability; ties -> lowest state.

    ``valid (S, T)`` marks real steps of padded sequences; padded steps keep the state.
    """
    S, T, K = logB.shape
    with np.errstate(divide="ignore"):
        log_a = np.log(transmat)
        log_pi = np.log(startprob)
        log_eye = np.log(np.eye(K))
    delta = log_pi + logB[:, 0]
    back = np.empty((S, T, K), dtype=np.int64)
    back[:, 0] = 0
    cols = np.arange(K)
    rows = np.arange(S)[:, None]
    for t in range(1, T):
        cand = delta[:, :, None] + log_a  # (S, from, to)
        if valid is not None and not valid[:, t].all():
            cand = np.where(valid[:, t, None, None], cand, delta[:, :, None] + log_eye)
        arg = cand.argmax(axis=1)
        back[:, t] = arg
        delta = cand[rows, arg, cols[None, :]] + logB[:, t]
    path = np.empty((S, T), dtype=np.int64)
    path[:, T - 1] = delta.argmax(axis=1)
    best = delta[np.arange(S), path[:, T - 1]]
    for t in range(T - 1, 0, -1):
        path[:, t - 1] = back[np.arange(S), t, path[:, t]]
    return path, best


def e_step(logB: np.ndarray, startprob: np.ndarray, transmat: np.ndarray, valid: np.ndarray | None = None):
    """Log-likelihood, posteriors ``(S,T,K)`` and summed pairwise posteriors ``(S,K,K)``.

    ``valid (S, T)`` marks real steps when sequences of different lengths are
    padded: padded steps get density 1 for every state (no effect on the
    likelihood) and are left out of the posterior sums.
    """
    if valid is not None:
        logB = np.where(valid[:, :, None], logB, 0.0)
    loglik, gamma, xi = forward_backward_blocked(logB, startprob, transmat, valid)
    if valid is not None:
        gamma = gamma * valid[:, :, None]
    return loglik, gamma, xi


def _floor_covars(cov: np.ndarray, min_covar: float, cov_type: str) -> np.ndarray:
    """Apply ``min_covar`` only where a variance (or the smallest eigenvalue) falls below it."""
    if cov_type == "diag":
        return np.maximum(cov, min_covar)
    cov = 0.5 * (cov + np.swapaxes(cov, -1, -2))
    low = np.zeros(cov.shape[:-2], dtype=bool)
    whole = np.isfinite(cov).all(axis=(-2, -1))  # a broken one is left for the caller to reject
    low[whole] = np.linalg.eigvalsh(cov[whole])[..., 0] < min_covar
    if np.any(low):
        cov = cov.copy()
        cov[low] += min_covar * np.eye(cov.shape[-1])
    return cov


def usable(covars: np.ndarray, cov_type: str) -> np.ndarray:
    """Which models have finite, positive definite covariances in all states."""
    rest = tuple(range(1, covars.ndim))
    good = np.isfinite(covars).all(axis=rest)
    if cov_type == "diag":
        return good & (covars > 0).all(axis=rest)
    try:
        np.linalg.cholesky(covars[good])
        return good
    except np.linalg.LinAlgError:
        for i in np.flatnonzero(good):  # find the ones to blame
            try:
                np.linalg.cholesky(covars[i])
            except np.linalg.LinAlgError:
                good[i] = False
        return good


def usage_entropy(p: np.ndarray) -> float:
    """Shannon entropy of a state-usage distribution (natural log, 1e-10 inside it)."""
    return float(-np.sum(p * np.log(p + 1e-10)))


def em_fit(
    X: np.ndarray,
    startprob: np.ndarray,
    transmat: np.ndarray,
    means: np.ndarray,
    covars: np.ndarray,
    max_iter: int = 100,
    tol: float = 1e-4,
    min_covar: float = 1e-3,
    cov_type: str = "full",
    params: str = "stmc",
    lengths: np.ndarray | None = None,
):
    """M5: Baum-Welch for S models at once.

    ``X`` is one sequence shared by all models ``(T, D)`` (restarts) or one
    padded sequence per model ``(S, T, D)`` with true ``lengths (S,)``.

    Each restart stops on its own when the log-likelihood gain falls below
    ``tol``.  A restart whose numbers break (non-finite likelihood, singular
    covariance) is frozen with status ``failed`` instead of failing the task.
    Returns parameters, final training log-likelihood, iterations, status.
    """
    S = startprob.shape[0]
    per_model = X.ndim == 3
    valid_all = None
    if lengths is not None:
        valid_all = np.arange(X.shape[-2])[None, :] < np.asarray(lengths)[:, None]
    sp, tm, mu, cv = startprob.copy(), transmat.copy(), means.copy(), covars.copy()
    XX = outer_terms(X) if cov_type == "full" else None
    D = X.shape[-1]
    prev = np.full(S, -np.inf)
    loglik = np.full(S, np.nan)
    n_iter = np.zeros(S, dtype=np.int64)
    status = np.array(["running"] * S, dtype=object)
    error = np.array([""] * S, dtype=object)
    for _ in range(max_iter):
        idx = np.flatnonzero(status == "running")
        broken = idx[~usable(cv[idx], cov_type)]
        status[broken] = "failed"
        error[broken] = "covariance is not positive definite"
        idx = np.setdiff1d(idx, broken)
        if idx.size == 0:
            break
        Xi = X[idx] if per_model else X
        XXi = None if XX is None else (XX[idx] if per_model else XX)
        vi = valid_all[idx] if valid_all is not None else None
        if cov_type == "full":
            logB = log_density_gemm(Xi, XXi, mu[idx], cv[idx])
        else:
            logB = log_density(Xi, mu[idx], cv[idx], cov_type)
        ll, gamma_all, xi_all = e_step(logB, sp[idx], tm[idx], vi)
        bad = ~np.isfinite(ll)
        if bad.any():
            status[idx[bad]] = "failed"
            error[idx[bad]] = "non-finite log-likelihood"
        ok = ~bad
        if not ok.any():
            continue
        j = idx[ok]
        gamma, xi = gamma_all[ok], xi_all[ok]
        Xj = Xi[ok] if per_model else X
        XXj = None if XXi is None else (XXi[ok] if per_model else XX)
        w = gamma.sum(axis=1)  # (s, K)
        used = w > 1e-10
        if "s" in params:
            sp[j] = gamma[:, 0]
        if "t" in params:
            rows = xi.sum(axis=2, keepdims=True)
            tm[j] = np.where(rows > 0, xi / np.maximum(rows, TINY), tm[j])
        if "m" in params or "c" in params:
            gT = np.swapaxes(gamma, 1, 2)  # (s, K, T)
            new_mu = np.matmul(gT, Xj) / np.maximum(w, TINY)[..., None]
            new_mu = np.where(used[..., None], new_mu, mu[j])
            if "c" in params:
                wk = np.maximum(w, TINY)
                if cov_type == "diag":
                    diff = (Xj[:, None, :, :] if per_model else X[None, None, :, :]) - new_mu[:, :, None, :]
                    cov = np.sum(gT[..., None] * diff * diff, axis=2) / wk[..., None]
                    cov = np.where(used[..., None], cov, cv[j])
                else:
                    # sum_t g x x^T / w - mu mu^T, one matrix product over time
                    sxx = np.matmul(gT, XXj).reshape(*gT.shape[:2], D, D) / wk[..., None, None]
                    cov = sxx - new_mu[..., :, None] * new_mu[..., None, :]
                    cov = np.where(used[..., None, None], cov, cv[j])
                cv[j] = _floor_covars(cov, min_covar, cov_type)
            if "m" in params:
                mu[j] = new_mu
        cur = ll[ok]
        n_iter[j] += 1
        loglik[j] = cur
        done = (cur - prev[j]) < tol
        prev[j] = cur
        status[j[done]] = "converged"
    status[status == "running"] = "max_iter"
    return sp, tm, mu, cv, loglik, n_iter, status, error


def forward_backward_blocked(logB: np.ndarray, startprob: np.ndarray, transmat: np.ndarray, valid: np.ndarray | None = None):
    """E-step in about 6*sqrt(T) vectorised steps instead of 2*T.

    The T-1 transitions are cut into ``nb`` blocks of ``L`` steps (padded with
    identity steps).  (1) all blocks build their transfer matrix
    ``P_j = prod_i A diag(b_i)`` at once; (2) a pass over the ``nb`` blocks
    carries the normalised forward vector across block boundaries; (3) all
    blocks replay their steps at once from their start vectors.  The backward
    pass reuses ``P_j`` the same way.  Posteriors and pairwise posteriors are
    normalised per step, so a constant factor per block in the backward
    vectors cannot bias them.

    Returns ``loglik (S,)``, ``gamma (S,T,K)``, ``xi_sum (S,K,K)``.
    """
    S, T, K = logB.shape
    B, shift = _shifted(logB)
    a0 = startprob * B[:, 0]
    c0 = np.maximum(a0.sum(axis=1), TINY)
    a0 = a0 / c0[:, None]
    n = T - 1
    if n == 0:
        return np.log(c0) + shift.sum(axis=1), a0[:, None, :].copy(), np.zeros((S, K, K))
    L = max(1, int(np.ceil(np.sqrt(n))))
    nb = int(np.ceil(n / L))
    pad = nb * L - n
    M = transmat[:, None, :, :] * B[:, 1:, None, :]  # (S, n, K, K): A_ij b_t(j)
    if pad:
        eye = np.broadcast_to(np.eye(K), (S, pad, K, K))
        M = np.concatenate([M, eye], axis=1)
    M = M.reshape(S, nb, L, K, K)
    # (1) block transfer matrices, normalised by their largest entry
    P = np.broadcast_to(np.eye(K), (S, nb, K, K)).copy()
    for i in range(L):
        P = np.matmul(P, M[:, :, i])
        m = np.maximum(P.max(axis=(-2, -1)), TINY)
        P /= m[..., None, None]
    # (2) forward vectors at block starts
    starts = np.empty((S, nb, K))
    v = a0
    for j in range(nb):
        starts[:, j] = v
        u = np.matmul(v[:, None, :], P[:, j])[:, 0, :]
        v = u / np.maximum(u.sum(axis=1), TINY)[:, None]
    # (3) replay inside all blocks at once
    alpha = np.empty((S, nb, L, K))
    scale = np.empty((S, nb, L))
    a = starts
    for i in range(L):
        u = np.matmul(a[:, :, None, :], M[:, :, i])[:, :, 0, :]
        c = np.maximum(u.sum(axis=-1), TINY)
        a = u / c[..., None]
        alpha[:, :, i] = a
        scale[:, :, i] = c
    loglik = np.log(c0) + np.log(scale).sum(axis=(1, 2)) + shift.sum(axis=1)
    # backward: vectors at block ends, then replay (each block's end vector up to a constant)
    ends = np.empty((S, nb, K))
    w = np.ones((S, K))
    for j in range(nb - 1, -1, -1):
        ends[:, j] = w
        w = np.matmul(P[:, j], w[:, :, None])[:, :, 0]
        w = w / np.maximum(w.max(axis=1), TINY)[:, None]
    beta = np.empty((S, nb, L, K))
    b = ends
    for i in range(L - 1, -1, -1):
        beta[:, :, i] = b
        b = np.matmul(M[:, :, i], b[..., None])[..., 0] / scale[:, :, i, None]
        b = b / np.maximum(b.max(axis=-1), TINY)[..., None]
    beta0 = b[:, 0]
    alpha = np.concatenate([a0[:, None, :], alpha.reshape(S, nb * L, K)[:, :n]], axis=1)
    beta = np.concatenate([beta0[:, None, :], beta.reshape(S, nb * L, K)[:, :n]], axis=1)
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(axis=2, keepdims=True), TINY)
    Mt = M.reshape(S, nb * L, K, K)[:, :n]
    xi = alpha[:, :-1, :, None] * Mt * beta[:, 1:, None, :]
    xi /= np.maximum(xi.sum(axis=(-2, -1), keepdims=True), TINY)
    if valid is not None:
        xi *= valid[:, 1:, None, None]
    return loglik, gamma, xi.sum(axis=1)
