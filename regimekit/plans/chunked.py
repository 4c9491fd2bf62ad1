"""Decode of sequences of any length across many tasks (time chunks).

A sequence is cut into chunks of ``chunk_len`` steps.

1. Per chunk, in parallel: the forward transfer matrix
   ``P_c = prod_t A diag(b_t)`` (normalised, with its log scale) and the
   Viterbi max-plus matrix ``V_c[i, j]`` = best log score of a path entering the
   chunk from state ``i`` and ending in ``j``.  The first chunk starts from the
   start probabilities instead.
2. Per sequence, over the chunk summaries only (``n / chunk_len`` small rows):
   forward vectors at chunk starts, backward vectors at chunk ends, the
   log-likelihood, and the Viterbi states at chunk boundaries (max-plus
   products, then a backtrack over chunks).
3. Per chunk, in parallel: replay forward/backward from the boundary vectors
   (posteriors normalised per step) and run Viterbi inside the chunk from the
   boundary entry state, backtracking from the boundary end state.

No task ever holds more than one chunk of one sequence.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimekit.plans import hmm_kernels as K
from regimekit.plans.hmm import _key_ddl, _model_arrays, sequence_stats, task_partitions
from regimekit.session import ship_package

TINY = 1e-300


def _model(row: pd.Series):
    sp, tm, mu, cv = _model_arrays(row)
    return sp[0], tm[0], mu, cv


def _log(x):
    with np.errstate(divide="ignore"):
        return np.log(x)


def _summarise(keys: list[str]):
    """Stage 1: transfer matrices of one chunk."""

    def run(seq_pdf: pd.DataFrame, model_pdf: pd.DataFrame) -> pd.DataFrame:
        if seq_pdf.empty or model_pdf.empty:
            return pd.DataFrame(columns=[*keys, "c"])
        seq_pdf = seq_pdf.sort_values("t")
        X = np.stack(seq_pdf["x"].to_numpy()).astype(float)
        sp, tm, mu, cv = _model(model_pdf.iloc[0])
        logB = K.log_density(X, mu, cv)[0]  # (L, K)
        k = len(sp)
        log_a = _log(tm)
        first = int(seq_pdf["t"].iloc[0]) == 1
        shift = logB.max(axis=1)
        B = np.exp(logB - shift[:, None])
        start = 1 if first else 0
        P = np.eye(k)
        plog = 0.0
        for i in range(start, len(X)):
            P = (P @ tm) * B[i][None, :]
            m = max(P.max(), TINY)
            P /= m
            plog += np.log(m) + shift[i]
        if first:
            h = sp * B[0]
            hs = max(h.sum(), TINY)
            head, head_log = h / hs, float(np.log(hs) + shift[0])
            v = _log(sp) + logB[0]
            for i in range(1, len(X)):
                v = (v[:, None] + log_a).max(axis=0) + logB[i]
            V = np.tile(v, (k, 1))  # rows identical: the entry state does not matter for the first chunk
        else:
            head, head_log = np.zeros(k), 0.0
            V = log_a + logB[0][None, :]
            for i in range(1, len(X)):
                V = (V[:, :, None] + log_a[None, :, :]).max(axis=1) + logB[i][None, :]
        out = pd.DataFrame(
            {
                "c": [int(seq_pdf["c"].iloc[0])],
                "first": [first],
                "P": [P.ravel().tolist()],
                "plog": [float(plog)],
                "V": [V.ravel().tolist()],
                "head": [head.tolist()],
                "head_log": [head_log],
            }
        )
        for key in reversed(keys):
            out.insert(0, key, seq_pdf[key].iloc[0])
        return out

    return run


def _boundaries(keys: list[str]):
    """Stage 2: carry forward/backward/Viterbi information across the chunks of one sequence."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c").reset_index(drop=True)
        k = len(pdf["head"].iloc[0])
        n = len(pdf)
        P = [np.asarray(p, dtype=float).reshape(k, k) for p in pdf["P"]]
        V = [np.asarray(v, dtype=float).reshape(k, k) for v in pdf["V"]]
        entry_alpha = np.empty((n, k))
        a = np.asarray(pdf["head"].iloc[0], dtype=float)
        ll = float(pdf["head_log"].iloc[0])
        for c in range(n):
            entry_alpha[c] = a
            u = a @ P[c]
            s = max(u.sum(), TINY)
            ll += float(np.log(s) + pdf["plog"].iloc[c])
            a = u / s
        beta_end = np.empty((n, k))
        b = np.ones(k)
        for c in range(n - 1, -1, -1):
            beta_end[c] = b
            b = P[c] @ b
            b = b / max(b.max(), TINY)
        d_end = np.empty((n, k))
        d = V[0][0]
        d_end[0] = d
        for c in range(1, n):
            d = (d[:, None] + V[c]).max(axis=0)
            d_end[c] = d
        end_state = np.empty(n, dtype=np.int64)
        entry_state = np.full(n, -1, dtype=np.int64)
        end_state[n - 1] = int(np.argmax(d_end[n - 1]))
        for c in range(n - 1, 0, -1):
            i = int(np.argmax(d_end[c - 1] + V[c][:, end_state[c]]))
            entry_state[c] = i
            end_state[c - 1] = i
        out = pd.DataFrame(
            {
                "c": pdf["c"].to_numpy().astype(np.int32),
                "entry_alpha": list(entry_alpha.tolist()),
                "beta_end": list(beta_end.tolist()),
                "entry_state": entry_state.astype(np.int32),
                "end_state": end_state.astype(np.int32),
                "loglik": np.full(n, ll),
            }
        )
        for key in reversed(keys):
            out.insert(0, key, pdf[key].iloc[0])
        return out

    return run


def _replay(keys: list[str], with_posterior: bool):
    """Stage 3: per-step posteriors and Viterbi states of one chunk."""

    def run(seq_pdf: pd.DataFrame, b_pdf: pd.DataFrame) -> pd.DataFrame:
        if seq_pdf.empty or b_pdf.empty:
            return pd.DataFrame(columns=[*keys, "ts", "t", "raw_state", "posterior", "loglik"])
        seq_pdf = seq_pdf.sort_values("t")
        row = b_pdf.iloc[0]
        X = np.stack(seq_pdf["x"].to_numpy()).astype(float)
        sp, tm, mu, cv = _model(row)
        logB = K.log_density(X, mu, cv)[0]
        L, k = logB.shape
        log_a = _log(tm)
        B = np.exp(logB - logB.max(axis=1, keepdims=True))
        first = int(seq_pdf["t"].iloc[0]) == 1
        alpha = np.empty((L, k))
        a = np.asarray(row["entry_alpha"], dtype=float)
        for i in range(L):
            if first and i == 0:
                alpha[0] = a  # the head vector is already the forward vector of step 0
                continue
            u = (a @ tm) * B[i]
            a = u / max(u.sum(), TINY)
            alpha[i] = a
        beta = np.empty((L, k))
        b = np.asarray(row["beta_end"], dtype=float)
        beta[L - 1] = b
        for i in range(L - 1, 0, -1):
            b = tm @ (B[i] * b)
            b = b / max(b.max(), TINY)
            beta[i - 1] = b
        gamma = alpha * beta
        gamma /= np.maximum(gamma.sum(axis=1, keepdims=True), TINY)
        delta = _log(sp) + logB[0] if first else log_a[int(row["entry_state"])] + logB[0]
        back = np.zeros((L, k), dtype=np.int64)
        for i in range(1, L):
            cand = delta[:, None] + log_a
            back[i] = cand.argmax(axis=0)
            delta = cand[back[i], np.arange(k)] + logB[i]
        path = np.empty(L, dtype=np.int64)
        path[L - 1] = int(row["end_state"])
        for i in range(L - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        out = pd.DataFrame(
            {
                "ts": seq_pdf["ts"].to_numpy(),
                "t": seq_pdf["t"].to_numpy().astype(np.int32),
                "raw_state": path.astype(np.int32),
                "posterior": list(gamma.tolist()) if with_posterior else [None] * L,
                "loglik": np.full(L, float(row["loglik"])),
            }
        )
        for key in reversed(keys):
            out.insert(0, key, seq_pdf[key].iloc[0])
        return out

    return run


def decode_chunked(seq: DataFrame, models: DataFrame, keys: list[str] = ("entity",), chunk_len: int = 10_000, with_posterior: bool = True) -> DataFrame:
    """``keys, ts, t, raw_state, posterior, loglik`` of every step; a null posterior without ``with_posterior``."""
    keys = list(keys)
    spark = seq.sparkSession
    ship_package(spark)
    params = ["startprob", "transmat", "means", "covars"]
    seq_c = seq.select(*keys, "ts", "t", "x").withColumn("c", ((F.col("t") - 1) / F.lit(chunk_len)).cast("int"))
    n_seq, max_n, _ = sequence_stats(seq, keys)
    parts = task_partitions(spark, max(1, n_seq * -(-max_n // chunk_len)))
    chunks = seq.select(*keys, "n").distinct().select(
        *keys, F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / F.lit(chunk_len)).cast("int"))).alias("c")
    )
    m = models.select(*keys, *params)
    m_c = chunks.join(m, keys)  # one model row per chunk: #sequences x #chunks rows
    gk = [*keys, "c"]
    s_side = seq_c.toDF(*seq_c.columns).repartition(parts, *gk)
    m_side = m_c.toDF(*m_c.columns).repartition(parts, *gk)
    summary_schema = (
        f"{_key_ddl(keys, seq)}, c INT, first BOOLEAN, P ARRAY<DOUBLE>, plog DOUBLE, V ARRAY<DOUBLE>, "
        "head ARRAY<DOUBLE>, head_log DOUBLE"
    )
    summaries = s_side.groupBy(*gk).cogroup(m_side.groupBy(*gk)).applyInPandas(_summarise(keys), summary_schema)
    bound_schema = (
        f"{_key_ddl(keys, seq)}, c INT, entry_alpha ARRAY<DOUBLE>, beta_end ARRAY<DOUBLE>, entry_state INT, "
        "end_state INT, loglik DOUBLE"
    )
    bounds = summaries.groupBy(*keys).applyInPandas(_boundaries(keys), bound_schema)
    b_m = bounds.join(m, keys)
    b_side = b_m.toDF(*b_m.columns).repartition(parts, *gk)
    s_side2 = seq_c.toDF(*seq_c.columns).repartition(parts, *gk)
    out_schema = f"{_key_ddl(keys, seq)}, ts TIMESTAMP_NTZ, t INT, raw_state INT, posterior ARRAY<DOUBLE>, loglik DOUBLE"
    return s_side2.groupBy(*gk).cogroup(b_side.groupBy(*gk)).applyInPandas(_replay(keys, with_posterior), out_schema)
