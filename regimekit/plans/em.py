"""EM as Spark stages: every round is a pass over time chunks, a sum per model and one small update per model.

1. Per (chunk, model): the forward transfer matrix of the chunk.
2. Per model, over its chunk summaries only: the forward vector entering and the backward vector
   leaving each chunk, and the log-likelihood.
3. Per (chunk, model): the sufficient statistics of the chunk's steps.
4. ``groupBy(model).agg(sum)`` of the statistics over all chunks.
5. Per model: new parameters from its statistics.

No task holds more than one chunk of a sequence and the models fitted to it, so the length of a sequence
does not matter; each round's models are a stage table, so a lost executor costs one round at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimekit.params import FitParams
from regimekit.plans import hmm_kernels as K
from regimekit.plans.hmm import PARAM_DDL, _key_ddl, _stack, numbered, task_partitions, train_rows
from regimekit.session import cut_lineage, ship_package

TINY = K.TINY
PARAMS = ["startprob", "transmat", "means", "covars"]


def training_chunks(seq: DataFrame, keys: list[str], chunk_len: int) -> tuple[DataFrame, DataFrame]:
    """Centred training steps as ``keys, c, n_chunks, xs`` (one row a chunk), and ``keys, centre``."""
    rows = train_rows(seq).select(*keys, "t", "x")
    rows = numbered(rows, keys, ((F.col("t") - 1) / F.lit(chunk_len)).cast("int"), [F.col("t")], "tt", "n")
    mean = rows.select(*keys, F.posexplode("x").alias("d", "v")).groupBy(*keys, "d").agg(F.avg("v").alias("m"))
    centre = cut_lineage(mean.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("s")).select(*keys, F.transform("s", lambda e: e["m"]).alias("centre")), "em-centre")
    x = F.zip_with("x", "centre", lambda a, b: a - b)
    step = rows.join(centre, keys).select(*keys, "n", "tt", ((F.col("tt") - 1) / F.lit(chunk_len)).cast("int").alias("c"), x.alias("x"))
    chunks = step.groupBy(*keys, "c", "n").agg(F.array_sort(F.collect_list(F.struct("tt", "x"))).alias("s"))
    n_chunks = (F.floor((F.col("n") - 1) / F.lit(chunk_len)) + 1).cast("int")
    return cut_lineage(chunks.select(*keys, "c", n_chunks.alias("n_chunks"), F.transform("s", lambda e: e["x"]).alias("xs")), "em-chunks"), centre


def _models(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    cv = np.stack([np.stack([np.stack(list(m)) for m in c]) for c in pdf["covars"]]).astype(float)
    return _stack(pdf["startprob"]), _stack(pdf["transmat"]), _stack(pdf["means"]), cv


def _densities(xs, mu: np.ndarray, cv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.stack(list(xs)).astype(float)
    return x, *K._shifted(K.log_density_gemm(x, K.outer_terms(x), mu, cv))


def _with_keys(keys: list[str], pdf: pd.DataFrame, cols: dict) -> pd.DataFrame:
    out = pdf[[*keys, "k", "seed"]].reset_index(drop=True)
    return out.assign(**cols)


def _per_k(keys: list[str], fn):
    """``fn(chunk, models)`` for the models of each number of states, which stack to one array."""

    def run(chunk: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if chunk.empty or pdf.empty:
            return pd.DataFrame(columns=[*keys, "k", "seed"])
        return pd.concat([fn(chunk, g) for _, g in pdf.groupby("k")], ignore_index=True)

    return run


def _transfer(keys: list[str]):
    def run(chunk: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        sp, tm, mu, cv = _models(pdf)
        with np.errstate(all="ignore"):
            _, b, shift = _densities(chunk["xs"].iloc[0], mu, cv)
            first = int(chunk["c"].iloc[0]) == 0
            p = np.broadcast_to(np.eye(tm.shape[1]), tm.shape).copy()
            log = np.zeros(len(tm))
            head = sp * b[:, 0] if first else np.zeros_like(sp)
            for i in range(1 if first else 0, b.shape[1]):
                p = np.matmul(p, tm) * b[:, i][:, None, :]
                m = np.maximum(p.max(axis=(1, 2)), TINY)
                p /= m[:, None, None]
                log += np.log(m) + shift[:, i]
        return _with_keys(keys, pdf, {"c": int(chunk["c"].iloc[0]), "p": list(p.reshape(len(p), -1).tolist()), "plog": log, "head": list(head.tolist()), "head_log": shift[:, 0] if first else 0.0})

    return _per_k(keys, run)


def _bounds(keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c").reset_index(drop=True)
        k = int(pdf["k"].iloc[0])
        ps = [np.asarray(p, dtype=float).reshape(k, k) for p in pdf["p"]]
        with np.errstate(all="ignore"):
            a = np.asarray(pdf["head"].iloc[0], dtype=float)
            s = a.sum()
            a, ll, entry = a / max(s, TINY), np.log(s) + pdf["head_log"].iloc[0], []
            for p, plog in zip(ps, pdf["plog"]):
                entry.append(a.tolist())
                u = a @ p
                s = u.sum()
                a, ll = u / max(s, TINY), ll + np.log(s) + plog
            b, leave = np.ones(k), []
            for p in reversed(ps):
                leave.append(b.tolist())
                b = p @ b
                b = b / max(b.max(), TINY)
        return _with_keys(keys, pdf, {"c": pdf["c"], "entry": entry, "leave": leave[::-1], "loglik": float(ll)})

    return run


def _statistics(keys: list[str]):
    def run(chunk: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        sp, tm, mu, cv = _models(pdf)
        with np.errstate(all="ignore"):
            x, b, _ = _densities(chunk["xs"].iloc[0], mu, cv)
            n, steps, k = b.shape
            first = int(chunk["c"].iloc[0]) == 0
            alpha, beta = np.empty((n, steps, k)), np.empty((n, steps, k))
            entry = _stack(pdf["entry"])
            a = entry
            for i in range(steps):
                if i or not first:
                    a = np.einsum("si,sij->sj", a, tm) * b[:, i]
                    a = a / np.maximum(a.sum(axis=1), TINY)[:, None]
                alpha[:, i] = a
            back = _stack(pdf["leave"])
            for i in range(steps - 1, -1, -1):
                beta[:, i] = back
                back = np.einsum("sij,sj->si", tm, b[:, i] * back)
                back = back / np.maximum(back.max(axis=1), TINY)[:, None]
            gamma = alpha * beta
            gamma /= np.maximum(gamma.sum(axis=2, keepdims=True), TINY)
            before = np.concatenate([entry[:, None], alpha[:, :-1]], axis=1)[:, 1 if first else 0 :]
            pair = before[..., :, None] * tm[:, None] * (b * beta)[:, 1 if first else 0 :, None, :]
            pair /= np.maximum(pair.sum(axis=(2, 3), keepdims=True), TINY)
            g = np.swapaxes(gamma, 1, 2)
            parts = [gamma[:, 0] if first else np.zeros((n, k)), pair.sum(axis=1), gamma.sum(axis=1), np.matmul(g, x), np.matmul(g, K.outer_terms(x))]
        flat = np.concatenate([p.reshape(n, -1) for p in parts], axis=1)
        return _with_keys(keys, pdf, {"s": list(flat.tolist())})

    return _per_k(keys, run)


def _update(fit: FitParams):
    """New parameters of each model from its summed statistics ``s`` and log-likelihood."""

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                k, old = int(r["k"]), {p: np.array([np.array([np.array(x) for x in y]) if p == "covars" else np.array(y) for y in r[p]], dtype=float) for p in PARAMS}
                ll, s = r["loglik"], r["s"]
                if s is None or ll is None or not np.isfinite(ll):
                    rows.append(r | {"status": "failed", "error": r["error"] or "non-finite log-likelihood"})
                    continue
                s = np.asarray(s, dtype=float)
                d = old["means"].shape[1]
                g0, xi, w, sx, sxx = np.split(s, np.cumsum([k, k * k, k, k * d]))
                xi, sx, sxx = xi.reshape(k, k), sx.reshape(k, d), sxx.reshape(k, d, d)
                used, wk = w > 1e-10, np.maximum(w, TINY)[:, None]
                new = dict(old)
                if "s" in fit.init_params:
                    new["startprob"] = g0
                if "t" in fit.init_params:
                    total = xi.sum(axis=1, keepdims=True)
                    new["transmat"] = np.where(total > 0, xi / np.maximum(total, TINY), old["transmat"])
                mean = np.where(used[:, None], sx / wk, old["means"])
                if "c" in fit.init_params:
                    cov = np.where(used[:, None, None], sxx / wk[..., None] - mean[:, :, None] * mean[:, None, :], old["covars"])
                    new["covars"] = K._floor_covars(cov, fit.min_covar, "full")
                if "m" in fit.init_params:
                    new["means"] = mean
                gain = ll - r["prev"] if r["prev"] is not None else np.inf
                rows.append(r | {p: new[p].tolist() for p in PARAMS} | {"prev": ll, "n_iter": r["n_iter"] + 1, "status": "converged" if gain < fit.tol else "running"})
            yield pd.DataFrame(rows, columns=list(pdf.columns)).drop(columns=["s", "loglik"])

    return run


def _usable(frames):
    """Mark models whose covariances are not positive definite as failed."""
    for pdf in frames:
        ok = [bool(K.usable(np.stack([np.stack(list(m)) for m in c]).astype(float)[None], "full")[0]) for c in pdf["covars"]]
        bad = ~np.array(ok, dtype=bool)
        pdf.loc[bad, "status"] = "failed"
        pdf.loc[bad, "error"] = "covariance is not positive definite"
        yield pdf


def em_round(models: DataFrame, chunks: DataFrame, fit: FitParams, keys: list[str]) -> DataFrame:
    """One round for all running models; the others pass unchanged."""
    key_ddl = _key_ddl(keys, models)
    ddl = f"{key_ddl}, k INT, seed INT, {PARAM_DDL}, prev DOUBLE, n_iter INT, status STRING, error STRING"
    running = models.where("status = 'running'").mapInPandas(_usable, ddl)
    running = cut_lineage(running, "em-running")
    active = running.where("status = 'running'").select(*keys, "k", "seed", *PARAMS)
    ids = chunks.select(*keys, "c").distinct()
    each = active.join(ids, keys)
    parts = task_partitions(models.sparkSession, max(1, ids.count()))
    at = [*keys, "c"]

    def over_chunks(rows: DataFrame, fn, schema: str) -> DataFrame:
        left, right = chunks.toDF(*chunks.columns).repartition(parts, *at), rows.toDF(*rows.columns).repartition(parts, *at)
        return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(fn, schema)

    summaries = over_chunks(each, _transfer(keys), f"{key_ddl}, k INT, seed INT, c INT, p ARRAY<DOUBLE>, plog DOUBLE, head ARRAY<DOUBLE>, head_log DOUBLE")
    bounds = summaries.groupBy(*keys, "k", "seed").applyInPandas(_bounds(keys), f"{key_ddl}, k INT, seed INT, c INT, entry ARRAY<DOUBLE>, leave ARRAY<DOUBLE>, loglik DOUBLE")
    bounds = cut_lineage(bounds, "em-bounds")
    model = [*keys, "k", "seed"]
    stats = over_chunks(each.join(bounds.drop("loglik"), [*model, "c"]), _statistics(keys), f"{key_ddl}, k INT, seed INT, s ARRAY<DOUBLE>")
    sums = stats.select(*model, F.posexplode("s").alias("i", "v")).groupBy(*model, "i").agg(F.sum("v").alias("v"))
    sums = sums.groupBy(*model).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).select(*model, F.transform("s", lambda e: e["v"]).alias("s"))
    loglik = bounds.groupBy(*model).agg(F.max("loglik").alias("loglik"))
    known = running.join(sums, model, "left").join(loglik, model, "left")
    updated = known.where("status = 'running'").mapInPandas(_update(fit), ddl)
    return updated.unionByName(running.where("status != 'running'")).unionByName(models.where("status != 'running'"))


def em_stages(seq: DataFrame, init: DataFrame, fit: FitParams, keys: list[str] = ("entity",), chunk_len: int = 10_000) -> DataFrame:
    """M5 for all models of ``init`` at once, ``fit.max_iter`` rounds at most.

    ``keys, k, seed, startprob, transmat, means, covars, train_loglik, n_iter, status, error``; the same update, stop
    and failure rules as ``hmm_kernels.em_fit``.
    """
    keys = list(keys)
    ship_package(seq.sparkSession)
    chunks, centre = training_chunks(seq, keys, chunk_len)

    def moved(models: DataFrame, sign: float) -> DataFrame:
        shifted = F.transform("means", lambda m: F.zip_with(m, F.col("centre"), lambda a, b: a + F.lit(sign) * b))
        return models.join(centre, keys).withColumn("means", shifted).drop("centre")

    start = moved(init.select(*keys, F.col("k").cast("int"), F.col("seed").cast("int"), *PARAMS), -1.0)
    models = start.select("*", F.lit(None).cast("double").alias("prev"), F.lit(0).alias("n_iter"), F.lit("running").alias("status"), F.lit("").alias("error"))
    models = cut_lineage(models, "em-models")
    for _ in range(fit.max_iter):
        if models.where("status = 'running'").limit(1).count() == 0:
            break
        models = cut_lineage(em_round(models, chunks, fit, keys), "em-models")
    done = moved(models, 1.0).withColumnRenamed("prev", "train_loglik")
    return done.withColumn("status", F.when(F.col("status") == "running", "max_iter").otherwise(F.col("status")))


def fit_stages(seq: DataFrame, init: DataFrame, fit: FitParams, keys: list[str]) -> DataFrame:
    """M7 by stages: EM for all models, then score and state usage on the validation steps, chunk by chunk."""
    from regimekit.plans.chunked import decode_chunked

    if fit.covariance_type != "full":
        raise ValueError("engine 'stages' fits full covariances")
    fitted = em_stages(seq, cut_lineage(init, "em-init"), fit, keys, fit.chunk_len)
    model = [*keys, "k", "seed"]
    held = seq.where(F.col("split").isin("validate", "all")).select(*keys, "ts", "t", "x")
    held = numbered(held, keys, ((F.col("t") - 1) / F.lit(fit.chunk_len)).cast("int"), [F.col("t")], "v", "n").drop("t").withColumnRenamed("v", "t")
    good = fitted.where("status != 'failed'").select(*model, *PARAMS)
    each = held.join(good.select(*model), keys)
    path = cut_lineage(decode_chunked(each, good, model, fit.chunk_len, with_posterior=False), "em-held-out")
    counts = path.groupBy(*model, "raw_state").agg(F.count("*").alias("c"), F.max("loglik").alias("ll"))
    total = counts.groupBy(*model).agg(F.max("ll").alias("val_loglik"), F.sum("c").cast("int").alias("n_val"))
    p = F.col("c") / F.col("n_val")
    entropy = counts.join(total, model).groupBy(*model).agg(F.sum(-p * F.log(p + F.lit(1e-10))).alias("val_entropy"))
    scored = fitted.join(total, model, "left").join(entropy, model, "left")
    return scored.select(
        *model,
        F.size(F.col("means")[0]).alias("d"),
        *PARAMS,
        F.lit(fit.covariance_type).alias("cov_type"),
        "train_loglik",
        "n_iter",
        "status",
        "error",
        "val_loglik",
        F.coalesce("n_val", F.lit(0)).alias("n_val"),
        "val_entropy",
    )
