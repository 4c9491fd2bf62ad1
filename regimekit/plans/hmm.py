"""Gaussian HMM on Spark: sequences, init, grid fit, selection, decode, relabel, transitions.

Data layout
-----------
``seq``    keys..., ts, t INT (1-based), n INT, x ARRAY<DOUBLE>, split STRING
``init``   keys..., k, seed, chunk, startprob, transmat, means, covars
``fits``   keys..., k, seed, d, parameters, train_loglik, n_iter, status, error,
           val_loglik, n_val, val_entropy, score
``states`` keys..., ts, t, raw_state INT, posterior ARRAY<DOUBLE>

``keys`` identifies one sequence: ``["entity"]`` for plain models,
``["entity", "top_state"]`` for hierarchical sub-models.  Every grouped step
is keyed by the sequence, so its size is one entity's calendar (one row per
period), never the raw data volume.  The fit grid replicates a sequence once
per (K, chunk of seeds), not once per seed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regimekit.functions.scalar import expected_steps as expected_run
from regimekit.plans import hmm_kernels as K
from regimekit.params import FitParams
from regimekit.session import cut_lineage, ship_package

PARAM_DDL = (
    "startprob ARRAY<DOUBLE>, transmat ARRAY<ARRAY<DOUBLE>>, "
    "means ARRAY<ARRAY<DOUBLE>>, covars ARRAY<ARRAY<ARRAY<DOUBLE>>>"
)

# Fixed constants of the deterministic restart perturbation (M6); portable to SQL.
PERTURB_MOD = 10007
PERTURB_SEED, PERTURB_STATE, PERTURB_DIM, PERTURB_K = 7919, 104729, 1299709, 15485863
PERTURB_SCALE = 0.5
STICKY = 0.9


def _key_ddl(keys: list[str], df: DataFrame) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


# ---------------------------------------------------------------- sequences


def sequences(
    features: DataFrame,
    feature_cols: list[str],
    fit: FitParams = FitParams(),
    keys: list[str] = ("entity",),
    x_col: str | None = None,
) -> DataFrame:
    """Order each sequence, number its steps and mark the train/validate split.

    Chronological split keeps the first ``floor(ratio * n)`` steps for training;
    the shuffled split orders by the MD5 of seed and time instead.  ``split='all'`` (used
    by hierarchical sub-models) trains and scores on every step.
    """
    keys = list(keys)
    x = F.col(x_col) if x_col else F.array(*[F.col(c).cast("double") for c in feature_cols])
    seq = features.select(*keys, "ts", x.alias("x"))
    seq = numbered(seq, keys, F.trunc(F.col("ts").cast("date"), "month"), [F.col("ts")], "t", "n")
    n_train = F.floor(F.col("n") * F.lit(float(fit.train_ratio))).cast("int")
    if fit.split == "all":
        split = F.lit("all")
    elif fit.shuffle:
        seq = seq.withColumn("_h", F.md5(F.concat(F.lit(f"{fit.split_seed}:"), F.col("ts").cast("string"))))
        seq = numbered(seq, keys, F.substring("_h", 1, 2), [F.col("_h"), F.col("ts")], "_rank").drop("_h")
        split = F.when(F.col("_rank") <= n_train, "train").otherwise("validate")
    else:
        split = F.when(F.col("t") <= n_train, "train").otherwise("validate")
    return seq.withColumn("split", split).drop("_rank")


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str, total: str | None = None) -> DataFrame:
    """Number the rows of each key 1, 2, … in ``order`` (and add their ``total``), bucket by bucket.

    ``bucket`` is a prefix of the order (a month of the time, the head of a hash).  Rows are numbered inside a
    bucket and shifted by the counts of the key's earlier buckets, so no window holds a whole sequence.
    """
    df = df.withColumn("_b", bucket)
    counts = df.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    all_of_key = Window.partitionBy(*keys)
    shift = counts.select(
        *keys,
        "_b",
        F.coalesce(F.sum("_c").over(all_of_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"),
        F.sum("_c").over(all_of_key).alias("_n"),
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    df = df.withColumn("_r", inside).join(shift, [*keys, "_b"]).withColumn(out, (F.col("_r") + F.col("_s")).cast("int"))
    if total:
        df = df.withColumn(total, F.col("_n"))
    return df.drop("_b", "_r", "_s", "_n")


def length_guard(seq: DataFrame, min_rows: int, keys: list[str] = ("entity",)) -> DataFrame:
    """P5: one row per sequence with its length and whether it is long enough to fit."""
    keys = list(keys)
    return seq.groupBy(*keys).agg(F.count("*").cast("bigint").alias("n_rows")).withColumn(
        "status", F.when(F.col("n_rows") < min_rows, "skipped").otherwise("ok")
    )


def train_rows(seq: DataFrame) -> DataFrame:
    return seq.where(F.col("split").isin("train", "all"))


def sequence_stats(seq: DataFrame, keys: list[str]) -> tuple[int, int, int]:
    """(number of sequences, longest sequence, widest observation): one small aggregate."""
    row = seq.agg(
        F.count_distinct(*[F.col(k) for k in keys]).alias("n_seq"),
        F.max("n").alias("max_n"),
        F.max(F.size("x")).alias("max_d"),
    ).first()
    return int(row["n_seq"] or 0), int(row["max_n"] or 0), int(row["max_d"] or 0)


def task_partitions(spark, n_groups: int) -> int:
    """Partitions for a compute-bound grouped stage: two per group, up to 64 per core, then one per 16 groups.

    The rows feeding model fits are few but each group costs seconds of CPU,
    so the stage must not be coalesced into a handful of tasks (AQE would do
    that from the shuffle size).  An explicit count on both co-grouped sides
    keeps them co-partitioned and is left as is by AQE.
    """
    base = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return int(max(1, min(2 * n_groups, max(64 * base, n_groups // 16))))


# ---------------------------------------------------------------- init (M6)


def init_models(seq: DataFrame, fit: FitParams, keys: list[str] = ("entity",), ks=None, seeds=None) -> DataFrame:
    """Deterministic start parameters per (sequence, K, seed), computed with Spark aggregates.

    Means: quantile ``(j + 0.5) / K`` of each feature over the training steps,
    shifted by ``PERTURB_SCALE * sd * (u - 0.5)`` with ``u`` an arithmetic hash
    of (seed, state, feature, K).  Covariances: diagonal sample variance plus
    ``min_covar``.  Start probabilities uniform, transitions sticky.
    """
    keys = list(keys)
    ks = list(ks) if ks is not None else list(range(fit.min_k, fit.max_k + 1))
    seeds = list(seeds) if seeds is not None else list(range(fit.n_restarts))
    long = train_rows(seq).select(*keys, F.posexplode("x").alias("d", "v"))
    quantiles = [
        F.percentile("v", F.array(*[F.lit((j + 0.5) / k) for j in range(k)])).alias(f"q{k}") for k in ks
    ]
    stats = long.groupBy(*keys, "d").agg(*quantiles, F.var_samp("v").alias("var"))
    grid = F.explode(
        F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("seed")) for k in ks for s in seeds])
    )
    qv = F.coalesce(*[F.when(F.col("k") == k, F.col(f"q{k}")) for k in ks])
    per = stats.select(*keys, "d", "var", *[f"q{k}" for k in ks], grid.alias("g")).select(
        *keys, "d", "var", "g.k", "g.seed", *[f"q{k}" for k in ks]
    )
    per = per.select(
        *keys,
        "d",
        "k",
        "seed",
        "var",
        F.transform(
            qv,
            lambda q, j: q
            + F.lit(PERTURB_SCALE)
            * F.sqrt(F.col("var"))
            * (
                F.pmod(
                    F.col("seed") * PERTURB_SEED + j * PERTURB_STATE + F.col("d") * PERTURB_DIM + F.col("k") * PERTURB_K,
                    F.lit(PERTURB_MOD),
                )
                / F.lit(float(PERTURB_MOD))
                - F.lit(0.5)
            ),
        ).alias("mu_d"),
    )
    agg = per.groupBy(*keys, "k", "seed").agg(
        F.array_sort(F.collect_list(F.struct("d", "mu_d", "var"))).alias("dims")
    )
    D = F.size("dims")
    means = F.transform(
        F.sequence(F.lit(0), F.col("k") - 1),
        lambda j: F.transform(F.col("dims"), lambda e: F.element_at(e["mu_d"], j + 1)),
    )
    cov1 = F.transform(
        F.sequence(F.lit(0), D - 1),
        lambda a: F.transform(
            F.sequence(F.lit(0), D - 1),
            lambda b: F.when(a == b, F.element_at(F.col("dims"), a + 1)["var"] + F.lit(fit.min_covar)).otherwise(
                F.lit(0.0)
            ),
        ),
    )
    covars = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: cov1)
    kk = F.col("k").cast("double")
    startprob = F.transform(F.sequence(F.lit(1), F.col("k")), lambda j: F.lit(1.0) / kk)
    off = F.lit(1.0 - STICKY) / (kk - 1)
    transmat = F.transform(
        F.sequence(F.lit(0), F.col("k") - 1),
        lambda a: F.transform(
            F.sequence(F.lit(0), F.col("k") - 1), lambda b: F.when(a == b, F.lit(STICKY)).otherwise(off)
        ),
    )
    return agg.select(
        *keys,
        F.col("k").cast("int").alias("k"),
        F.col("seed").cast("int").alias("seed"),
        (F.col("seed") / F.lit(fit.seeds_per_task)).cast("int").alias("chunk"),
        startprob.alias("startprob"),
        transmat.alias("transmat"),
        means.alias("means"),
        covars.alias("covars"),
    )


# ---------------------------------------------------------------- fit grid (M5, M7, M8)


def _stack(col) -> np.ndarray:
    return np.stack([np.stack(list(v)) if isinstance(v[0], (list, np.ndarray)) else np.asarray(v) for v in col])


def _to_diag(cov: np.ndarray) -> np.ndarray:
    return np.diagonal(cov, axis1=-2, axis2=-1).copy()


def _fit_group(keys: list[str], fit: FitParams):
    """Arrow task: EM for every seed of one sequence and one (K, seed chunk) cell."""
    cov_type = fit.covariance_type

    def run(seq_pdf: pd.DataFrame, init_pdf: pd.DataFrame) -> pd.DataFrame:
        if seq_pdf.empty or init_pdf.empty:
            return pd.DataFrame(columns=[*keys, "k", "seed"])
        seq_pdf = seq_pdf.sort_values("t")
        X = np.stack(seq_pdf["x"].to_numpy()).astype(float)
        split = seq_pdf["split"].to_numpy()
        train, valid = X[np.isin(split, ["train", "all"])], X[np.isin(split, ["validate", "all"])]
        out = _fit_batch(init_pdf.sort_values("seed"), train, valid, fit, cov_type)
        for pos, key in enumerate(keys):
            out.insert(pos, key, seq_pdf[key].iloc[0])
        return out

    return run


def _fit_batch(init_pdf, train: np.ndarray, valid: np.ndarray, fit: FitParams, cov_type: str) -> pd.DataFrame:
    sp = _stack(init_pdf["startprob"])
    tm = _stack(init_pdf["transmat"])
    mu = _stack(init_pdf["means"])
    cv = np.stack([np.stack([np.stack(list(m)) for m in c]) for c in init_pdf["covars"]])
    if cov_type == "diag":
        cv = _to_diag(cv)
    S, k = sp.shape
    centre = train.mean(axis=0)  # squares are expanded around the data, not around 0
    n_va = len(valid)
    with np.errstate(all="ignore"):
        sp, tm, mu, cv, ll, n_iter, status, error = K.em_fit(
            train - centre, sp, tm, mu - centre, cv, fit.max_iter, fit.tol, fit.min_covar, cov_type, fit.init_params
        )
        val_ll = np.full(S, np.nan)
        entropy = np.full(S, np.nan)
        for g in np.flatnonzero(status != "failed") if n_va else []:
            try:
                logB = K.log_density(valid - centre, mu[g : g + 1], cv[g : g + 1], cov_type)
            except np.linalg.LinAlgError as exc:  # this restart only
                status[g], error[g] = "failed", str(exc)
                continue
            val_ll[g] = K.forward(logB, sp[g : g + 1], tm[g : g + 1])[0][0]
            p = np.bincount(K.viterbi(logB, sp[g : g + 1], tm[g : g + 1])[0][0], minlength=k) / n_va
            entropy[g] = K.usage_entropy(p)
    cv_full = K.full_covars(cv, cov_type)
    return pd.DataFrame(
        {
            "k": np.full(S, k, dtype=np.int32),
            "seed": init_pdf["seed"].to_numpy().astype(np.int32),
            "d": np.full(S, train.shape[1], dtype=np.int32),
            "startprob": list(sp.tolist()),
            "transmat": list(tm.tolist()),
            "means": list((mu + centre).tolist()),
            "covars": list(cv_full.tolist()),
            "cov_type": cov_type,
            "train_loglik": ll,
            "n_iter": n_iter.astype(np.int32),
            "status": status.astype(str),
            "error": error.astype(str),
            "val_loglik": val_ll,
            "n_val": np.full(S, n_va, dtype=np.int32),
            "val_entropy": entropy,
        }
    )


def fit_grid(seq: DataFrame, fit: FitParams = FitParams(), keys: list[str] = ("entity",), ks=None, seeds=None) -> DataFrame:
    """M7: fit every (sequence, K, seed) of the grid.

    ``fit.engine`` says how: one Arrow task per (sequence, K, seed chunk), or all models together in rounds of
    Spark stages over time chunks.  Both give the same rows.

    Sequences shorter than ``fit.min_rows`` are not fitted (P5).  Failed
    restarts stay in the output with ``status = 'failed'`` (M8).
    """
    keys = list(keys)
    ship_package(seq.sparkSession)
    ks = list(ks) if ks is not None else list(range(fit.min_k, fit.max_k + 1))
    seeds = list(seeds) if seeds is not None else list(range(fit.n_restarts))
    seq = seq.where(F.col("n") >= fit.min_rows)
    fit = replace(fit, seeds_per_task=min(fit.seeds_per_task, len(seeds)))
    chunks = sorted({s // fit.seeds_per_task for s in seeds})
    cells = [(k, c) for k in ks for c in chunks]
    init = init_models(seq, fit, keys, ks, seeds)
    if fit.engine == "stages":
        from regimekit.plans.em import fit_stages

        return fit_stages(seq, init, fit, keys)
    if fit.engine != "grouped":
        raise ValueError(f"engine is 'grouped' or 'stages', not {fit.engine!r}")
    return fit_from_init(seq, init, fit, keys, cells=cells)


def fit_from_init(
    seq: DataFrame,
    init: DataFrame,
    fit: FitParams,
    keys: list[str] = ("entity",),
    cells: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """M5: run EM from given start parameters ``init`` (keys, k, seed, chunk, parameters).

    ``cells`` lists the (K, seed chunk) pairs; each sequence is replicated once
    per cell, and one group fits one (sequence, K, chunk).
    """
    keys = list(keys)
    ship_package(seq.sparkSession)
    kc = cells if cells is not None else [
        (r["k"], r["chunk"]) for r in init.select("k", "chunk").distinct().collect()  # a handful of cells
    ]
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("chunk")) for k, c in sorted(kc)]))
    rep = seq.select(*keys, "t", "x", "split", grid.alias("g")).select(*keys, "t", "x", "split", "g.k", "g.chunk")
    schema = (
        f"{_key_ddl(keys, seq)}, k INT, seed INT, d INT, {PARAM_DDL}, cov_type STRING, train_loglik DOUBLE, "
        "n_iter INT, status STRING, error STRING, val_loglik DOUBLE, n_val INT, val_entropy DOUBLE"
    )
    # both sides descend from ``seq``: fresh column identities keep the co-group unambiguous
    rep, init = rep.toDF(*rep.columns).alias("seq_side"), init.toDF(*init.columns).alias("init_side")
    parts = task_partitions(seq.sparkSession, sequence_stats(seq, keys)[0] * len(kc))
    gk = [*keys, "k", "chunk"]
    rep, init = rep.repartition(parts, *gk), init.repartition(parts, *gk)
    return rep.groupBy(*gk).cogroup(init.groupBy(*gk)).applyInPandas(_fit_group(keys, fit), schema)


# ---------------------------------------------------------------- scores (E1-E4) and selection

Metric = Callable[[dict[str, Column]], Column]


def entropy_score(weight: float = 4.0) -> Metric:
    """Normalised validation log-likelihood + weight * entropy of state usage."""
    return lambda c: c["val_loglik"] / c["n_val"] + F.lit(weight) * c["val_entropy"]


def bic(c: dict[str, Column], cov_type: str = "full") -> Column:
    """-2 loglik + p ln(n) (lower is better)."""
    k, d = c["k"].cast("double"), c["d"].cast("double")
    cov = k * d * (d + 1) / 2 if cov_type == "full" else k * d
    p = k * d + cov + k * (k - 1) + (k - 1)
    return F.lit(-2.0) * c["val_loglik"] + p * F.log(c["n_val"].cast("double"))


def neg_bic(c: dict[str, Column]) -> Column:
    """E4 example: selection maximises, so BIC enters negated."""
    return -bic(c)


def with_score(fits: DataFrame, metric: Metric = entropy_score()) -> DataFrame:
    cols = {n: F.col(n) for n in ("val_loglik", "n_val", "val_entropy", "k", "d")}
    return fits.withColumn("score", metric(cols))


def select_best(fits: DataFrame, keys: list[str] = ("entity",)) -> DataFrame:
    """Best restart per sequence: highest score, ties to smaller K then smaller seed; NaN never wins."""
    keys = list(keys)
    ok = fits.where((F.col("status") != "failed") & F.col("score").isNotNull() & ~F.isnan("score"))
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("k").asc(), F.col("seed").asc())
    return ok.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def best_score(best: DataFrame, keys: list[str] = ("entity",)) -> DataFrame:
    """Best score over layers/sub-models per entity."""
    return best.groupBy(*keys).agg(F.max("score").alias("best_score"))


# ---------------------------------------------------------------- decode (M2-M4)


def _model_arrays(row: pd.Series):
    sp = np.asarray(row["startprob"], dtype=float)[None]
    tm = np.stack(list(row["transmat"])).astype(float)[None]
    mu = np.stack(list(row["means"])).astype(float)[None]
    cv = np.stack([np.stack(list(m)) for m in row["covars"]]).astype(float)[None]
    return sp, tm, mu, cv


DECODE_CHUNK = 10_000


def decode(seq: DataFrame, models: DataFrame, keys: list[str] = ("entity",), with_posterior: bool = True) -> DataFrame:
    """M2-M4 on the whole sequence: Viterbi state, posterior and log-likelihood per step.

    Every sequence is decoded over time chunks in separate tasks (``plans/chunked.py``), whatever its length; the
    result is written once as a stage table (it is read several times).
    """
    from regimekit.plans.chunked import decode_chunked

    # written once: relabelling and joins read it several times, the Python stages must not rerun
    return cut_lineage(decode_chunked(seq, models, list(keys), DECODE_CHUNK, with_posterior), "decoded")


# ---------------------------------------------------------------- relabel


def state_volatility(states: DataFrame, seq: DataFrame, keys: list[str] = ("entity",)) -> DataFrame:
    """Population std of all feature values (flattened) of each raw state."""
    keys = list(keys)
    joined = states.select(*keys, "t", "raw_state").join(seq.select(*keys, "t", "x"), [*keys, "t"])
    return (
        joined.select(*keys, "raw_state", F.explode("x").alias("v"))
        .groupBy(*keys, "raw_state")
        .agg(F.stddev_pop("v").alias("vol"))
    )


def relabel_map(vols: DataFrame, models: DataFrame, keys: list[str] = ("entity",)) -> DataFrame:
    """Rank every state 0..K-1 of the model by volatility; unused states (NULL) sort last."""
    keys = list(keys)
    all_states = models.select(*keys, F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("raw_state"))
    w = Window.partitionBy(*keys).orderBy(F.col("vol").asc_nulls_last(), F.col("raw_state").asc())
    return (
        all_states.join(vols, [*keys, "raw_state"], "left")
        .withColumn("state", (F.row_number().over(w) - 1).cast("int"))
        .select(*keys, "raw_state", "state", "vol")
    )


def relabel(states: DataFrame, seq: DataFrame, models: DataFrame, keys: list[str] = ("entity",)) -> DataFrame:
    """Add ``state`` = rank of the raw state's volatility (0 = calmest)."""
    keys = list(keys)
    mapping = relabel_map(state_volatility(states, seq, keys), models, keys)
    return states.join(mapping.select(*keys, "raw_state", "state"), [*keys, "raw_state"], "left")


# ---------------------------------------------------------------- transitions


def transitions(models: DataFrame, keys: list[str] = ("entity",)) -> DataFrame:
    """Long transition table ``(keys, from_state, to_state, prob)`` in raw state order."""
    keys = list(keys)
    rows = models.select(*keys, F.posexplode("transmat").alias("from_state", "row"))
    return rows.select(*keys, "from_state", F.posexplode("row").alias("to_state", "prob")).select(
        *keys,
        F.col("from_state").cast("int").alias("from_state"),
        F.col("to_state").cast("int").alias("to_state"),
        "prob",
    )


def expected_steps(models: DataFrame, keys: list[str] = ("entity",)) -> DataFrame:
    """``1 / (1 - p_ii + 1e-10)`` per state."""
    keys = list(keys)
    return expected_steps_of(transitions(models, keys), keys)


def expected_steps_of(table: DataFrame, keys: list[str]) -> DataFrame:
    """M18 on a long transition table."""
    stay = table.where(F.col("from_state") == F.col("to_state"))
    return stay.select(*keys, F.col("from_state").alias("state"), expected_run("prob").alias("expected_steps"))


def path_transitions(states: DataFrame, keys: list[str] = ("entity",), state_col: str = "raw_state") -> DataFrame:
    """M17 from a decoded path: ``(keys, from_state, to_state, prob)``, the shares of the steps that leave each state.

    Every pair of states that the entity visits has a row; a step meets its next one by a join on its number.
    """
    keys = list(keys)
    now = states.select(*keys, "t", F.col(state_col).alias("from_state"))
    after = states.select(*keys, (F.col("t") - 1).alias("t"), F.col(state_col).alias("to_state"))
    counts = now.join(after, [*keys, "t"]).groupBy(*keys, "from_state", "to_state").agg(F.count("*").alias("_n"))
    seen = states.groupBy(*keys).agg(F.array_sort(F.collect_set(state_col)).alias("_s"))  # a handful of states
    grid = seen.select(*keys, F.explode("_s").alias("from_state"), "_s").select(*keys, "from_state", F.explode("_s").alias("to_state"))
    full = grid.join(counts, [*keys, "from_state", "to_state"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    share = F.try_divide("_n", F.sum("_n").over(Window.partitionBy(*keys, "from_state")))
    return full.select(*keys, "from_state", "to_state", share.alias("prob"))


def state_usage(states: DataFrame, models: DataFrame, state_col: str = "state", keys: list[str] = ("entity",)) -> DataFrame:
    """Count and share of every state 0..K-1 (zero for unused states)."""
    keys = list(keys)
    all_states = models.select(*keys, F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias(state_col))
    counts = states.groupBy(*keys, state_col).agg(F.count("*").alias("cnt"))
    full = all_states.join(counts, [*keys, state_col], "left").withColumn(
        "cnt", F.coalesce(F.col("cnt"), F.lit(0)).cast("bigint")
    )
    return full.withColumn("share", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*keys)))


def state_entropy(usage: DataFrame, keys: list[str] = ("entity",)) -> DataFrame:
    """Shannon entropy (natural log, +1e-10) of the state-usage distribution."""
    return usage.groupBy(*keys).agg(
        F.sum(-F.col("share") * F.log(F.col("share") + F.lit(1e-10))).alias("entropy")
    )

