"""Feature build: centring (W2), rolling volatility (W3), normalisers (W8, W9, F2, F3),
market proxy (W4, F4), proxy attach (J1) and the final null drop (P3).

Rolling windows run over chunks of consecutive rows with a halo, and means, deviations and extremes
are one merged row per entity (``operators/chunks.py``), so no task holds an entity's whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regimekit.functions.scalar import safe_log_ratio
from regimekit.operators.chunks import moments, with_halo, with_rows_of, without_halo
from regimekit.operators.panel import date_filter, log_returns, materialize_panel
from regimekit.params import FeatureParams
from regimekit.session import cut_lineage


VOL_NORMS = ("zscore", "minmax", "log", "none")
PROXY_MODES = ("raw", "smoothed", "returns", "zscore")


def rolling(col: str, n: int, fn, spec: Window) -> Column:
    """Count-gated trailing window: NULL until ``n`` non-null values are in the frame (pandas ``rolling(n)``)."""
    frame = spec.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col).over(frame) == n, fn(col).over(frame))


def normalized_returns(returns: DataFrame) -> DataFrame:
    """``ret - mean(ret)`` per entity over its full history (centred, not scaled)."""
    centred = with_rows_of(returns, moments(returns, ["entity"], ["ret"]), ["entity"])
    return centred.select(*returns.columns, (F.col("ret") - F.col("ret_mean")).alias("normalized_returns"))


def mean_returns(returns: DataFrame) -> DataFrame:
    """A1: mean log return per entity."""
    return returns.groupBy("entity").agg(F.avg("ret").alias("mu"))


def rolling_vol(returns: DataFrame, windows=(5, 10, 20), chunk_rows: int | None = None) -> DataFrame:
    """Sample std (ddof 1) of raw returns over the last ``w`` rows, NULL until ``w`` rows exist."""
    rows, spec = with_halo(returns, ["entity"], max(windows) - 1, chunk_rows)
    vols = rows.select("*", *[rolling("ret", w, F.stddev_samp, spec).alias(f"vol_{w}") for w in windows])
    return without_halo(vols).select(*returns.columns, *[f"vol_{w}" for w in windows])


def normalize(col: str, method: str) -> Column:
    """Normalise a series by the ``moments`` of its entity's full history (NULL and NaN ignored there)."""
    c = F.col(col)
    if method == "zscore":
        return F.try_divide(c - F.col(f"{col}_mean"), F.col(f"{col}_sd"))
    if method == "minmax":
        return F.try_divide(c - F.col(f"{col}_lo"), F.col(f"{col}_hi") - F.col(f"{col}_lo"))
    if method == "log":
        return F.log1p(c)
    if method == "none":
        return c
    raise ValueError(f"vol_norm is one of {VOL_NORMS}, not {method!r}")


def normalize_vols(df: DataFrame, windows=(5, 10, 20), method: str = "zscore") -> DataFrame:
    vols = [f"vol_{w}" for w in windows]
    done = with_rows_of(df, moments(df, ["entity"], vols), ["entity"]) if method in ("zscore", "minmax") else df
    return done.select(*[normalize(c, method).alias(c) if c in vols else F.col(c) for c in df.columns])


def _in_order(series: DataFrame) -> DataFrame:
    """Add ``i``: 1, 2, … in time order."""
    from regimekit.plans.hmm import numbered

    one = series.withColumn("_series", F.lit(1))
    return numbered(one, ["_series"], F.trunc(F.col("ts").cast("date"), "month"), [F.col("ts")], "i").drop("_series")


def proxy_transform(proxy_prices: DataFrame, mode: str = "zscore", window: int = 5) -> DataFrame:
    """processed proxy ``(ts, market_vola)`` from the proxy's own non-null price series.

    ``smoothed`` and ``returns`` need neighbours in time: the rows are numbered month by month and meet their
    neighbours by number, so no window holds the whole series.  ``raw`` and ``zscore`` need no ordering.
    """
    s = proxy_prices.where(F.col("price").isNotNull()).select("ts", "price")
    if mode == "raw":
        out = s.select("ts", F.col("price").alias("market_vola"))
    elif mode == "smoothed":
        # row i takes part in the averages of rows i to i + window - 1
        part = _in_order(s).select("ts", "price", "i", F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("o"))
        mean = part.groupBy((F.col("i") + F.col("o")).alias("i")).agg(
            F.max(F.when(F.col("o") == 0, F.col("ts"))).alias("ts"), F.when(F.count("*") == window, F.avg("price")).alias("market_vola")
        )
        out = mean.where(F.col("ts").isNotNull()).select("ts", "market_vola")
    elif mode == "returns":
        rows = _in_order(s)
        before = rows.select((F.col("i") + 1).alias("i"), F.col("price").alias("before"))
        out = rows.join(before, "i").select("ts", safe_log_ratio(F.col("price"), F.col("before")).alias("market_vola"))
        out = out.where(F.col("market_vola").isNotNull())
    elif mode == "zscore":
        # order-free: mean and std are scalar subqueries, not a single-partition window
        mean = s.agg(F.avg("price")).scalar()
        std = s.agg(F.stddev_samp("price")).scalar()
        out = s.select("ts", F.try_divide(F.col("price") - mean, std).alias("market_vola"))
    else:
        raise ValueError(f"proxy_mode is one of {PROXY_MODES}, not {mode!r}")
    return out


def attach_proxy(features: DataFrame, proxy: DataFrame) -> DataFrame:
    """Left equi-join of the processed proxy on ``ts``.

    The proxy has one row per period.  No hint: AQE broadcasts it when its
    measured size is under the adaptive broadcast threshold.
    """
    return features.join(proxy, "ts", "left")


def drop_incomplete(features: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows with any NULL feature (``dropna``); NaN is treated like NULL."""
    cond = None
    for c in columns:
        ok = F.col(c).isNotNull() & ~F.isnan(F.col(c))
        cond = ok if cond is None else cond & ok
    return features.where(cond)


def build_features(prices: DataFrame, params: FeatureParams = FeatureParams(), proxy_entity: str = "^MKT") -> DataFrame:
    """Panel -> ``features(entity, ts, normalized_returns, vol_*, market_vola)``.

    Follows the reference's code order: date filter, complete-panel returns,
    centring, rolling vol + normalisation, proxy processed on its own price
    series, left join, null drop.
    """
    if params.vol_norm not in VOL_NORMS:
        raise ValueError(f"vol_norm is one of {VOL_NORMS}, not {params.vol_norm!r}")
    if params.proxy_mode not in PROXY_MODES:
        raise ValueError(f"proxy_mode is one of {PROXY_MODES}, not {params.proxy_mode!r}")
    prices = materialize_panel(date_filter(prices, params.start, params.end))
    returns = log_returns(prices, materialize=False)
    if not params.model_proxy:
        returns = returns.where(F.col("entity") != proxy_entity)
    rolled = cut_lineage(rolling_vol(returns, params.vol_windows), "rolled")  # read by the statistics and by the join with them
    vols = [f"vol_{w}" for w in params.vol_windows]
    stated = with_rows_of(rolled, moments(rolled, ["entity"], ["ret", *vols]), ["entity"])
    centred = (F.col("ret") - F.col("ret_mean")).alias("normalized_returns")
    feats = stated.select("entity", "ts", centred, *[normalize(v, params.vol_norm).alias(v) for v in vols])
    proxy = proxy_transform(prices.where(F.col("entity") == proxy_entity), params.proxy_mode, params.proxy_window)
    cols = params.feature_columns
    out = attach_proxy(feats.select("entity", "ts", *cols[:-1]), proxy)
    return drop_incomplete(out, cols).select("entity", "ts", *cols)
