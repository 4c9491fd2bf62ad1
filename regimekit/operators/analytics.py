"""Per-regime analytics on a state-labelled table.

Input ``labeled``: ``entity, ts, normalized_returns, vol_*, market_vola, state`` and, for results of several
layers, ``layer``.  The volatility measures are those of the table's schema, whatever its windows.
Every analytic is keyed by entity (and layer, and measure); quantiles are exact, from a bracket of a few rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regimekit.functions.scalar import palette_index
from regimekit.functions.stats import f_pvalue
from regimekit.operators.chunks import known, moments, with_halo, with_rows_of, without_halo
from regimekit.session import cut_lineage

N_BINS = 50
BRACKET_ACCURACY = 1_000  # a quantile's bracket holds about 4 / BRACKET_ACCURACY of a group


def measures_of(df: DataFrame) -> list[str]:
    """The volatility measures of a table, by its schema: ``vol_<window>`` in window order, then ``market_vola``."""
    vols = sorted((c for c in df.columns if re.fullmatch(r"vol_\d+", c)), key=lambda c: int(c[4:]))
    return [*vols, *(c for c in ("market_vola",) if c in df.columns)]


def series_keys(df: DataFrame) -> list[str]:
    """What tells one series of regimes from another: the entity, and the layer where the table has several."""
    return ["entity", *(c for c in ("layer",) if c in df.columns)]


def unpivot_measures(df: DataFrame, measures=None, keep=("entity", "layer", "ts", "state")) -> DataFrame:
    """Long form ``(keep..., measure, value)``; one pass, no union of per-measure frames."""
    keep = [c for c in keep if c in df.columns]
    return df.unpivot(keep, list(measures or measures_of(df)), "measure", "value")


def bracket_counts(df: DataFrame, keys: list[str], measures: list[str], q: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows around the ``q``-quantile of every measure, from two scans of the wide table: ``keys, by, measure, zone, v, c, h``.

    The first scan takes, for all measures at once, an approximate quantile a little below and one a little above,
    which bracket the two order statistics that the exact quantile lies between.  The second counts rows: below the bracket
    (zone 0) and above it (zone 2) without their values, inside it (zone 1) by value.  ``h`` is the quantile's place
    among the group's known values.  Nulls and NaN are left out.
    """
    eps, accuracy = 2.0 / BRACKET_ACCURACY, 2 * BRACKET_ACCURACY
    around = F.array(F.lit(max(0.0, q - eps)), F.lit(min(1.0, q + eps)))
    first = []
    for i, m in enumerate(measures):
        v = known(F.col(m).cast("double"))
        first += [F.percentile_approx(v, around, accuracy).alias(f"_a{i}"), F.count(v).alias(f"_n{i}"), F.min(v).alias(f"_min{i}"), F.max(v).alias(f"_max{i}")]
    brackets = df.groupBy(*keys).agg(*first)
    cells = []
    for i, m in enumerate(measures):
        # the bracket reaches 1.5 / BRACKET_ACCURACY of the rows to both sides at least: in a short group the next
        # order statistic may lie beyond it
        wide = F.col(f"_n{i}") < F.lit(2 * BRACKET_ACCURACY)
        lo, hi = F.when(wide, F.col(f"_min{i}")).otherwise(F.col(f"_a{i}")[0]), F.when(wide, F.col(f"_max{i}")).otherwise(F.col(f"_a{i}")[1])
        v = known(F.col(m).cast("double"))
        zone = F.when(v < lo, 0).when(v > hi, 2).when(v.isNotNull(), 1)
        cells.append(F.struct(F.lit(m).alias("measure"), zone.alias("zone"), F.when(zone == 1, v).alias("v"), ((F.col(f"_n{i}") - 1) * F.lit(float(q))).alias("h")))
    rows = with_rows_of(df.select(*keys, *[b for b in by if b not in keys], *measures), brackets, keys)
    long = rows.select(*keys, *by, F.explode(F.array(*cells)).alias("x")).select(*keys, *by, "x.*").where("zone is not null")
    return long.groupBy(*keys, *by, "measure", "zone", "v", "h").agg(F.count("*").alias("c"))


def quantiles_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, measure, threshold`` from ``bracket_counts``: the exact linear-interpolation quantile (NumPy's default)."""
    group = [*keys, "measure"]
    near = counts.where("zone < 2").groupBy(*group, "zone", "v", "h").agg(F.sum("c").alias("c"))
    placed = near.withColumn("_upto", F.sum("c").over(Window.partitionBy(*group).orderBy("zone", "v"))).where("zone = 1")
    low, high = F.floor("h") + 1, F.ceil("h") + 1  # 1-based ranks
    pick = placed.groupBy(*group).agg(
        F.min(F.when(F.col("_upto") >= low, F.col("v"))).alias("_l"), F.min(F.when(F.col("_upto") >= high, F.col("v"))).alias("_u"), F.first("h").alias("_h")
    )
    return pick.select(*group, (F.col("_l") + (F.col("_u") - F.col("_l")) * (F.col("_h") - F.floor("_h"))).alias("threshold"))


def exact_quantiles(df: DataFrame, keys: list[str], measures: list[str], q: float) -> DataFrame:
    """A4: ``keys, measure, threshold`` of all measures of a wide table."""
    return quantiles_of(bracket_counts(df, keys, measures, q), keys)


def vol_quantiles(labeled: DataFrame, q: float = 0.95, measures=None) -> DataFrame:
    """A4: quantile per (entity, measure)."""
    return exact_quantiles(labeled, ["entity"], list(measures or measures_of(labeled)), q)


def vol_spikes(features: DataFrame, percentile: float = 95.0, measures=None) -> DataFrame:
    """Rows whose measure is strictly above its per-entity percentile (NULLs ignored)."""
    long = unpivot_measures(features, measures, ("entity", "ts")).where(known("value").isNotNull())
    thresholds = exact_quantiles(features, ["entity"], list(measures or measures_of(features)), percentile / 100.0)
    return with_rows_of(long, thresholds, ["entity", "measure"], "inner").where(F.col("value") > F.col("threshold"))


def series_with_spikes(features: DataFrame, percentile: float = 95.0, measures=None) -> DataFrame:
    """C4: returns and all volatilities as one long series, with a mark on the spikes of each measure."""
    measures = list(measures or measures_of(features))
    long = unpivot_measures(features, ["normalized_returns", *measures], ("entity", "ts"))
    joined = with_rows_of(long, exact_quantiles(features, ["entity"], measures, percentile / 100.0), ["entity", "measure"])
    return joined.select("entity", "ts", "measure", "value", F.coalesce(known("value") > F.col("threshold"), F.lit(False)).alias("spike"))


def regime_return_means(labeled: DataFrame) -> DataFrame:
    """A5: mean normalised return per regime."""
    return labeled.groupBy(*series_keys(labeled), "state").agg(F.avg("normalized_returns").alias("mean_return"))


def feature_means(labeled: DataFrame, measures=None) -> DataFrame:
    """Mean of every feature except returns per regime, long (feature, state, mean)."""
    long = unpivot_measures(labeled, measures)
    return long.groupBy(*series_keys(labeled), "measure", "state").agg(F.avg("value").alias("mean_value"))


def regime_capture(labeled: DataFrame, q: float = 0.95, measures=None) -> DataFrame:
    """A9 (+P8): share of each regime among rows at or above the measure's q-quantile.

    The grid is every regime captured by some measure of the entity; a regime
    a measure does not capture gets share 0 (the reference's ``fillna(0)``).
    """
    keys = series_keys(labeled)
    around = cut_lineage(bracket_counts(labeled, keys, list(measures or measures_of(labeled)), q, ("state",)), "brackets")
    at = with_rows_of(around, quantiles_of(around, keys), [*keys, "measure"], "inner")
    high = F.when((F.col("zone") == 2) | ((F.col("zone") == 1) & (F.col("v") >= F.col("threshold"))), F.col("c")).otherwise(0)
    counts = at.groupBy(*keys, "measure", "state").agg(F.sum(high).alias("cnt"))
    # from here on one row per key, measure and regime
    captured = F.max("cnt").over(Window.partitionBy(*keys, "state")) > 0
    share = F.try_divide("cnt", F.sum("cnt").over(Window.partitionBy(*keys, "measure")))
    grid = counts.withColumn("_captured", captured).withColumn("share", share)
    return grid.where(F.col("_captured") & F.col("share").isNotNull()).select(*keys, "measure", "state", "share")


def state_vol_corr(labeled: DataFrame, measures=None) -> DataFrame:
    """A10: Pearson correlation of each measure with the regime number (pairwise NULL drop)."""
    long = unpivot_measures(labeled, measures)
    return long.groupBy(*series_keys(labeled), "measure").agg(F.corr("value", F.col("state").cast("double")).alias("corr"))


def vol_trend_by_state(labeled: DataFrame, measures=None, window: int = 3, chunk_rows: int | None = None) -> DataFrame:
    """A11 (W5, W6): mean first difference of the 3-step moving average per regime."""
    keys = series_keys(labeled)
    measures = list(measures or measures_of(labeled))
    rows, spec = with_halo(labeled.select(*keys, "ts", "state", *measures), keys, window, chunk_rows)
    frame = spec.rowsBetween(-(window - 1), 0)
    for m in measures:
        rows = rows.withColumn(f"_{m}", F.when(F.count(m).over(frame) == window, F.avg(m).over(frame)))
    trends = without_halo(rows.select("*", *[(F.col(f"_{m}") - F.lag(f"_{m}").over(spec)).alias(f"__{m}") for m in measures]))
    long = trends.select(*keys, "state", *[F.col(f"__{m}").alias(m) for m in measures]).unpivot([*keys, "state"], measures, "measure", "trend")
    return long.groupBy(*keys, "measure", "state").agg(F.avg("trend").alias("avg_trend"))


def _bins(value: Column, lo: Column, hi: Column, n: int) -> Column:
    """Equal-width bin 0..n-1 over [lo, hi]; the maximum falls in the last bin."""
    raw = F.floor(F.try_divide((value - lo) * F.lit(float(n)), hi - lo))
    return F.least(F.coalesce(raw, F.lit(0)), F.lit(n - 1)).cast("int")


def returns_histogram(features: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """Counts of normalised returns in ``n_bins`` equal bins between the entity's min and max."""
    x = features.select("entity", known("normalized_returns").alias("v")).where("v is not null")
    x = with_rows_of(x, moments(x, ["entity"], ["v"]), ["entity"])
    counts = x.groupBy("entity", _bins(F.col("v"), F.col("v_lo"), F.col("v_hi"), n_bins).alias("bin"), "v_lo", "v_hi").agg(F.count("*").cast("bigint").alias("cnt"))
    return counts.select("entity", "bin", (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("bin") / F.lit(float(n_bins))).alias("bin_lo"), "cnt")


def regime_histograms(labeled: DataFrame, measures=None, n_bins: int = N_BINS) -> DataFrame:
    """Per feature, bins over the feature's range; counts per (bin, regime)."""
    keys = series_keys(labeled)
    measures = list(measures or ["normalized_returns", *measures_of(labeled)])
    rows = with_rows_of(labeled.select(*keys, "state", *measures), moments(labeled, keys, measures), keys)
    binned = rows.select(*keys, "state", *[F.when(known(m).isNotNull(), _bins(F.col(m), F.col(f"{m}_lo"), F.col(f"{m}_hi"), n_bins)).alias(m) for m in measures])
    long = binned.unpivot([*keys, "state"], measures, "measure", "bin").where("bin is not null")
    return long.groupBy(*keys, "measure", "state", "bin").agg(F.count("*").cast("bigint").alias("cnt"))


def anova_returns(labeled: DataFrame, value: str = "normalized_returns") -> DataFrame:
    """One-way ANOVA of ``value`` by regime: two-level aggregate -> F, dfs, p-value."""
    keys = series_keys(labeled)
    g = labeled.where(known(value).isNotNull() & F.col("state").isNotNull()).groupBy(*keys, "state").agg(
        F.count(value).alias("n"), F.sum(value).alias("s"), F.avg(value).alias("m"),
        (F.var_pop(value) * F.count(value)).alias("ssw_g"),
    )
    tot = g.groupBy(*keys).agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        (F.sum("s") / F.sum("n")).alias("grand"),
        F.sum("ssw_g").alias("ssw"),
        F.collect_list(F.struct("n", "m")).alias("groups"),
    )
    ssb = F.aggregate(
        "groups", F.lit(0.0), lambda acc, e: acc + e["n"] * (e["m"] - F.col("grand")) * (e["m"] - F.col("grand"))
    )
    out = tot.select(
        *keys,
        (F.col("k") - 1).cast("bigint").alias("df_between"),
        (F.col("n") - F.col("k")).cast("bigint").alias("df_within"),
        ssb.alias("ssb"),
        "ssw",
    )
    f_stat = F.try_divide(
        F.try_divide(F.col("ssb"), F.col("df_between").cast("double")),
        F.try_divide(F.col("ssw"), F.col("df_within").cast("double")),
    )
    out = out.withColumn("f_stat", f_stat)
    from regimekit.session import ship_package

    ship_package(labeled.sparkSession)
    return out.withColumn("p_value", f_pvalue(F.col("f_stat"), F.col("df_between"), F.col("df_within")))


def anova_report(anova: DataFrame, layer: str = "0") -> DataFrame:
    """A sentence on the ANOVA p-value per entity (and layer): the value and how strong the evidence is.

    A p-value that is undefined (one regime, constant returns) is reported as such.
    """
    p = F.col("p_value")
    strength = (
        F.when(p < 0.01, "mean returns clearly differ between regimes (1% level)")
        .when(p < 0.05, "mean returns differ between regimes (5% level)")
        .when(p < 0.1, "mean returns may differ between regimes (10% level)")
        .otherwise("no difference of mean returns between regimes is shown")
    )
    name = F.col("layer") if "layer" in anova.columns else F.lit(layer)
    head = F.concat(F.lit("Layer "), name, F.lit(", returns by regime: "))
    text = F.when(p.isNull() | F.isnan(p), F.lit("the p-value is undefined")).otherwise(F.concat(F.lit("p = "), F.format_string("%.4f", p), F.lit("; "), strength))
    return anova.select(*series_keys(anova), F.concat(head, text).alias("report"))


def anova_report_of(labeled: DataFrame, value: str = "normalized_returns", state: str = "state") -> DataFrame:
    """A16 on a table that may lack a column: the report, or one sentence that names what is missing."""
    missing = [c for c in ("entity", value, state) if c not in labeled.columns]
    if missing:
        return labeled.sparkSession.sql("SELECT 1").select(F.lit(None).cast("string").alias("entity"), F.lit(f"not computed: the table has no column {', '.join(missing)}").alias("report"))
    return anova_report(anova_returns(labeled.withColumnRenamed(state, "state"), value))


def regime_series(labeled: DataFrame) -> DataFrame:
    """Return series coloured by regime (palette slot = state mod 10)."""
    return labeled.select(*series_keys(labeled), "ts", "normalized_returns", "state", palette_index("state").alias("color_idx"))


def states_vs_vol(labeled: DataFrame, q: float = 0.95, measures=None) -> DataFrame:
    """C2 (W7): threshold line per measure from the first to the last timestamp of the entity."""
    keys = series_keys(labeled)
    measures = list(measures or measures_of(labeled))
    ends = labeled.groupBy(*keys).agg(F.min("ts").alias("ts_first"), F.max("ts").alias("ts_last"))
    lines = ends.select(*keys, "ts_first", "ts_last", F.explode(F.array(*[F.lit(m) for m in measures])).alias("measure"))
    joined = with_rows_of(lines, exact_quantiles(labeled, keys, measures, q), [*keys, "measure"])
    return joined.select(*keys, "measure", "threshold", "ts_first", "ts_last")


def available_layers(states_long: DataFrame) -> DataFrame:
    """P10: the distinct layers present in a long states table, per entity."""
    return states_long.select("entity", "layer").distinct()


def select_layer(states_long: DataFrame, layer: str) -> DataFrame:
    """P10: pick one layer; unknown layer -> error listing the available ones."""
    present = [r[0] for r in states_long.select("layer").distinct().collect()]  # a handful of layer names
    if layer not in present:
        raise ValueError(f"no layer {layer!r}; the table has {sorted(present)}")
    return states_long.where(F.col("layer") == layer)
