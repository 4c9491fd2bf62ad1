"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the test tables, builds a panel and runs one operator (or a
short chain ending in it).  Double columns are rounded to 6 decimals so the
result can be hashed against the DuckDB oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimekit.functions import hmm_expr as HX
from regimekit.functions.scalar import sanitize_entity, state_label
from regimekit.operators import analytics as AN
from regimekit.operators import features as feat
from regimekit.operators import panel as pnl
from regimekit.params import FeatureParams, FitParams, HierarchicalParams, LayeredParams
from regimekit.plans import hmm as H
from regimekit.plans.fixed import GivenModel, attach_model
from regimekit.plans.variants import HierarchicalModel, LayeredModel, PlainModel, state_labeled
from regimekit.sources import panels as src

R = 6
NUDGE = 1e-9  # added before rounding (as in the oracle), so that a mean such as 0.0003125 is no tie
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Fixed query parameters shared with the oracle SQL.
DATE_START, DATE_END = "1996-01-01", "1999-12-31"
MAIN_PANEL = "flag_day"
GAP_PANEL = "event_hour"


def rounded(df: DataFrame, digits: int = R) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name) + F.lit(NUDGE), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def panel(spark: SparkSession, sf_dir: str, name: str = MAIN_PANEL) -> DataFrame:
    return src.price_panel(spark, sf_dir, name)


def returns(spark: SparkSession, sf_dir: str, name: str = MAIN_PANEL) -> DataFrame:
    return pnl.log_returns(panel(spark, sf_dir, name))


def features(spark: SparkSession, sf_dir: str, name: str = MAIN_PANEL, params: FeatureParams = FeatureParams()) -> DataFrame:
    return feat.build_features(panel(spark, sf_dir, name), params, src.PANELS[name].proxy)


# ---------------------------------------------------------------- sources


@query("price_bars")
def q_price_bars(spark, sf_dir):
    return rounded(panel(spark, sf_dir))


@query("price_bars_last")
def q_price_bars_last(spark, sf_dir):
    obs = src.observations(spark, sf_dir, src.PANELS["flag_week"])
    return rounded(src.price_bars(obs, "week", how="last"))


@query("lookback_filter")
def q_lookback(spark, sf_dir):
    return rounded(src.lookback_filter(panel(spark, sf_dir), "2 years"))


@query("entity_filter")
def q_entity_filter(spark, sf_dir):
    return rounded(src.entity_filter(panel(spark, sf_dir), ["A", "R"]))


@query("date_filter")
def q_date_filter(spark, sf_dir):
    return rounded(pnl.date_filter(panel(spark, sf_dir), DATE_START, DATE_END))


# ---------------------------------------------------------------- panel rule


@query("complete_panel")
def q_complete_panel(spark, sf_dir):
    return pnl.complete_calendar(panel(spark, sf_dir, GAP_PANEL))


@query("kept_calendar")
def q_kept_calendar(spark, sf_dir):
    return pnl.kept_calendar(panel(spark, sf_dir, GAP_PANEL))


@query("entity_universe")
def q_entity_universe(spark, sf_dir):
    p = panel(spark, sf_dir)
    return pnl.entity_universe(p.where(F.col("entity") != "^MKT"), p.where(F.col("entity") == "^MKT"))


@query("missing_entities")
def q_missing_entities(spark, sf_dir):
    wanted = spark.createDataFrame([("A",), ("N",), ("R",), ("X",), ("^MKT",)], "entity STRING")
    return pnl.missing_entities(wanted, panel(spark, sf_dir))


@query("sanitize_entity")
def q_sanitize(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.select("entity").distinct().select("entity", sanitize_entity("entity").alias("safe_name"))


# ---------------------------------------------------------------- returns / features


@query("log_returns")
def q_log_returns(spark, sf_dir):
    return rounded(returns(spark, sf_dir))


@query("log_returns_gappy")
def q_log_returns_gappy(spark, sf_dir):
    return rounded(returns(spark, sf_dir, GAP_PANEL))


@query("mean_returns")
def q_mean_returns(spark, sf_dir):
    return rounded(feat.mean_returns(returns(spark, sf_dir)))


@query("normalized_returns")
def q_normalized_returns(spark, sf_dir):
    return rounded(feat.normalized_returns(returns(spark, sf_dir)))


@query("rolling_vol")
def q_rolling_vol(spark, sf_dir):
    return rounded(feat.rolling_vol(returns(spark, sf_dir), (5, 10, 20)))


def _vol_norm(method):
    def run(spark, sf_dir):
        r = feat.rolling_vol(returns(spark, sf_dir), (5, 10, 20))
        return rounded(feat.normalize_vols(r, (5, 10, 20), method).drop("ret"))

    return run


for _m in ("zscore", "minmax", "log", "none"):
    QUERIES[f"vol_norm_{_m}"] = _vol_norm(_m)


def _proxy(mode):
    def run(spark, sf_dir):
        p = panel(spark, sf_dir)
        return rounded(feat.proxy_transform(p.where(F.col("entity") == "^MKT"), mode, 5))

    return run


for _m in ("raw", "smoothed", "returns", "zscore"):
    QUERIES[f"proxy_{_m}"] = _proxy(_m)


@query("attach_proxy")
def q_attach_proxy(spark, sf_dir):
    p = panel(spark, sf_dir)
    r = feat.normalized_returns(pnl.log_returns(p)).select("entity", "ts", "normalized_returns")
    return rounded(feat.attach_proxy(r, feat.proxy_transform(p.where(F.col("entity") == "^MKT"))))


@query("features")
def q_features(spark, sf_dir):
    return rounded(features(spark, sf_dir))


@query("features_gappy")
def q_features_gappy(spark, sf_dir):
    return rounded(features(spark, sf_dir, GAP_PANEL))


@query("features_dated")
def q_features_dated(spark, sf_dir):
    params = FeatureParams(start=DATE_START, end=DATE_END, vol_norm="minmax", proxy_mode="smoothed")
    return rounded(features(spark, sf_dir, MAIN_PANEL, params))


@query("features_weekly")
def q_features_weekly(spark, sf_dir):
    return rounded(features(spark, sf_dir, "priority_week"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly return-flag panel -> features -> plain regime model -> state-labelled table."""
    feats = features(spark, sf_dir, "flag_week")
    res = PlainModel(FeatureParams().feature_columns, FitParams()).fit(feats)
    return rounded(state_labeled(feats, res.states, ["regime_layer0"]))


# ---------------------------------------------------------------- given-model decode and analytics


# Fixed model of the oracle-checked decode: 2 states on the z-scored 5-step volatility.
GIVEN_FEATURE = "vol_5"
GIVEN = GivenModel(
    startprob=(0.5, 0.5),
    transmat=((0.95, 0.05), (0.05, 0.95)),
    means=((-0.5,), (1.0,)),
    covars=(((0.5,),), ((2.0,),)),
)
LL_DIGITS = 4


def given_decode(spark, sf_dir, panel_name: str = MAIN_PANEL):
    from regimekit.session import cut_lineage

    feats = cut_lineage(features(spark, sf_dir, panel_name), "features")
    seq = H.sequences(feats, [GIVEN_FEATURE])
    models = attach_model(feats, GIVEN)
    states = H.decode(seq, models)
    return feats, seq, models, states


def labeled(spark, sf_dir, panel_name: str = MAIN_PANEL) -> DataFrame:
    """Features left-joined with the relabelled regime of the given model, written once for the analytics that scan it."""
    from regimekit.session import cut_lineage

    feats, seq, models, states = given_decode(spark, sf_dir, panel_name)
    rel = H.relabel(states, seq, models)
    return cut_lineage(feats.join(rel.select("entity", "ts", "state"), ["entity", "ts"], "left"), "labeled")


@query("train_val_split")
def q_split(spark, sf_dir):
    seq = H.sequences(features(spark, sf_dir), [GIVEN_FEATURE])
    return seq.select("entity", "ts", "t", F.col("n").cast("bigint").alias("n"), "split")


@query("min_length_guard")
def q_guard(spark, sf_dir):
    seq = H.sequences(features(spark, sf_dir, GAP_PANEL), [GIVEN_FEATURE])
    return H.length_guard(seq, 450)


@query("hmm_init")
def q_init(spark, sf_dir):
    feats = features(spark, sf_dir)
    fit = FitParams(min_k=2, max_k=3)
    seq = H.sequences(feats, fit_columns(), fit)
    init = H.init_models(seq, fit, ks=[2, 3], seeds=[0, 1, 7])
    m = init.select("entity", "k", "seed", F.posexplode("means").alias("state", "mu"))
    m = m.select("entity", "k", "seed", "state", F.posexplode("mu").alias("d", "mean"))
    return rounded(m.select("entity", "k", "seed", F.col("state").cast("int"), F.col("d").cast("int"), "mean"))


def fit_columns() -> list[str]:
    return FeatureParams().feature_columns


@query("emission_logpdf")
def q_emission(spark, sf_dir):
    feats = features(spark, sf_dir)
    seq = H.sequences(feats, [GIVEN_FEATURE])
    models = HX.with_precision(attach_model(feats, GIVEN))
    j = seq.join(models, "entity")
    lb = HX.emission_logpdf(F.col("x"), F.col("means"), F.col("inv_chol"), F.col("logdet"))
    return rounded(j.select("entity", "ts", lb[0].alias("lb_0"), lb[1].alias("lb_1")))


@query("hier_decode_rowwise")
def q_rowwise(spark, sf_dir):
    feats = features(spark, sf_dir)
    seq = H.sequences(feats, [GIVEN_FEATURE])
    models = HX.with_precision(attach_model(feats, GIVEN))
    j = seq.join(models, "entity")
    st = HX.rowwise_state(F.col("x"), F.col("startprob"), F.col("means"), F.col("inv_chol"), F.col("logdet"))
    return j.select("entity", "ts", st.alias("sub_state"))


@query("hmm_viterbi")
def q_viterbi(spark, sf_dir):
    return given_decode(spark, sf_dir)[3].select("entity", "ts", "raw_state")


@query("hmm_score")
def q_score(spark, sf_dir):
    st = given_decode(spark, sf_dir)[3]
    return st.groupBy("entity").agg(
        F.round(F.first("loglik"), LL_DIGITS).alias("loglik"), F.count("*").cast("bigint").alias("n")
    )


@query("hmm_posterior")
def q_posterior(spark, sf_dir):
    st = given_decode(spark, sf_dir)[3]
    return rounded(st.select("entity", "ts", F.col("posterior")[0].alias("post_0"), F.col("posterior")[1].alias("post_1")))


@query("state_volatility")
def q_state_vol(spark, sf_dir):
    _, seq, _, states = given_decode(spark, sf_dir)
    return rounded(H.state_volatility(states, seq).select("entity", "raw_state", "vol"))


@query("relabel_states")
def q_relabel(spark, sf_dir):
    _, seq, models, states = given_decode(spark, sf_dir)
    return rounded(H.relabel_map(H.state_volatility(states, seq), models))


@query("state_labeled")
def q_state_labeled(spark, sf_dir):
    return rounded(labeled(spark, sf_dir))


@query("state_usage")
def q_state_usage(spark, sf_dir):
    lab = labeled(spark, sf_dir)
    models = attach_model(lab, GIVEN)
    return rounded(H.state_usage(lab, models))


@query("state_entropy")
def q_state_entropy(spark, sf_dir):
    lab = labeled(spark, sf_dir)
    return rounded(H.state_entropy(H.state_usage(lab, attach_model(lab, GIVEN))))


def _score_frame(spark, sf_dir) -> DataFrame:
    _, _, models, states = given_decode(spark, sf_dir)
    usage = H.state_usage(states, models, state_col="raw_state")
    ent = H.state_entropy(usage)
    ll = states.groupBy("entity").agg(F.first("loglik").alias("val_loglik"), F.count("*").alias("n_val"))
    return ll.join(ent, "entity").select(
        "entity", "val_loglik", "n_val", F.col("entropy").alias("val_entropy"),
        F.lit(GIVEN.k).alias("k"), F.lit(1).alias("d"),
    )


@query("entropy_score")
def q_entropy_score(spark, sf_dir):
    s = H.with_score(_score_frame(spark, sf_dir), H.entropy_score(4.0))
    return rounded(
        s.select(
            "entity",
            (F.col("val_loglik") / F.col("n_val")).alias("norm_ll"),
            F.col("val_entropy").alias("entropy"),
            "score",
        )
    )


@query("bic")
def q_bic(spark, sf_dir):
    s = _score_frame(spark, sf_dir)
    cols = {n: F.col(n) for n in s.columns}
    return s.select("entity", F.round(H.bic(cols), LL_DIGITS).alias("bic"))


@query("transition_matrix")
def q_transitions(spark, sf_dir):
    """M17 of the decoded path: the shares of each state's steps that lead to each state."""
    t = H.path_transitions(given_decode(spark, sf_dir)[3])
    return rounded(
        t.select(
            "entity",
            state_label(0, "from_state").alias("from_label"),
            state_label(0, "to_state").alias("to_label"),
            "prob",
        )
    )


@query("expected_steps")
def q_expected_steps(spark, sf_dir):
    e = H.expected_steps_of(H.path_transitions(given_decode(spark, sf_dir)[3]), ["entity"])
    return rounded(e.select("entity", state_label(0, "state").alias("state_label"), "expected_steps"))


@query("regime_return_means")
def q_regime_return_means(spark, sf_dir):
    return rounded(AN.regime_return_means(labeled(spark, sf_dir)))


@query("feature_means")
def q_feature_means(spark, sf_dir):
    return rounded(AN.feature_means(labeled(spark, sf_dir)))


@query("regime_capture")
def q_regime_capture(spark, sf_dir):
    return rounded(AN.regime_capture(labeled(spark, sf_dir)))


@query("state_vol_corr")
def q_state_vol_corr(spark, sf_dir):
    return rounded(AN.state_vol_corr(labeled(spark, sf_dir)))


@query("vol_trend_by_state")
def q_vol_trend(spark, sf_dir):
    return rounded(AN.vol_trend_by_state(labeled(spark, sf_dir)))


@query("returns_histogram")
def q_returns_histogram(spark, sf_dir):
    return rounded(AN.returns_histogram(features(spark, sf_dir)))


@query("regime_histograms")
def q_regime_histograms(spark, sf_dir):
    return AN.regime_histograms(labeled(spark, sf_dir))


@query("anova_returns")
def q_anova(spark, sf_dir):
    a = AN.anova_returns(labeled(spark, sf_dir))
    return rounded(a.select("entity", "df_between", "df_within", "ssb", "ssw", "f_stat"))


@query("anova_pvalue")
def q_anova_p(spark, sf_dir):
    return rounded(AN.anova_returns(labeled(spark, sf_dir)).select("entity", "f_stat", "p_value"))


@query("anova_report")
def q_anova_report(spark, sf_dir):
    return AN.anova_report(AN.anova_returns(labeled(spark, sf_dir)))


@query("regime_series")
def q_regime_series(spark, sf_dir):
    return rounded(AN.regime_series(labeled(spark, sf_dir)))


@query("states_vs_vol")
def q_states_vs_vol(spark, sf_dir):
    return rounded(AN.states_vs_vol(labeled(spark, sf_dir)))


@query("vol_quantiles")
def q_vol_quantiles(spark, sf_dir):
    return rounded(AN.vol_quantiles(features(spark, sf_dir)))


@query("vol_spikes")
def q_vol_spikes(spark, sf_dir):
    return rounded(AN.vol_spikes(features(spark, sf_dir)).select("entity", "ts", "measure", "value"))


# ---------------------------------------------------------------- fitted variants (property-checked, no SQL oracle)


FIT = FitParams()  # the reference's settings: 100 restarts, 100 EM iterations, tol 1e-4, entropy weight 4


def plain_result(spark, sf_dir, panel_name: str = MAIN_PANEL):
    return PlainModel(fit_columns(), FIT).fit(features(spark, sf_dir, panel_name))


def _fit_summary(fits: DataFrame) -> DataFrame:
    return rounded(
        fits.select("entity", "layer", "k", "seed", "status", "n_iter", "train_loglik", "val_loglik", "val_entropy", "score")
    )


@query("hmm_fit")
def q_hmm_fit(spark, sf_dir):
    return _fit_summary(plain_result(spark, sf_dir).fits)


@query("select_best_model")
def q_select_best(spark, sf_dir):
    m = plain_result(spark, sf_dir).models
    return rounded(m.select("entity", "layer", "k", "seed", "score", "val_entropy"))


@query("regimes_plain")
def q_regimes_plain(spark, sf_dir):
    return plain_result(spark, sf_dir).states


@query("fitted_transitions")
def q_fitted_transitions(spark, sf_dir):
    return rounded(plain_result(spark, sf_dir).transitions)


@query("fitted_expected_steps")
def q_fitted_expected_steps(spark, sf_dir):
    return rounded(plain_result(spark, sf_dir).expected_steps())


@query("regimes_layered")
def q_regimes_layered(spark, sf_dir):
    res = LayeredModel(fit_columns(), LayeredParams(fit=FIT)).fit(features(spark, sf_dir))
    return res.states


@query("regimes_hierarchical")
def q_regimes_hierarchical(spark, sf_dir):
    res = HierarchicalModel(fit_columns(), HierarchicalParams(fit=FIT)).fit(features(spark, sf_dir))
    return res.states


@query("fitted_state_labeled")
def q_fitted_state_labeled(spark, sf_dir):
    feats = features(spark, sf_dir)
    res = PlainModel(fit_columns(), FIT).fit(feats)
    return rounded(state_labeled(feats, res.states, ["regime_layer0"]))


# ---------------------------------------------------------------- remaining operators of the inventory


@query("train_val_split_shuffled")
def q_split_shuffled(spark, sf_dir):
    seq = H.sequences(features(spark, sf_dir), [GIVEN_FEATURE], FitParams(shuffle=True))
    return seq.select("entity", "ts", "t", F.col("n").cast("bigint").alias("n"), "split")


def _given_rowwise(spark, sf_dir) -> DataFrame:
    feats, seq, models, states = given_decode(spark, sf_dir)
    pm = HX.with_precision(models)
    j = seq.join(pm, "entity")
    st = HX.rowwise_state(F.col("x"), F.col("startprob"), F.col("means"), F.col("inv_chol"), F.col("logdet"))
    return j.select("entity", "ts", st.alias("state"))


@query("available_layers")
def q_available_layers(spark, sf_dir):
    """P10 on a long states table holding a sequence decode and a row-wise decode."""
    _, _, _, states = given_decode(spark, sf_dir)
    long = states.select("entity", "ts", F.lit("regime_layer0").alias("layer"), F.col("raw_state").alias("state"))
    long = long.unionByName(_given_rowwise(spark, sf_dir).withColumn("layer", F.lit("sub_level_state")))
    return AN.available_layers(long)


@query("layered_features")
def q_layered_features(spark, sf_dir):
    """Input of the next layer = original observation ++ posterior of this layer."""
    _, seq, _, states = given_decode(spark, sf_dir)
    nxt = seq.join(states.select("entity", "t", "posterior"), ["entity", "t"]).select(
        "entity", "ts", F.concat("x", "posterior").alias("x1")
    )
    return rounded(nxt.select("entity", "ts", *[F.col("x1")[i].alias(f"x1_{i}") for i in range(1 + GIVEN.k)]))


@query("sub_partition")
def q_sub_partition(spark, sf_dir):
    """Rows per (entity, top state) and whether the sub-model may be fitted (>= 10 rows)."""
    _, _, _, states = given_decode(spark, sf_dir)
    rows = states.select("entity", F.col("raw_state").alias("top_state"))
    seq = rows.groupBy("entity", "top_state").agg(F.count("*").cast("bigint").alias("n_rows"))
    return seq.withColumn("fit_sub", F.col("n_rows") >= 10)


def _em_columns(models: DataFrame, d: int) -> DataFrame:
    return rounded(
        models.select(
            "entity",
            *[F.col("startprob")[i].alias(f"pi_{i}") for i in range(2)],
            *[F.col("transmat")[i][j].alias(f"a_{i}{j}") for i in range(2) for j in range(2)],
            *[F.col("means")[i][x].alias(f"mu_{i}" + (f"_{x}" if d > 1 else "")) for i in range(2) for x in range(d)],
            *[F.col("covars")[i][x][y].alias(f"var_{i}" + (f"_{x}{y}" if d > 1 else "")) for i in range(2) for x in range(d) for y in range(x, d)],
        )
    )


def _em_from(feats: DataFrame, model: GivenModel, columns: list[str], rounds: int) -> DataFrame:
    from regimekit.plans.em import em_stages

    fit = FitParams(max_iter=rounds, split="all", min_rows=1, tol=-1.0)
    return em_stages(H.sequences(feats, columns, fit), attach_model(feats, model), fit, chunk_len=EM_CHUNK)


EM_CHUNK = 700  # several chunks a sequence


@query("hmm_em_step")
def q_em_step(spark, sf_dir):
    """M5: one Baum-Welch step from the given model on each whole sequence, as Spark stages over time chunks."""
    return _em_columns(_em_from(features(spark, sf_dir), GIVEN, [GIVEN_FEATURE], 1), 1)


@query("hmm_em_steps_3")
def q_em_steps_3(spark, sf_dir):
    """M5: three steps with two features and full covariances."""
    return _em_columns(_em_from(features(spark, sf_dir), GIVEN_2D, ["vol_5", "market_vola"], 3), 2)


@query("best_score")
def q_best_score(spark, sf_dir):
    return rounded(plain_result(spark, sf_dir).best_score())


# chunk-parallel decode of long sequences: same results as the one-task decode (checked with the same oracles)
CHUNK_LEN = 97


@query("hmm_viterbi_chunked")
def q_viterbi_chunked(spark, sf_dir):
    from regimekit.plans.chunked import decode_chunked

    _, seq, models, _ = given_decode(spark, sf_dir)
    return decode_chunked(seq, models, chunk_len=CHUNK_LEN).select("entity", "ts", "raw_state")


@query("hmm_posterior_chunked")
def q_posterior_chunked(spark, sf_dir):
    from regimekit.plans.chunked import decode_chunked

    _, seq, models, _ = given_decode(spark, sf_dir)
    st = decode_chunked(seq, models, chunk_len=CHUNK_LEN)
    return rounded(st.select("entity", "ts", F.col("posterior")[0].alias("post_0"), F.col("posterior")[1].alias("post_1")))


@query("hmm_score_chunked")
def q_score_chunked(spark, sf_dir):
    from regimekit.plans.chunked import decode_chunked

    _, seq, models, _ = given_decode(spark, sf_dir)
    st = decode_chunked(seq, models, chunk_len=CHUNK_LEN)
    return st.groupBy("entity").agg(
        F.round(F.first("loglik"), LL_DIGITS).alias("loglik"), F.count("*").cast("bigint").alias("n")
    )


# Layer-1 model of the oracle-checked layered decode: input [vol_5, posterior_0, posterior_1].
GIVEN_LAYER1 = GivenModel(
    startprob=(0.5, 0.5),
    transmat=((0.9, 0.1), (0.1, 0.9)),
    means=((0.0, 0.8, 0.2), (1.0, 0.2, 0.8)),
    covars=(((1.0, 0.0, 0.0), (0.0, 0.1, 0.0), (0.0, 0.0, 0.1)), ((2.0, 0.0, 0.0), (0.0, 0.1, 0.0), (0.0, 0.0, 0.1))),
)


@query("layered_decode")
def q_layered_decode(spark, sf_dir):
    """Decode both layers with given models (layer 1 sees vol_5 ++ layer-0 posterior), relabel each."""
    from regimekit.params import LayerParams
    from regimekit.session import cut_lineage

    feats = cut_lineage(features(spark, sf_dir), "features")
    models = attach_model(feats, GIVEN).withColumn("layer", F.lit("regime_layer0")).unionByName(
        attach_model(feats, GIVEN_LAYER1).withColumn("layer", F.lit("regime_layer1"))
    )
    lm = LayeredModel([GIVEN_FEATURE], LayeredParams(layers=(LayerParams(2, 2), LayerParams(2, 2))))
    return lm.decode(feats, models).states.select("entity", "ts", "layer", "raw_state", "state")


# Sub-model of top state 0 for the oracle-checked hierarchical decode (top state 1 gets none -> NULL).
GIVEN_SUB0 = GivenModel(
    startprob=(0.3, 0.7),
    transmat=((0.5, 0.5), (0.5, 0.5)),
    means=((-0.8,), (0.0,)),
    covars=(((0.2,),), ((0.6,),)),
)


@query("hierarchical_decode")
def q_hierarchical_decode(spark, sf_dir):
    """Top Viterbi with the given model, then row-wise sub states; NULL where no sub-model."""
    from regimekit.session import cut_lineage

    feats = cut_lineage(features(spark, sf_dir), "features")
    top = attach_model(feats, GIVEN).withColumn("layer", F.lit("top_level_state")).withColumn(
        "top_state", F.lit(None).cast("int")
    )
    sub = attach_model(feats, GIVEN_SUB0).withColumn("layer", F.lit("sub_level_state")).withColumn(
        "top_state", F.lit(0)
    )
    hm = HierarchicalModel([GIVEN_FEATURE])
    return hm.decode(feats, top.unionByName(sub)).states.select("entity", "ts", "layer", "state")


# Second candidate of the oracle-checked selection (seed 1); the first is GIVEN (seed 0).
GIVEN_B = GivenModel(
    startprob=(0.5, 0.5),
    transmat=((0.9, 0.1), (0.1, 0.9)),
    means=((-1.0,), (0.5,)),
    covars=(((0.3,),), ((3.0,),)),
)


@query("select_best_given")
def q_select_best_given(spark, sf_dir):
    """A17 + E1: score candidate models (log-likelihood per step + 4 x usage entropy) and pick the best."""
    fits = _candidates(spark, sf_dir, H.entropy_score(4.0))
    return rounded(H.select_best(fits).select("entity", F.col("k").cast("int"), F.col("seed").cast("int"), "score"))


# ---------------------------------------------------------------- two-dimensional emissions, layers, sinks, failures


GIVEN_2D = GivenModel(
    startprob=(0.5, 0.5),
    transmat=((0.9, 0.1), (0.1, 0.9)),
    means=((-0.5, 0.0), (1.0, 0.5)),
    covars=(((0.5, 0.2), (0.2, 1.0)), ((2.0, -0.3), (-0.3, 1.5))),
)


@query("emission_logpdf_2d")
def q_emission_2d(spark, sf_dir):
    """M1 with an off-diagonal covariance on (vol_5, market_vola)."""
    feats = features(spark, sf_dir)
    j = H.sequences(feats, ["vol_5", "market_vola"]).join(HX.with_precision(attach_model(feats, GIVEN_2D)), "entity")
    lb = HX.emission_logpdf(F.col("x"), F.col("means"), F.col("inv_chol"), F.col("logdet"))
    return rounded(j.select("entity", "ts", lb[0].alias("lb_0"), lb[1].alias("lb_1")))


def layered_table(spark, sf_dir) -> DataFrame:
    """The labelled table of two layers in long form: the decoded path, and the row-wise states."""
    from regimekit.session import cut_lineage

    feats, seq, models, states = given_decode(spark, sf_dir)
    rel = H.relabel(states, seq, models).select("entity", "ts", "state", F.lit("regime_layer0").alias("layer"))
    pm = HX.with_precision(models)
    one = HX.rowwise_state(F.col("x"), F.col("startprob"), F.col("means"), F.col("inv_chol"), F.col("logdet"))
    row = seq.join(pm, "entity").select("entity", "ts", one.cast("int").alias("state"), F.lit("sub_level_state").alias("layer"))
    return cut_lineage(feats.join(rel.unionByName(row), ["entity", "ts"]), "layered-table")


@query("layer_return_means")
def q_layer_return_means(spark, sf_dir):
    return rounded(AN.regime_return_means(layered_table(spark, sf_dir)))


@query("layer_regime_capture")
def q_layer_capture(spark, sf_dir):
    return rounded(AN.regime_capture(layered_table(spark, sf_dir)))


@query("layer_feature_means")
def q_layer_feature_means(spark, sf_dir):
    return rounded(AN.feature_means(layered_table(spark, sf_dir)))


@query("features_windows_3_7")
def q_features_windows(spark, sf_dir):
    return rounded(features(spark, sf_dir, MAIN_PANEL, FeatureParams(vol_windows=(3, 7))))


@query("vol_quantiles_windows_3_7")
def q_quantiles_windows(spark, sf_dir):
    """A4 over the measures that the table has."""
    return rounded(AN.vol_quantiles(features(spark, sf_dir, MAIN_PANEL, FeatureParams(vol_windows=(3, 7)))))


@query("series_with_spikes")
def q_series_with_spikes(spark, sf_dir):
    return rounded(AN.series_with_spikes(features(spark, sf_dir)))


def _folder(spark, name: str) -> str:
    import uuid

    from regimekit.session import checkpoint_path

    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")


@query("roundtrip_panel")
def q_roundtrip_panel(spark, sf_dir):
    """Write the panel, read two entities back."""
    from regimekit.sources import tables as TB

    path = _folder(spark, "panel")
    TB.write_panel(panel(spark, sf_dir), path)
    return rounded(TB.read_panel(spark, path, ["A", "R"]))


@query("roundtrip_state_labeled")
def q_roundtrip_state_labeled(spark, sf_dir):
    """The state-labelled table as CSV, with other windows than the usual ones."""
    from regimekit.sources import tables as TB

    feats = features(spark, sf_dir, MAIN_PANEL, FeatureParams(vol_windows=(3, 7)))
    states = given_decode(spark, sf_dir)[3].select("entity", "ts", F.col("raw_state").alias("regime_layer0"))
    path = _folder(spark, "state-labeled")
    TB.write_state_labeled(feats.join(states, ["entity", "ts"], "left"), path, "csv")
    return rounded(TB.read_state_labeled(spark, path, "csv").drop("entity_dir"))


@query("roundtrip_models")
def q_roundtrip_models(spark, sf_dir):
    """Save the given models of both layers under a fingerprint, load them, list their transitions."""
    from regimekit.functions.scalar import layer_from_label
    from regimekit.sources import tables as TB

    feats = features(spark, sf_dir)
    models = attach_model(feats, GIVEN).withColumn("layer", F.lit("regime_layer0")).unionByName(
        attach_model(feats, GIVEN_LAYER1).withColumn("layer", F.lit("regime_layer1"))
    )
    path = _folder(spark, "models")
    TB.save_models(models, path, "key")
    back = TB.load_models(spark, path, "key")
    t = H.transitions(back, ["entity", "layer"])
    return rounded(t.select("entity", layer_from_label("layer").alias("layer_idx"), "from_state", "to_state", "prob"))


@query("fit_failures")
def q_fit_failures(spark, sf_dir):
    """M8: of two restarts one starts from an indefinite covariance; only that one fails, for every entity."""
    feats = features(spark, sf_dir)
    broken = GivenModel(GIVEN_2D.startprob, GIVEN_2D.transmat, GIVEN_2D.means, (((1.0, 2.0), (2.0, 1.0)), ((1.0, 0.0), (0.0, 1.0))))
    fit = FitParams(max_iter=3, min_rows=1, n_restarts=2)
    seq = H.sequences(feats, ["vol_5", "market_vola"], fit)
    init = attach_model(feats, GIVEN_2D).withColumn("seed", F.lit(0)).unionByName(attach_model(feats, broken).withColumn("seed", F.lit(1)))
    init = init.select("entity", "k", "seed", F.lit(0).alias("chunk"), "startprob", "transmat", "means", "covars")
    fits = H.fit_from_init(seq, init, fit)
    return fits.select("entity", "seed", (F.col("status") == "failed").alias("failed"), F.col("train_loglik").isNull().alias("no_loglik"))


def _candidates(spark, sf_dir, metric) -> DataFrame:
    """The two candidate models of every entity with their score."""
    from regimekit.session import cut_lineage

    feats = cut_lineage(features(spark, sf_dir), "features")
    seq = H.sequences(feats, [GIVEN_FEATURE])
    frames = []
    for seed, model in ((0, GIVEN), (1, GIVEN_B)):
        models = attach_model(feats, model).withColumn("seed", F.lit(seed))
        states = H.decode(seq, models)
        ent = H.state_entropy(H.state_usage(states, models, state_col="raw_state"))
        ll = states.groupBy("entity").agg(F.first("loglik").alias("val_loglik"), F.count("*").alias("n_val"))
        frames.append(
            ll.join(ent, "entity").select(
                "entity", "val_loglik", "n_val", F.col("entropy").alias("val_entropy"),
                F.lit(model.k).alias("k"), F.lit(seed).alias("seed"), F.lit(1).alias("d"),
                F.lit("converged").alias("status"),
            )
        )
    return H.with_score(frames[0].unionByName(frames[1]), metric)


@query("best_score_given")
def q_best_score_given(spark, sf_dir):
    """The best score over the candidates."""
    return rounded(H.best_score(_candidates(spark, sf_dir, H.entropy_score(4.0))))


@query("select_best_neg_bic")
def q_select_neg_bic(spark, sf_dir):
    """Selection by another metric, the negated BIC."""
    best = H.select_best(_candidates(spark, sf_dir, H.neg_bic))
    return best.select("entity", F.col("seed").cast("int"), F.round("score", LL_DIGITS).alias("score"))


@query("manager_reuse")
def q_manager_reuse(spark, sf_dir):
    """The multi-entity driver finds models saved for these data, labels every entity and writes the table."""
    from regimekit.params import LayerParams
    from regimekit.plans.manager import RegimeManager
    from regimekit.session import cut_lineage
    from regimekit.sources import tables as TB

    feats = cut_lineage(features(spark, sf_dir), "features")
    models = attach_model(feats, GIVEN).withColumn("layer", F.lit("regime_layer0")).unionByName(
        attach_model(feats, GIVEN_LAYER1).withColumn("layer", F.lit("regime_layer1"))
    )
    store, out = _folder(spark, "store"), _folder(spark, "results")
    variant = LayeredModel([GIVEN_FEATURE], LayeredParams(layers=(LayerParams(2, 2), LayerParams(2, 2))))
    manager = RegimeManager(variant, store, out)
    TB.save_models(models, store, manager.model_key(feats))
    manager.train_all(feats)
    back = TB.read_state_labeled(spark, f"{out}/state_labeled")
    return rounded(back.select("entity", "ts", "normalized_returns", "regime_layer0", "regime_layer1"))


@query("train_val_split_custom")
def q_split_custom(spark, sf_dir):
    """A splitter of the user's own in place of the default one: every tenth step is held out."""
    from regimekit.plans.variants import _split

    def tenth(seq: DataFrame) -> DataFrame:
        return seq.withColumn("split", F.when(F.col("t") % 10 == 0, "validate").otherwise("train"))

    seq = _split(H.sequences(features(spark, sf_dir), [GIVEN_FEATURE]), tenth)
    return seq.groupBy("entity", "split").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


# ---------------------------------------------------------------- transition files, cache, model store, wide source, open registry


# Regimes cut from vol_5 at these values: matrices of 2, 3 and 4 states side by side.
RAGGED = {"A": (0.0,), "N": (-0.5, 0.5), "R": (-1.0, 0.0, 1.0), "^MKT": (0.0,)}


@query("roundtrip_transitions")
def q_roundtrip_transitions(spark, sf_dir):
    """Matrices of different sizes and of two layers, written and read again."""
    from regimekit.operators.chunks import month
    from regimekit.sources import tables as TB

    feats = features(spark, sf_dir)
    state = F.coalesce(*[F.when(F.col("entity") == e, sum((F.col("vol_5") >= c).cast("int") for c in cuts)) for e, cuts in RAGGED.items()])
    layers = F.array(F.struct(F.lit(0).alias("layer_idx"), state.alias("raw_state")), F.struct(F.lit(1).alias("layer_idx"), (F.col("normalized_returns") >= 0).cast("int").alias("raw_state")))
    states = feats.select("entity", "ts", F.explode(layers).alias("x")).select("entity", "ts", "x.*")
    steps = H.numbered(states, ["entity", "layer_idx"], month("ts"), [F.col("ts")], "t")
    path = _folder(spark, "transitions")
    TB.write_transition_csv(H.path_transitions(steps, ["entity", "layer_idx"]), path)
    return rounded(TB.read_transition_csv(spark, path))


@query("cache_refill")
def q_cache_refill(spark, sf_dir):
    """A cache filled for two entities, then for more entities and months; the second call adds what is missing."""
    from regimekit.sources import panel_store as PS

    def source(pairs, first, last):
        return src.price_panel(spark, sf_dir, MAIN_PANEL, between=(first, last))

    path = _folder(spark, "cache")
    PS.refill(spark, path, PS.months_of(["A", "R"], "1996-01-01", "1997-06-01", spark), source)
    PS.refill(spark, path, PS.months_of(["A", "N", "R", "X", "^MKT"], "1996-10-01", "1998-03-01", spark), source)
    return rounded(PS.read(spark, path))


@query("threshold_regimes")
def q_threshold_regimes(spark, sf_dir):
    """A registered model class without a hidden chain, run by the multi-entity driver."""
    from regimekit.plans.manager import RegimeManager
    from regimekit.plans.variants import variant

    return RegimeManager(variant("threshold", feature="vol_20", cuts=(0.5, 0.9))).train_all(features(spark, sf_dir)).states


@query("threshold_transitions")
def q_threshold_transitions(spark, sf_dir):
    """The transitions of that model class."""
    from regimekit.plans.variants import variant

    return rounded(variant("threshold", feature="vol_20", cuts=(0.5, 0.9)).fit(features(spark, sf_dir)).transitions)


@query("manager_refresh")
def q_manager_refresh(spark, sf_dir):
    """The rows of two of four entities change; only these are fitted again, and saving twice adds nothing."""
    from regimekit.plans.manager import RegimeManager
    from regimekit.plans.variants import variant
    from regimekit.session import cut_lineage
    from regimekit.sources import tables as TB

    before = cut_lineage(features(spark, sf_dir), "features")
    after = before.withColumn("vol_5", F.when(F.col("entity").isin("A", "R"), 2 * F.col("vol_5")).otherwise(F.col("vol_5")))
    store = _folder(spark, "store")
    manager = RegimeManager(variant("threshold", feature="vol_5", cuts=(0.5, 0.9)), store)
    manager.train_all(before)
    result = manager.train_all(after)
    TB.save_models(result.models, store, manager.model_key(after))  # a repeated save
    valid = TB.load_models(spark, store, manager.model_key(after))
    fitted = spark.read.parquet(f"{store}/batches").groupBy("entity").agg(F.count("*").alias("n_models"))
    return rounded(valid.join(fitted, "entity").select("entity", "n_models", F.col("thresholds")[0].alias("low"), F.col("thresholds")[1].alias("high")))


@query("wide_source")
def q_wide_source(spark, sf_dir):
    """Yearly prices of every part as a CSV with a column per part, read back long."""
    from regimekit.sources import wide

    obs = src.observations(spark, sf_dir, src.PanelSpec("lineitem", "l_partkey", "l_shipdate", "l_extendedprice", "year"))
    bars = src.price_bars(obs.withColumn("entity", F.concat(F.lit("P"), F.col("entity").cast("string"))), "year")
    path = _folder(spark, "wide")
    wide.write_wide_prices(bars, path)
    return rounded(wide.read_wide_prices(spark, path))
