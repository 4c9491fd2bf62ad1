"""Model variants (X3): plain, layered and hierarchical regime models.

Each variant is a small class with ``fit(features) -> RegimeResult``; the
result holds DataFrames only (fits, chosen models, long states, transitions).
Stages are separated by reliable checkpoints so a lost executor recomputes
from the last stage, not from the raw scan.

Long states table: ``entity, ts, layer STRING, raw_state INT, state INT``
with layers ``regime_layer{i}`` (plain/layered) or ``top_level_state`` and
``sub_level_state`` (hierarchical); pivot to the reference's wide columns
only at the sink (``state_labeled``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimekit.functions import hmm_expr as HX
from regimekit.params import FitParams, HierarchicalParams, LayeredParams, LayerParams
from regimekit.plans import hmm as H
from regimekit.session import cut_lineage


@dataclass
class RegimeResult:
    variant: str
    fits: DataFrame | None  # every (entity, layer, K, seed) restart; None when models were reused
    models: DataFrame  # chosen model per (entity, layer[, top_state])
    states: DataFrame  # long states
    transitions: DataFrame  # (entity, layer, from_state, to_state, prob), raw state order

    def expected_steps(self) -> DataFrame:
        return H.expected_steps_of(self.transitions, ["entity", "layer"])

    def best_score(self) -> DataFrame:
        """Best score over layers / sub-models per entity."""
        return self.models.groupBy("entity").agg(F.max("score").alias("best_score"))


def _layer_fit(fit: FitParams, layer: LayerParams) -> FitParams:
    return replace(fit, min_k=layer.min_k, max_k=layer.max_k, covariance_type=layer.covariance_type,
                   init_params=layer.init_params)


def _fit_select(seq: DataFrame, fit: FitParams, metric, keys) -> tuple[DataFrame, DataFrame]:
    fits = cut_lineage(H.with_score(H.fit_grid(seq, fit, keys), metric), "fits")
    return fits, H.select_best(fits, keys)


Splitter = Callable[[DataFrame], DataFrame]  # X2: sequences -> sequences with a ``split`` column


def _split(seq: DataFrame, splitter: Splitter | None) -> DataFrame:
    return splitter(seq) if splitter is not None else seq


def _tag(df: DataFrame, layer: str) -> DataFrame:
    return df.withColumn("layer", F.lit(layer))


def _layer_models(models: DataFrame, layer: str) -> DataFrame:
    return models.where(F.col("layer") == layer).drop("layer")


class _Variant:
    """``run(features)`` fits and decodes; ``run(features, models)`` only decodes with given models."""

    name = ""
    layers: list[str] = []

    def fit(self, features: DataFrame) -> RegimeResult:
        return self.run(features)

    def decode(self, features: DataFrame, models: DataFrame) -> RegimeResult:
        return self.run(features, models)

    def run(self, features: DataFrame, models: DataFrame | None = None) -> RegimeResult:  # pragma: no cover
        raise NotImplementedError


class PlainModel(_Variant):
    """M9: one Gaussian HMM per entity chosen over K x restarts; states relabelled by volatility."""

    name = "plain"
    layers = ["regime_layer0"]

    def __init__(self, feature_cols: list[str], fit: FitParams = FitParams(), metric=None, splitter: Splitter | None = None):
        self.cols, self.fit_params, self.splitter = list(feature_cols), fit, splitter
        self.metric = metric or H.entropy_score(fit.entropy_weight)

    def config(self) -> dict:
        return {"variant": self.name, "cols": self.cols, "fit": self.fit_params}

    def run(self, features: DataFrame, models: DataFrame | None = None) -> RegimeResult:
        layer = self.layers[0]
        seq = cut_lineage(_split(H.sequences(features, self.cols, self.fit_params), self.splitter), "seq")
        fits = None
        if models is None:
            fits, best = _fit_select(seq, self.fit_params, self.metric, ["entity"])
            fits = _tag(fits, layer)
        else:
            best = _layer_models(models, layer)
        decoded = H.decode(seq, best, with_posterior=False)
        states = H.relabel(decoded, seq, best).select("entity", "ts", "raw_state", "state")
        return RegimeResult(self.name, fits, _tag(best, layer), _tag(states, layer), _tag(H.transitions(best), layer))


class LayeredModel(_Variant):
    """Layer i+1 sees the original features plus layer i's state posteriors."""

    name = "layered"

    def __init__(self, feature_cols: list[str], params: LayeredParams = LayeredParams(), metric=None,
                 splitter: Splitter | None = None):
        self.cols, self.params, self.splitter = list(feature_cols), params, splitter
        self.metric = metric or H.entropy_score(params.fit.entropy_weight)
        self.layers = [f"regime_layer{i}" for i in range(len(params.layers))]

    def config(self) -> dict:
        return {"variant": self.name, "cols": self.cols, "params": self.params}

    def run(self, features: DataFrame, models: DataFrame | None = None) -> RegimeResult:
        base = cut_lineage(_split(H.sequences(features, self.cols, self.params.fit), self.splitter), "seq")
        seq = base
        all_fits, all_models, all_states, all_trans = [], [], [], []
        for i, layer in enumerate(self.params.layers):
            name = self.layers[i]
            last = i == len(self.params.layers) - 1
            if models is None:
                fits, best = _fit_select(seq, _layer_fit(self.params.fit, layer), self.metric, ["entity"])
                all_fits.append(_tag(fits, name))
            else:
                best = _layer_models(models, name)
            decoded = H.decode(seq, best, with_posterior=not last)
            labels = H.relabel(decoded, seq, best).select("entity", "ts", "raw_state", "state")
            all_models.append(_tag(best, name))
            all_states.append(_tag(labels, name))
            all_trans.append(_tag(H.transitions(best), name))
            if not last:
                # original features ++ posterior of this layer (not accumulated across layers)
                nxt = base.join(decoded.select("entity", "t", "posterior"), ["entity", "t"])
                seq = cut_lineage(nxt.withColumn("x", F.concat("x", "posterior")).drop("posterior"), "seq")
        fits = _union(all_fits) if all_fits else None
        return RegimeResult(self.name, fits, _union(all_models), _union(all_states), _union(all_trans))


class HierarchicalModel(_Variant):
    """Top HMM; one sub-HMM per top state on its rows; sub state decoded row by row."""

    name = "hierarchical"
    layers = ["top_level_state", "sub_level_state"]

    def __init__(self, feature_cols: list[str], params: HierarchicalParams = HierarchicalParams(), metric=None,
                 splitter: Splitter | None = None):
        self.cols, self.params, self.splitter = list(feature_cols), params, splitter
        self.metric = metric or H.entropy_score(params.fit.entropy_weight)

    def config(self) -> dict:
        return {"variant": self.name, "cols": self.cols, "params": self.params}

    def run(self, features: DataFrame, models: DataFrame | None = None) -> RegimeResult:
        p = self.params
        seq = cut_lineage(_split(H.sequences(features, self.cols, p.fit), self.splitter), "seq")
        top_fits = sub_fits = None
        if models is None:
            top_fits, top_best = _fit_select(seq, _layer_fit(p.fit, p.top), self.metric, ["entity"])
        else:
            top_best = _layer_models(models, "top_level_state").drop("top_state")
        top_states = H.decode(seq, top_best, with_posterior=False).select("entity", "ts", "t", "raw_state")
        # Rows of each top state, in time order, form one (non-contiguous) training sequence
        rows = top_states.withColumnRenamed("raw_state", "top_state").join(seq.select("entity", "t", "x"), ["entity", "t"])
        if models is None:
            sub_fit = replace(_layer_fit(p.fit, p.sub), split="all", min_rows=p.min_sub_rows)
            sub_seq = cut_lineage(H.sequences(rows, [], sub_fit, keys=["entity", "top_state"], x_col="x"), "seq")
            sub_fits, sub_best = _fit_select(sub_seq, sub_fit, self.metric, ["entity", "top_state"])
        else:
            sub_best = _layer_models(models, "sub_level_state")
        # Sub state = argmax_k(log pi_k + log b_k(x)) per row; NULL without a sub-model
        sub_models = HX.with_precision(sub_best.select("entity", "top_state", "startprob", "means", "covars"))
        labelled = rows.join(sub_models, ["entity", "top_state"], "left").select(
            "entity",
            "ts",
            "top_state",
            HX.rowwise_state(F.col("x"), F.col("startprob"), F.col("means"), F.col("inv_chol"), F.col("logdet")).alias(
                "sub_state"
            ),
        )
        states = _union(
            [
                labelled.select("entity", "ts", F.col("top_state").alias("raw_state"), F.col("top_state").alias("state"),
                                F.lit("top_level_state").alias("layer")),
                labelled.select("entity", "ts", F.col("sub_state").alias("raw_state"), F.col("sub_state").alias("state"),
                                F.lit("sub_level_state").alias("layer")),
            ]
        )
        fits = None
        if top_fits is not None:
            fits = _union([
                _tag(top_fits, "top_level_state").withColumn("top_state", F.lit(None).cast("int")),
                _tag(sub_fits, "sub_level_state"),
            ])
        chosen = _union([
            _tag(top_best, "top_level_state").withColumn("top_state", F.lit(None).cast("int")),
            _tag(sub_best, "sub_level_state"),
        ])
        return RegimeResult(self.name, fits, chosen, states, _tag(H.transitions(top_best), "top_level_state"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


class ThresholdModel(_Variant):
    """A model without a hidden chain: regimes cut from one feature at quantiles of each entity's history.

    State 0 lies below the first threshold, state 1 from there up to the second, and so on.  Rows without the feature have no state.
    An entity with fewer than ``min_rows`` known values is reported in ``fits`` as skipped and has neither model nor states.
    """

    name = "threshold"
    layers = ["regime_layer0"]

    def __init__(self, feature: str = "vol_20", cuts: tuple[float, ...] = (0.5, 0.9), min_rows: int = 20):
        self.feature, self.cuts, self.min_rows = feature, tuple(sorted(cuts)), min_rows

    def config(self) -> dict:
        return {"variant": self.name, "feature": self.feature, "cuts": self.cuts, "min_rows": self.min_rows}

    def run(self, features: DataFrame, models: DataFrame | None = None) -> RegimeResult:
        from regimekit.operators.analytics import exact_quantiles
        from regimekit.operators.chunks import known, month, with_rows_of

        fits, layer = None, self.layers[0]
        if models is None:
            fits = features.groupBy("entity").agg(F.count(known(self.feature)).alias("n_rows"))
            for i, q in enumerate(self.cuts):
                cut = exact_quantiles(features, ["entity"], [self.feature], q).select("entity", F.col("threshold").alias(f"_q{i}"))
                fits = with_rows_of(fits, cut, ["entity"])
            fits = fits.select(
                "entity",
                F.lit(layer).alias("layer"),
                F.lit(len(self.cuts) + 1).alias("k"),
                F.when(F.col("n_rows") < self.min_rows, "skipped").otherwise("ok").alias("status"),
                F.lit(None).cast("double").alias("score"),
                F.array(*[F.col(f"_q{i}") for i in range(len(self.cuts))]).alias("thresholds"),
            )
            fits = cut_lineage(fits, "fits")
            models = fits.where("status = 'ok'").drop("status")
        best = models.where(F.col("layer") == layer)
        rows = with_rows_of(features.select("entity", "ts", known(self.feature).alias("_v")), best.select("entity", "thresholds"), ["entity"], "inner")
        state = F.when(F.col("_v").isNotNull(), F.size(F.filter("thresholds", lambda t: F.col("_v") >= t)))
        states = rows.select("entity", "ts", state.alias("raw_state"), state.alias("state"), F.lit(layer).alias("layer"))
        steps = H.numbered(states.where("state is not null"), ["entity"], month("ts"), [F.col("ts")], "t")
        return RegimeResult(self.name, fits, best, states, _tag(H.path_transitions(steps), layer))


VARIANTS: dict[str, type] = {}

#: Columns that the driver, the sinks and the analytics read from a variant's tables.
CONTRACT = {
    "models": ("entity", "layer", "k"),
    "states": ("entity", "ts", "layer", "raw_state", "state"),
    "transitions": ("entity", "layer", "from_state", "to_state", "prob"),
}


def register_variant(cls: type) -> type:
    """Add a model class under its ``name``; it must have ``layers``, ``config``, ``fit`` and ``decode``."""
    lacking = [a for a in ("name", "layers", "config", "fit", "decode") if not hasattr(cls, a)]
    if lacking or not cls.name:
        raise TypeError(f"{cls.__name__} lacks {', '.join(lacking) or 'a name'}")
    if VARIANTS.get(cls.name, cls) is not cls:
        raise ValueError(f"there is a variant {cls.name!r} already")
    VARIANTS[cls.name] = cls
    return cls


def variant(name: str, *args, **kwargs):
    """A registered model class by its name."""
    if name not in VARIANTS:
        raise ValueError(f"no variant {name!r}; there are {sorted(VARIANTS)}")
    return VARIANTS[name](*args, **kwargs)


def checked(of, result: RegimeResult) -> RegimeResult:
    """The result, if its tables have the columns of the contract, and of ``fits`` a ``status`` of each attempt."""
    for table, columns in CONTRACT.items():
        lacking = [c for c in columns if c not in getattr(result, table).columns]
        if lacking:
            raise ValueError(f"variant {of.name!r}: {table} lacks {', '.join(lacking)}")
    if result.fits is not None and "status" not in result.fits.columns:
        raise ValueError(f"variant {of.name!r}: fits lacks status")
    return result


for _cls in (PlainModel, LayeredModel, HierarchicalModel, ThresholdModel):
    register_variant(_cls)


def state_labeled(features: DataFrame, states: DataFrame, layers: list[str]) -> DataFrame:
    """J2 + sink form: features with one column per layer (pivot on a known list, one pass)."""
    wide = states.groupBy("entity", "ts").pivot("layer", layers).agg(F.first("state"))
    return features.join(wide, ["entity", "ts"], "left")
