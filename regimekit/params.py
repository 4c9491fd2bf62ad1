"""Frozen parameter objects (the reference keeps these in YAML files)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PanelSpec:
    """How to derive a long price panel ``(entity, ts, price)`` from a fact table.

    ``price`` is the average of ``value`` per (entity, period).  ``dim`` joins
    a dimension table to obtain the entity column: ``(table, fact_key, dim_key)``.
    """

    table: str
    entity: str
    ts: str
    value: str
    period: str
    dim: tuple[str, str, str] | None = None
    proxy: str = "^MKT"


@dataclass(frozen=True)
class FeatureParams:
    """Feature-build settings (data config of the reference)."""

    vol_windows: tuple[int, ...] = (5, 10, 20)
    vol_norm: str = "zscore"  # zscore | minmax | log | none
    proxy_mode: str = "zscore"  # raw | smoothed | returns | zscore
    proxy_window: int = 5
    start: str | None = None  # inclusive, e.g. "2020-01-01"
    end: str | None = None  # inclusive
    model_proxy: bool = True  # the proxy entity gets features (and models) too

    @property
    def feature_columns(self) -> list[str]:
        return ["normalized_returns", *[f"vol_{w}" for w in self.vol_windows], "market_vola"]


@dataclass(frozen=True)
class FitParams:
    """One grid of Gaussian HMM fits: K in [min_k, max_k] x seeds 0..n_restarts-1."""

    min_k: int = 2
    max_k: int = 2
    n_restarts: int = 100
    max_iter: int = 100
    tol: float = 1e-4
    covariance_type: str = "full"  # full | diag
    # letters of the parameters EM estimates: s(tart), t(ransitions), m(eans), c(ovariances);
    # the others keep their deterministic start values
    init_params: str = "stmc"
    min_covar: float = 1e-3
    train_ratio: float = 0.8
    shuffle: bool = False
    split_seed: int = 13
    entropy_weight: float = 4.0
    min_rows: int = 20
    seeds_per_task: int = 25  # restarts of one sequence and K that share a task
    # "grouped": one task fits one sequence, for many sequences that each fit a task;
    # "stages": every EM round is a Spark pass over time chunks (plans/em.py), for sequences of any length
    engine: str = "grouped"
    chunk_len: int = 10_000  # steps a task holds with "stages"
    split: str = "chronological"  # chronological | all (in-sample, used by sub-models)


@dataclass(frozen=True)
class LayerParams:
    min_k: int
    max_k: int
    covariance_type: str = "full"
    init_params: str = "stmc"


@dataclass(frozen=True)
class LayeredParams:
    layers: tuple[LayerParams, ...] = (LayerParams(2, 4), LayerParams(2, 2))
    fit: FitParams = field(default_factory=FitParams)


@dataclass(frozen=True)
class HierarchicalParams:
    top: LayerParams = LayerParams(2, 3)
    sub: LayerParams = LayerParams(2, 3)
    fit: FitParams = field(default_factory=FitParams)
    min_sub_rows: int = 10
