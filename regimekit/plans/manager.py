"""Multi-entity driver - train (or reuse) models for every entity, label, write results.

One lazily built DataFrame pipeline keyed by entity; there is no Python loop
over entities.  Saved models are reused per entity: an entity whose rows and configuration have a
valid model isn't fitted again, whatever happens to the others.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimekit.functions.scalar import layer_from_label
from regimekit.plans.variants import RegimeResult, checked, state_labeled
from regimekit.session import cut_lineage
from regimekit.sources import tables as TB
from regimekit.sources.model_store import without_models


class RegimeManager:
    def __init__(self, variant, model_store: str | None = None, out_dir: str | None = None, fmt: str = "parquet"):
        self.variant, self.model_store, self.out_dir, self.fmt = variant, model_store, out_dir, fmt

    def model_key(self, features: DataFrame) -> DataFrame:
        """``entity, key`` of the configuration and each entity's rows."""
        return TB.entity_keys(features, self.variant.config())

    def train_all(self, features: DataFrame) -> RegimeResult:
        result = self._with_store(features) if self.model_store else checked(self.variant, self.variant.fit(features))
        if self.out_dir:
            self.write(features, result)
        return result

    def _with_store(self, features: DataFrame) -> RegimeResult:
        spark = features.sparkSession
        keys = cut_lineage(self.model_key(features), "model-keys")
        todo = cut_lineage(without_models(spark, self.model_store, keys), "entities-to-fit")
        n_todo, n_all = todo.count(), keys.count()
        if n_todo:
            rows = features if n_todo == n_all else features.join(todo.select("entity"), "entity", "left_semi")
            result = checked(self.variant, self.variant.fit(rows))
            TB.save_models(result.models, self.model_store, keys)
            if n_todo == n_all:
                return result
        saved = TB.load_models(spark, self.model_store, keys)
        return checked(self.variant, self.variant.decode(features, saved.drop("fingerprint")))

    def write(self, features: DataFrame, result: RegimeResult) -> None:
        """S5 + S7: state-labelled table per entity and transition matrices per (entity, layer)."""
        labeled = state_labeled(features, result.states, self.variant.layers)
        TB.write_state_labeled(labeled, os.path.join(self.out_dir, "state_labeled"), self.fmt)
        trans = result.transitions.withColumn("layer_idx", F.coalesce(layer_from_label("layer"), F.lit(0)))
        TB.write_transition_csv(trans, os.path.join(self.out_dir, "transition_matrices"))
