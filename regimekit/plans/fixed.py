"""Models with given parameters (no fitting), attached to every sequence of a table.

Used to decode and analyse with a known model, and to check the decode and
analytics operators against an SQL oracle independently of EM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GivenModel:
    startprob: tuple[float, ...]
    transmat: tuple[tuple[float, ...], ...]
    means: tuple[tuple[float, ...], ...]
    covars: tuple[tuple[tuple[float, ...], ...], ...]

    @property
    def k(self) -> int:
        return len(self.startprob)


def _lit(v):
    if isinstance(v, (tuple, list)):
        return F.array(*[_lit(x) for x in v])
    return F.lit(float(v))


def attach_model(seq_keys: DataFrame, model: GivenModel, keys: list[str] = ("entity",)) -> DataFrame:
    """One model row per distinct sequence key (parameters as literal array columns)."""
    keys = list(keys)
    return seq_keys.select(*keys).distinct().select(
        *keys,
        F.lit(model.k).cast("int").alias("k"),
        F.lit(0).cast("int").alias("seed"),
        _lit(model.startprob).alias("startprob"),
        _lit(model.transmat).alias("transmat"),
        _lit(model.means).alias("means"),
        _lit(model.covars).alias("covars"),
    )
