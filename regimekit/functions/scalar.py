"""Scalar column functions F1-F11."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sanitize_entity(name: Column | str) -> Column:
    """drop ``^`` and turn ``/`` into ``_`` (one rule for file names and labels)."""
    return F.replace(F.replace(_c(name), F.lit("^"), F.lit("")), F.lit("/"), F.lit("_"))


def state_label(layer: Column | str | int, state: Column | str) -> Column:
    """``VS{layer}_{state}``."""
    layer_col = F.lit(layer) if isinstance(layer, int) else _c(layer)
    return F.concat(F.lit("VS"), layer_col.cast("string"), F.lit("_"), _c(state).cast("string"))


def layer_from_label(label: Column | str) -> Column:
    """trailing digits of a column/label name, e.g. ``regime_layer1`` -> 1."""
    return F.regexp_extract(_c(label), r"(\d+)$", 1).cast("int")


def expected_steps(p_stay: Column | str) -> Column:
    """expected run length of a state with self-transition ``p``: 1/(1-p+1e-10)."""
    return F.lit(1.0) / (F.lit(1.0) - _c(p_stay) + F.lit(1e-10))


def palette_index(state: Column | str) -> Column:
    """colour slot of a state, ``state mod 10``."""
    return F.pmod(_c(state), F.lit(10))


def safe_log_ratio(num: Column, den: Column) -> Column:
    """``ln(num/den)``; NULL (not -inf/NaN) when a price is zero or negative."""
    ratio = F.try_divide(num, den)
    return F.when(ratio > 0, F.log(ratio))
