"""regimekit: regime analytics of long time-series panels on Spark.

Every public operator is a function ``DataFrame -> DataFrame`` built from
Spark SQL expressions, windows, joins and aggregates.  Model fitting and
sequence decoding run as Arrow-batched grouped pandas functions where the
recursion over time cannot be expressed as a columnar expression.
"""

from regimekit.params import (  # noqa: F401
    FeatureParams,
    FitParams,
    HierarchicalParams,
    LayerParams,
    LayeredParams,
    PanelSpec,
)

__all__ = [
    "FeatureParams",
    "FitParams",
    "HierarchicalParams",
    "LayerParams",
    "LayeredParams",
    "PanelSpec",
]
