"""Native Spark expressions for Gaussian HMM pieces that need no recursion over time.

* ``emission_logpdf`` (M1): log N(x; mu_k, Sigma_k) for every state, evaluated
  row by row inside whole-stage codegen from array columns of the model.
  Full covariances enter through the inverse Cholesky factor and the log
  determinant, which ``with_precision`` adds once per model row.
* ``rowwise_state`` (M14): argmax_k of log pi_k + log b_k(x) on one row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

LOG_2PI = math.log(2.0 * math.pi)

_PREC_TYPE = T.StructType(
    [
        T.StructField("inv_chol", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))),
        T.StructField("logdet", T.ArrayType(T.DoubleType())),
    ]
)


def _precision_impl(covars: pd.Series) -> pd.DataFrame:
    inv, logdet = [], []
    for c in covars:
        cov = np.stack([np.stack(list(m)) for m in c]).astype(float)
        try:
            chol = np.linalg.cholesky(cov)
            inv.append(np.linalg.inv(chol).tolist())
            logdet.append((2.0 * np.log(np.diagonal(chol, axis1=-2, axis2=-1)).sum(axis=-1)).tolist())
        except np.linalg.LinAlgError:
            inv.append(None)
            logdet.append(None)
    return pd.DataFrame({"inv_chol": inv, "logdet": logdet})


_precision = pandas_udf(_precision_impl, _PREC_TYPE)


def with_precision(models: DataFrame) -> DataFrame:
    """Add ``inv_chol`` (K x D x D) and ``logdet`` (K) from ``covars``; runs once per model row."""
    from regimekit.session import ship_package

    ship_package(models.sparkSession)
    p = _precision(F.col("covars"))
    return models.withColumn("_prec", p).select("*", "_prec.inv_chol", "_prec.logdet").drop("_prec")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda acc, z: acc + z)


def emission_logpdf(x: Column, means: Column, inv_chol: Column, logdet: Column) -> Column:
    """Array of K log-densities of the row's observation ``x`` (full covariance)."""
    d = F.size(x).cast("double")

    def per_state(mu: Column, k: Column) -> Column:
        diff = F.zip_with(x, mu, lambda a, b: a - b)
        z = F.transform(F.element_at(inv_chol, k + 1), lambda row: _dot(row, diff))
        quad = F.aggregate(z, F.lit(0.0), lambda acc, v: acc + v * v)
        return F.lit(-0.5) * (d * F.lit(LOG_2PI) + F.element_at(logdet, k + 1) + quad)

    return F.transform(means, per_state)


def argmax(arr: Column) -> Column:
    """0-based position of the first maximum of an array."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def rowwise_state(x: Column, startprob: Column, means: Column, inv_chol: Column, logdet: Column) -> Column:
    """Single-step Viterbi = argmax_k (log pi_k + log b_k(x))."""
    lb = emission_logpdf(x, means, inv_chol, logdet)
    score = F.zip_with(lb, startprob, lambda b, p: b + F.log(p))
    return argmax(score)
