"""Model store (S9): models per entity under a key of their data and configuration, written once.

``<path>/batches/batch=<id>`` holds the models of one save and ``<path>/manifest/<id>`` names the entities and keys in it.
The manifest is written last: what a failed or repeated attempt left behind is in no manifest and is never read.  Where two
saves hold the same entity and key, the least batch counts.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimekit.operators.chunks import with_rows_of


def fingerprint(config: object, data_tag: str = "") -> str:
    """Stable key for (configuration, data) so saved models are only reused for the same inputs."""
    blob = json.dumps(config, default=lambda o: getattr(o, "__dict__", str(o)), sort_keys=True) + "|" + data_tag
    return hashlib.sha256(blob.encode()).hexdigest()[:16]


def entity_keys(features: DataFrame, config: object) -> DataFrame:
    """``entity, key``: the configuration, the row count and an order-independent sum of the row hashes of each entity."""
    row = F.xxhash64(*[F.col(c) for c in sorted(features.columns)]).cast("decimal(38,0)")
    each = features.groupBy("entity").agg(F.count("*").alias("n"), F.sum(row).alias("h"))
    return each.select("entity", F.sha2(F.concat_ws(":", F.lit(fingerprint(config)), F.col("n").cast("string"), F.col("h").cast("string")), 256).substr(1, 16).alias("key"))


def _read(spark: SparkSession, path: str, merge: bool = False) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", merge).option("recursiveFileLookup", not merge).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None  # nothing saved yet; any other error is the caller's to see
        raise


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """``entity, fingerprint, batch`` of all valid models."""
    rows = _read(spark, f"{path}/manifest")
    return None if rows is None else rows.groupBy("entity", "fingerprint").agg(F.min("batch").alias("batch"))


def _keyed(entities: DataFrame, keys: DataFrame | str) -> DataFrame:
    if isinstance(keys, str):
        return entities.select("entity").distinct().withColumn("fingerprint", F.lit(keys))
    return keys.select("entity", F.col("key").alias("fingerprint"))


def without_models(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The entities and keys that have no valid model."""
    valid = manifest(spark, path)
    return keys if valid is None else keys.join(valid, (keys.entity == valid.entity) & (keys.key == valid.fingerprint), "left_anti")


def save_models(models: DataFrame, path: str, keys: DataFrame | str) -> None:
    """Save the models of entities that have none under their key yet.  ``keys``: ``entity, key``, or one key for all."""
    spark = models.sparkSession
    valid = manifest(spark, path)
    keyed = _keyed(models, keys)
    if valid is not None:
        keyed = keyed.join(valid.select("entity", "fingerprint"), ["entity", "fingerprint"], "left_anti")
    batch = uuid.uuid4().hex
    with_rows_of(models, keyed, ["entity"], "inner").write.parquet(f"{path}/batches/batch={batch}")
    saved = spark.read.parquet(f"{path}/batches/batch={batch}")
    held = saved.groupBy("entity", "fingerprint").agg(F.count("*").alias("n_models")).withColumn("batch", F.lit(batch))
    if not held.isEmpty():
        held.write.parquet(f"{path}/manifest/{batch}")


def load_models(spark: SparkSession, path: str, keys: DataFrame | str) -> DataFrame | None:
    """The valid models under ``keys``, with their ``fingerprint``; ``None`` when there are none (the caller fits instead)."""
    valid = manifest(spark, path)
    if valid is None:
        return None
    if isinstance(keys, str):
        wanted = valid.where(F.col("fingerprint") == keys)
    else:
        wanted = valid.join(_keyed(keys, keys), ["entity", "fingerprint"], "left_semi")
    if wanted.isEmpty():
        return None
    rows = _read(spark, f"{path}/batches", merge=True)
    return rows.join(wanted, ["entity", "fingerprint", "batch"], "left_semi").drop("batch")
