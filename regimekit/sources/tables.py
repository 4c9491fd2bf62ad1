"""Result tables: writers and readers of panels and state-labelled tables (S4-S6), and the names of S7-S9.

All sinks are partitioned parquet, or CSV; nothing is collected to the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimekit.functions.scalar import sanitize_entity
from regimekit.operators.chunks import with_rows_of
from regimekit.sources.model_store import entity_keys, fingerprint, load_models, save_models  # noqa: F401 - S9
from regimekit.sources.transitions import read_transition_csv, row_sums, write_transition_csv  # noqa: F401 - S7, S8

# ---------------------------------------------------------------- S4: panel cache


def write_panel(prices: DataFrame, path: str) -> None:
    """Persist a price panel; rows of one entity are stored together and in time order."""
    (
        prices.repartition("entity")
        .sortWithinPartitions("entity", "ts")
        .write.mode("overwrite")
        .parquet(path)
    )


def read_panel(spark: SparkSession, path: str, entities: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("entity").isin(entities)) if entities else df


# ---------------------------------------------------------------- S5/S6: state-labelled table


ROWS_PER_FILE = 1_000_000


def write_state_labeled(labeled: DataFrame, path: str, fmt: str = "parquet", rows_per_file: int = ROWS_PER_FILE) -> None:
    """One folder per (sanitised) entity, like the reference's ``csvs/<ticker>/``.

    The rows of each entity are counted first: a large entity is dealt over as many files of about ``rows_per_file`` rows as
    it needs, each a unit of its own in the shuffle; many small ones share a task.
    """
    out = labeled.withColumn("entity_dir", sanitize_entity("entity"))
    parts = out.groupBy("entity_dir").agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("_parts"))
    out = with_rows_of(out, parts, ["entity_dir"], "inner").withColumn("_part", F.pmod(F.xxhash64("ts"), F.col("_parts")).cast("int"))
    n = int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = out.repartition(n, "entity_dir", "_part").sortWithinPartitions("entity_dir", "_part", "ts")
    writer = dealt.drop("_parts", "_part").write.mode("overwrite").option("maxRecordsPerFile", 2 * rows_per_file).partitionBy("entity_dir")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


STATE_COLUMN = r"regime_layer\d+|(top|sub)_level_state|state"


def read_state_labeled(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read back with types: ``ts`` is a timestamp, states are INT, names are strings, all else is DOUBLE.

    The columns are those of the file's header, so any volatility windows and layers come back under their names.
    """
    if fmt != "csv":
        return spark.read.parquet(path)
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)

    def typed(name: str):
        if name in ("entity", "entity_dir"):
            return F.col(name).cast("string")
        if name == "ts":
            return F.to_timestamp_ntz(name).alias(name)
        return F.col(name).cast("int" if re.fullmatch(STATE_COLUMN, name) else "double")

    return raw.select(*[typed(c) for c in raw.columns])
