"""Panel cache that is filled up (S4, U2): prices by month and bucket of entities, and what has been asked for.

``<path>/rows/month=…/bucket=…`` holds the prices and ``<path>/known`` the (entity, month) pairs that are in it, also those for
which the source had no row.  A refill computes only the pairs that aren't known, replaces the month folders it
touches by dynamic partition overwrite (Spark swaps them in when the job commits, so an interrupted refill
leaves the old rows) and names the pairs as known last.  Running it again after a failure does the same work once more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimekit.operators.chunks import month
from regimekit.session import cut_lineage

BUCKETS = 16  # folders of a month; the entities of a bucket share files

ROWS = "entity STRING, ts TIMESTAMP_NTZ, price DOUBLE, month DATE, bucket INT"
KNOWN = "entity STRING, month DATE"

#: prices of the wanted pairs (and maybe others): (pairs, first month, last month) -> (entity, ts, price)
Source = Callable[[DataFrame, "object", "object"], DataFrame]


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def known_pairs(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, f"{path}/known", KNOWN).distinct()


def missing_pairs(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """U2 on the cache: wanted (entity, month) pairs that it doesn't know."""
    return wanted.select("entity", "month").distinct().join(known_pairs(spark, path), ["entity", "month"], "left_anti")


def refill(spark: SparkSession, path: str, wanted: DataFrame, source: Source, refresh: DataFrame | None = None, buckets: int = BUCKETS) -> int:
    """Compute the wanted pairs that are missing, and those of ``refresh`` again; the number of pairs computed.

    ``source`` gets the pairs and their first and last month, so that its scan can be limited to these months.  A store
    keeps the number of ``buckets`` it was begun with.
    """
    todo = missing_pairs(spark, path, wanted)
    if refresh is not None:
        todo = todo.unionByName(refresh.select("entity", "month")).distinct()
    todo = cut_lineage(todo, "cache-todo")
    n, first, last = todo.agg(F.count("*"), F.min("month"), F.max("month")).first()
    if n == 0:
        return 0
    bucket = F.pmod(F.xxhash64("entity"), F.lit(buckets)).cast("int")
    new = source(todo, first, last).select("entity", "ts", "price", month("ts").alias("month"))
    new = new.join(todo, ["entity", "month"], "left_semi").withColumn("bucket", bucket)
    touched = todo.select("month", bucket.alias("bucket")).distinct()
    old = _stored(spark, f"{path}/rows", ROWS).where(F.col("month").between(F.lit(first), F.lit(last)))
    kept = old.join(touched, ["month", "bucket"], "left_semi").join(todo, ["entity", "month"], "left_anti")
    both = cut_lineage(new.unionByName(kept), "cache-rows")
    dealt = both.repartition("month", "bucket").sortWithinPartitions("month", "bucket", "entity", "ts")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "bucket").parquet(f"{path}/rows")
    todo.coalesce(1).write.mode("append").parquet(f"{path}/known")
    return n


def read(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Prices of the cache, or of the wanted pairs in it; rows of pairs that no finished refill named are left out."""
    rows = _stored(spark, f"{path}/rows", ROWS).join(known_pairs(spark, path), ["entity", "month"], "left_semi")
    if wanted is not None:
        rows = rows.join(wanted.select("entity", "month").distinct(), ["entity", "month"], "left_semi")
    return rows.select("entity", "ts", "price")


def months_of(entities: list[str], first: str, last: str, spark: SparkSession) -> DataFrame:
    """The pairs of some entities and all months from ``first`` to ``last``."""
    one = spark.range(1).select(F.explode(F.array(*[F.lit(e) for e in entities])).alias("entity"))
    return one.select("entity", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month"))
