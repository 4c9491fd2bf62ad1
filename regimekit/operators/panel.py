"""Panel-level operators: date filter (P1), complete-panel rule (P2), entity sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regimekit.functions.scalar import safe_log_ratio
from regimekit.operators.chunks import with_previous
from regimekit.session import cut_lineage

def date_filter(df: DataFrame, start: str | None = None, end: str | None = None, ts: str = "ts") -> DataFrame:
    """Inclusive ``start <= ts <= end``; either end optional.  Pushed into the parquet scan."""
    if start:
        df = df.where(F.col(ts) >= F.to_timestamp_ntz(F.lit(start)))
    if end:
        df = df.where(F.col(ts) <= F.to_timestamp_ntz(F.lit(end)))
    return df


def entity_count(prices: DataFrame) -> "F.Column":
    """Number of entities of the panel, as a scalar subquery."""
    return prices.agg(F.count_distinct("entity")).scalar()


def valid_price(price: str = "price") -> "F.Column":
    """A price that has a logarithm; everything else counts as missing."""
    return F.coalesce(F.col(price) > 0, F.lit(False)) & ~F.isnan(F.coalesce(F.col(price), F.lit(0.0)))


def with_prev(prices: DataFrame) -> DataFrame:
    """Add each entity's previous row (its timestamp and whether both prices are valid) and the log return.

    The row before is looked for among all rows, also those without a valid price: such a row is a calendar date all the same.
    """
    rows = with_previous(prices.select("entity", "ts", "price", valid_price().alias("valid")), ["entity"], ["price", "valid"])
    both = F.col("valid") & F.col("prev.valid")
    return rows.select(
        "entity",
        "ts",
        "price",
        "valid",
        F.col("prev.ts").alias("prev_ts"),
        F.col("prev.valid").alias("prev_valid"),
        F.when(both, safe_log_ratio(F.col("price"), F.col("prev.price"))).alias("ret"),
    )


def kept_calendar(prices: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Timestamps that survive the reference's wide ``shift(1)`` + ``dropna()``.

    A timestamp ``t`` is kept when every entity has a valid price at ``t`` and at the previous timestamp of
    the *union* calendar, which holds every row, with or without a valid price.  Without pivoting or a global
    calendar window this is: all N entities are valid at ``t`` and on their own previous row, and they all
    share the same previous timestamp (then no calendar date lies between).  One aggregate keyed by ``ts``.
    """
    n = entity_count(prices)
    stats = (with_prev(prices) if rows is None else rows).groupBy("ts").agg(
        F.count_if("valid").alias("n_valid"),
        F.count_if(F.col("valid") & F.col("prev_valid")).alias("n_both"),
        F.min("prev_ts").alias("min_prev"),
        F.max("prev_ts").alias("max_prev"),
    )
    return stats.where(
        (F.col("n_valid") == n) & (F.col("n_both") == n) & (F.col("min_prev") == F.col("max_prev"))
    ).select("ts")


def complete_calendar(prices: DataFrame) -> DataFrame:
    """Per timestamp: number of entities with a valid price, whether complete, previous calendar ts, kept flag.

    The previous calendar date is a lag inside the calendar's year; only the first date of each year looks
    at the last one of the year before, so no window holds the whole calendar.
    """
    n = entity_count(prices)
    per_ts = prices.groupBy("ts").agg(F.count_if(valid_price()).alias("n_present"))
    per_ts = per_ts.withColumn("complete", F.col("n_present") == n).withColumn("y", F.year("ts"))
    last = per_ts.groupBy("y").agg(F.max(F.struct("ts", "complete")).alias("last"))
    before = last.select("y", F.lag("last").over(Window.orderBy("y")).alias("before"))  # one row a year
    w = Window.partitionBy("y").orderBy("ts")
    cal = per_ts.join(before, "y").withColumn("prev", F.coalesce(F.lag(F.struct("ts", "complete")).over(w), F.col("before")))
    return cal.select(
        "ts",
        F.col("n_present").cast("bigint").alias("n_present"),
        "complete",
        F.col("prev.ts").alias("prev_ts"),
        (F.col("complete") & F.coalesce(F.col("prev.complete"), F.lit(False))).alias("kept"),
    )


def materialize_panel(prices: DataFrame) -> DataFrame:
    """Write the (small) panel once to the shared checkpoint folder and read it back.

    The panel is ``entities x periods`` rows; every later step (calendar,
    returns, proxy, size checks) reads this table instead of re-scanning and
    re-aggregating the raw fact table.
    """
    return cut_lineage(prices, "panel")


def log_returns(prices: DataFrame, materialize: bool = True) -> DataFrame:
    """W1 + P2: ``(entity, ts, ret)`` on kept timestamps only.

    The rows with their previous ones are written once; the kept calendar joins as it is, and its measured size decides how.
    """
    if materialize:
        prices = materialize_panel(prices)
    rows = cut_lineage(with_prev(prices), "previous")  # read by the calendar rule and by the join with its dates
    return rows.join(kept_calendar(prices, rows), "ts", "left_semi").select("entity", "ts", "ret")


def entity_universe(*entity_sets: DataFrame) -> DataFrame:
    """Deduplicated union of entity names (tickers + proxy)."""
    out = None
    for df in entity_sets:
        part = df.select("entity")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def missing_entities(requested: DataFrame, available: DataFrame) -> DataFrame:
    """Requested entities absent from the available panel (empty = subset holds)."""
    return requested.select("entity").distinct().join(available.select("entity"), "entity", "left_anti")
