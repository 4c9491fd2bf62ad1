"""Price panels derived from fact tables.

A panel is the long table ``(entity STRING, ts TIMESTAMP_NTZ, price DOUBLE)``.
It is never pivoted wide, so the number of entities can grow freely.  The
aggregation to one price per (entity, period) is a partial (map-side) +
final hash aggregate: a hot entity holding a third of the raw rows still
yields only one row per period after the map side, so the shuffle carries
at most ``entities x periods`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regimekit.params import PanelSpec

# Fixed panel definitions over the test tables: (fact table, entity column,
# time column, value column, period, optional dimension join).
PANELS: dict[str, PanelSpec] = {
    "flag_week": PanelSpec("lineitem", "l_returnflag", "l_shipdate", "l_extendedprice", "week"),
    "flag_day": PanelSpec("lineitem", "l_returnflag", "l_shipdate", "l_extendedprice", "day"),
    "brand_week": PanelSpec(
        "lineitem", "p_brand", "l_shipdate", "l_extendedprice", "week",
        dim=("part", "l_partkey", "p_partkey"),
    ),
    "brand_day": PanelSpec(
        "lineitem", "p_brand", "l_shipdate", "l_extendedprice", "day",
        dim=("part", "l_partkey", "p_partkey"),
    ),
    "event_hour": PanelSpec("events", "event_type", "ts", "value", "hour"),
    "priority_week": PanelSpec("orders", "o_orderpriority", "o_orderdate", "o_totalprice", "week"),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def period_start(ts: Column | str, period: str) -> Column:
    """Start of the period containing ``ts`` (Monday for weeks).

    Date arithmetic on the zone-free type only: ``date_trunc`` would go through the
    session's time zone and move hours at a clock change.
    """
    t = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
    day = t.cast("date")
    if period == "day":
        return day.cast("timestamp_ntz")
    if period == "week":
        return F.date_sub(day, F.weekday(day)).cast("timestamp_ntz")
    if period in ("month", "quarter", "year"):
        return F.trunc(day, period).cast("timestamp_ntz")
    inside = {"hour": (F.lit(0), F.minute(t)), "minute": (F.lit(0), F.lit(0))}.get(period)
    if inside is None:
        raise ValueError(f"unknown period: {period}")
    return t - F.make_dt_interval(F.lit(0), inside[0], inside[1], F.date_part(F.lit("SECOND"), t))


def observations(spark: SparkSession, sf_dir: str, spec: PanelSpec, between: tuple | None = None) -> DataFrame:
    """Raw observations ``(entity, ts, value)``: only the three needed columns are scanned.

    ``between`` (first, last month) limits the scan to these months; the bounds reach the Parquet reader.
    """
    fact = read_table(spark, sf_dir, spec.table)
    if between is not None:
        first, last = (F.lit(x).cast("date") for x in between)
        fact = fact.where((F.col(spec.ts) >= first.cast("timestamp_ntz")) & (F.col(spec.ts) < F.add_months(last, 1).cast("timestamp_ntz")))
    if spec.dim is not None:
        dim_table, fact_key, dim_key = spec.dim
        dim = read_table(spark, sf_dir, dim_table).select(dim_key, spec.entity)
        # No broadcast hint: the dimension grows with the data.  AQE turns the
        # sort-merge join into a broadcast at run time when the measured side is
        # below spark.sql.adaptive.autoBroadcastJoinThreshold.
        fact = fact.select(fact_key, spec.ts, spec.value).join(
            dim, F.col(fact_key) == F.col(dim_key), "inner"
        )
    return fact.select(
        F.col(spec.entity).alias("entity"),
        F.col(spec.ts).alias("raw_ts"),
        F.col(spec.value).cast("double").alias("value"),
    ).where(F.col("entity").isNotNull() & F.col("raw_ts").isNotNull())


def price_bars(obs: DataFrame, period: str, how: str = "avg") -> DataFrame:
    """One price per (entity, period): ``avg`` of the values or the ``last`` value in the bar."""
    bucket = period_start("raw_ts", period).alias("ts")
    if how == "avg":
        agg = F.avg("value")
    elif how == "last":
        # latest timestamp in the bar; several rows at that instant -> the largest value
        agg = F.max_by("value", F.struct("raw_ts", "value"))
    else:
        raise ValueError(f"unknown bar aggregation: {how}")
    return obs.groupBy("entity", bucket).agg(agg.alias("price"))


def price_panel(spark: SparkSession, sf_dir: str, spec: PanelSpec | str, how: str = "avg", between: tuple | None = None) -> DataFrame:
    """Long panel of all entities plus the market proxy (the same statistic over every row of the period).

    One scan and one shuffle: each (entity, period) bar keeps its partial
    sum and count (or its last value); the proxy is re-aggregated from those
    bars, i.e. from ``entities x periods`` rows instead of the raw rows.
    """
    if isinstance(spec, str):
        spec = PANELS[spec]
    obs = observations(spark, sf_dir, spec, between)
    bucket = period_start("raw_ts", spec.period).alias("ts")
    if how == "avg":
        bars = obs.groupBy("entity", bucket).agg(F.sum("value").alias("_s"), F.count("value").alias("_c"))
        ent = bars.select("entity", "ts", F.try_divide("_s", "_c").alias("price"))
        proxy = bars.groupBy("ts").agg(F.try_divide(F.sum("_s"), F.sum("_c")).alias("price"))
    elif how == "last":
        last = F.max(F.struct("raw_ts", "value")).alias("_last")
        bars = obs.groupBy("entity", bucket).agg(last)
        ent = bars.select("entity", "ts", F.col("_last.value").alias("price"))
        proxy = bars.groupBy("ts").agg(F.max("_last").alias("_last")).select("ts", F.col("_last.value").alias("price"))
    else:
        raise ValueError(f"unknown bar aggregation: {how}")
    return ent.unionByName(proxy.select(F.lit(spec.proxy).alias("entity"), "ts", "price"))


def lookback_filter(prices: DataFrame, interval: str) -> DataFrame:
    """Keep the last ``interval`` (e.g. ``'5 years'``) before the newest timestamp of the panel.

    The newest timestamp is a scalar subquery (one-row global aggregate).
    """
    newest = prices.agg(F.max("ts")).scalar()
    return prices.where(F.col("ts") >= newest - F.expr(f"INTERVAL {interval}"))


def entity_filter(prices: DataFrame, entities: list[str] | DataFrame) -> DataFrame:
    """Project the panel onto requested entities: ``isin`` for short lists, semi-join otherwise."""
    if isinstance(entities, DataFrame):
        return prices.join(entities.select("entity").distinct(), "entity", "left_semi")
    return prices.where(F.col("entity").isin(list(entities)))
