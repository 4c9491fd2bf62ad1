"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list to run a subset), BENCH_EVENT_LOG (a folder: write
Spark's event log there; summarise it with tools/stage_times.py).
Each query is forced with a no-op write (full computation, nothing collected).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from regimekit.operators import analytics as AN  # noqa: E402
from regimekit.operators import features as feat  # noqa: E402
from regimekit.operators import panel as pnl  # noqa: E402
from regimekit.params import FeatureParams, FitParams  # noqa: E402
from regimekit.plans import catalog as C  # noqa: E402
from regimekit.plans.variants import PlainModel  # noqa: E402
from regimekit.session import drop_stage_tables, get_spark  # noqa: E402
from regimekit.sources import panels as src  # noqa: E402

BENCH_PANEL = "brand_day"  # 25 brands + proxy, daily, lineitem joined with part


def _panel(spark, sf):
    return src.price_panel(spark, sf, BENCH_PANEL)


def q_price_panel(spark, sf):
    return _panel(spark, sf)


def q_log_returns(spark, sf):
    return pnl.log_returns(_panel(spark, sf))


def q_features(spark, sf):
    return feat.build_features(_panel(spark, sf), FeatureParams())


def q_regime_analytics(spark, sf):
    lab = C.labeled(spark, sf, BENCH_PANEL)
    return AN.regime_capture(lab).unionByName(
        AN.vol_trend_by_state(lab).select("entity", "measure", "state", F.col("avg_trend").alias("share"))
    )


def q_fit_plain(spark, sf):
    feats = feat.build_features(_panel(spark, sf), FeatureParams())
    return PlainModel(FeatureParams().feature_columns, FitParams()).fit(feats).states


QUERIES = {
    "price_panel": q_price_panel,
    "log_returns": q_log_returns,
    "features": q_features,
    "regime_analytics": q_regime_analytics,
    "fit_plain": q_fit_plain,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(QUERIES)
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}
    if os.environ.get("BENCH_EVENT_LOG"):
        conf.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]})
    spark = get_spark(f"local[{cpus}]", app="regimekit-bench", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    # warm-up: JVM, parquet footers and Python workers (not timed)
    src.price_panel(spark, sf_dir, "flag_week").write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        drop_stage_tables(spark)  # results consumed: free the stage tables of this query
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
                "panel": BENCH_PANEL,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
