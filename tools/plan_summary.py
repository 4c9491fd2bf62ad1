"""Summarise physical plans of headline queries: scans, exchanges, broadcasts, Python stages.

Usage: python tools/plan_summary.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from regimekit.operators import analytics as AN  # noqa: E402
from regimekit.operators import features as feat  # noqa: E402
from regimekit.plans import catalog as C  # noqa: E402
from regimekit.session import get_spark  # noqa: E402
from regimekit.sources import panels as src  # noqa: E402


def summary(name, df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet [^\n]*?Location: InMemoryFileIndex[^\n]*?\[([^\]]+)\]", plan)
    counts = {
        "parquet scans": len(re.findall(r"FileScan parquet", plan)),
        "shuffle exchanges": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|Exchange RoundRobin", plan)),
        "single-partition exchanges": len(re.findall(r"Exchange SinglePartition", plan)),
        "broadcasts": len(re.findall(r"BroadcastExchange", plan)),
        "python stages": len(re.findall(r"FlatMapCoGroupsInPandas|FlatMapGroupsInPandas|ArrowEvalPython", plan)),
    }
    tables = sorted({os.path.basename(s.split(",")[0].rstrip("/")) for s in scans})
    print(f"| {name} | " + " | ".join(str(v) for v in counts.values()) + f" | {', '.join(tables)} |")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    print("| query | parquet scans | shuffle exchanges | single-partition exchanges | broadcasts | python stages | tables read |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    summary("price_panel (brand_day)", src.price_panel(spark, sf, "brand_day"))
    summary("features (brand_day)", feat.build_features(src.price_panel(spark, sf, "brand_day")))
    lab = C.labeled(spark, sf, "brand_day")
    summary("state_labeled (given model)", lab)
    summary("regime_capture", AN.regime_capture(lab))
    summary("anova_returns", AN.anova_returns(lab))


if __name__ == "__main__":
    main()
