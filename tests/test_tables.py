"""Sinks and readers: round trips and the reference's transition-matrix CSV layout."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from regimekit.plans import hmm as H
from regimekit.plans.fixed import GivenModel, attach_model
from regimekit.sources import tables as TB

# Transition-matrix files as published with the reference results
# (current layout with layer labels, and the older layout without).
GOLDEN_FILES = {
    "AAPL_transition_matrix_layer0.csv": ",VS0_0,VS0_1\n"
    "VS0_0,0.9849053559702345,0.015094644029765479\n"
    "VS0_1,0.011606956086601799,0.9883930439133982\n",
    "GSPC_transition_matrix_layer1.csv": ",VS1_0,VS1_1\n"
    "VS1_0,0.957106,0.042894\n"
    "VS1_1,0.033441,0.966559\n",
}
OLDER_FILE = ("MSFT_transition_matrix.csv", ",VS0,VS1\nVS0,0.9936,0.0064\nVS1,0.007141,0.992859\n")


def test_read_reference_transition_csv(spark, tmp_dir):
    for name, text in [*GOLDEN_FILES.items(), OLDER_FILE]:
        with open(os.path.join(tmp_dir, name), "w") as fh:
            fh.write(text)
    long = TB.read_transition_csv(spark, os.path.join(tmp_dir, "*.csv"))
    rows = {(r.entity, r.layer_idx, r.from_state, r.to_state): r.prob for r in long.collect()}
    assert len(rows) == 12
    assert rows[("AAPL", 0, 0, 0)] == pytest.approx(0.9849053559702345)
    assert rows[("GSPC", 1, 1, 1)] == pytest.approx(0.966559)
    assert rows[("MSFT", 0, 1, 1)] == pytest.approx(0.992859)
    sums = [r.row_sum for r in TB.row_sums(long).collect()]
    assert all(abs(s - 1) < 1e-6 for s in sums)
    steps = long.where("from_state = to_state").select(
        "entity", "from_state", (1 / (1 - F.col("prob") + F.lit(1e-10))).alias("steps")
    )
    got = {(r.entity, r.from_state): r.steps for r in steps.collect()}
    assert got[("AAPL", 0)] == pytest.approx(66.249, abs=1e-3)
    assert got[("AAPL", 1)] == pytest.approx(86.155, abs=1e-3)
    assert got[("MSFT", 0)] == pytest.approx(156.250, abs=1e-3)


def test_transition_csv_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([("^VIX",), ("AAPL",)], "entity STRING")
    model = GivenModel((0.5, 0.5), ((0.9, 0.1), (0.2, 0.8)), ((0.0,), (1.0,)), (((1.0,),), ((1.0,),)))
    trans = H.transitions(attach_model(df, model)).withColumn("layer_idx", F.lit(0))
    path = os.path.join(tmp_dir, "tm")
    TB.write_transition_csv(trans, path)
    back = {tuple(r) for r in TB.read_transition_csv(spark, path).collect()}
    assert back == {(e, 0, i, j, p) for e in ("VIX", "AAPL") for i, row in enumerate(((0.9, 0.1), (0.2, 0.8))) for j, p in enumerate(row)}


def test_state_labeled_round_trip(spark, tmp_dir):
    rows = [("^MKT", dt.datetime(2024, 1, d + 1), 0.1 * d, 1.0, 2.0, 3.0, 0.5, d % 2) for d in range(5)]
    df = spark.createDataFrame(
        rows,
        "entity STRING, ts TIMESTAMP_NTZ, normalized_returns DOUBLE, vol_5 DOUBLE, vol_10 DOUBLE, vol_20 DOUBLE, "
        "market_vola DOUBLE, regime_layer0 INT",
    )
    for fmt in ("parquet", "csv"):
        path = os.path.join(tmp_dir, f"labeled_{fmt}")
        TB.write_state_labeled(df, path, fmt)
        back = TB.read_state_labeled(spark, path, fmt)
        assert back.count() == 5
        assert {r.entity_dir for r in back.select("entity_dir").distinct().collect()} == {"MKT"}
        got = sorted((r.ts, r.regime_layer0) for r in back.collect())
        assert got == sorted((r[1], r[7]) for r in rows)


def test_panel_and_model_round_trip(spark, tmp_dir):
    prices = spark.createDataFrame(
        [("A", dt.datetime(2024, 1, d + 1), 1.0 + d) for d in range(4)], "entity STRING, ts TIMESTAMP_NTZ, price DOUBLE"
    )
    TB.write_panel(prices, os.path.join(tmp_dir, "panel"))
    assert TB.read_panel(spark, os.path.join(tmp_dir, "panel"), ["A"]).count() == 4
    model = GivenModel((0.5, 0.5), ((0.9, 0.1), (0.2, 0.8)), ((0.0,), (1.0,)), (((1.0,),), ((1.0,),)))
    models = attach_model(prices, model)
    key = TB.fingerprint({"k": 2}, "panel-v1")
    path = os.path.join(tmp_dir, "models")
    assert TB.load_models(spark, path, key) is None
    TB.save_models(models, path, key)
    loaded = TB.load_models(spark, path, key)
    assert loaded is not None and loaded.count() == 1
    assert TB.load_models(spark, path, TB.fingerprint({"k": 3}, "panel-v1")) is None


def test_stage_tables_are_dropped(spark):
    from regimekit.session import _stage_tables, cut_lineage, drop_stage_tables

    drop_stage_tables(spark)
    df = cut_lineage(spark.range(10), "probe")
    assert df.count() == 10
    paths = list(_stage_tables(spark))
    assert len(paths) == 1 and os.path.isdir(paths[0].replace("file:", ""))
    assert drop_stage_tables(spark) == 1
    assert not os.path.exists(paths[0].replace("file:", ""))
    assert _stage_tables(spark) == []
