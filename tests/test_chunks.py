"""Windows over chunks with a halo, carried rows and merged statistics against pandas over whole series."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regimekit.operators import analytics as AN
from regimekit.operators import chunks as CH
from regimekit.operators import features as feat
from regimekit.operators import panel as pnl

DAY = dt.datetime(2023, 1, 1)


@pytest.fixture(scope="module")
def series():
    """Series with gaps of weeks and of years, and one that is far longer than the others."""
    r = np.random.default_rng(11)
    rows = []
    for e, n in (("long", 400), ("gaps", 40), ("two", 2), ("one", 1)):
        day = 0
        for i in range(n):
            day += int(r.choice([1, 1, 1, 9, 45])) if e != "gaps" else int(r.choice([1, 30, 400]))
            rows.append((e, DAY + dt.timedelta(days=day), None if i % 17 == 5 else float(r.normal())))
    return pd.DataFrame(rows, columns=["entity", "ts", "ret"])


def frame(spark, pdf):
    rows = [(e, t.to_pydatetime(), None if v != v else v) for e, t, v in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "entity STRING, ts TIMESTAMP_NTZ, ret DOUBLE")


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_rolling_std_with_chunk_borders_inside_windows(spark, series, size):
    got = feat.rolling_vol(frame(spark, series), (2, 5, 9), chunk_rows=size).toPandas().sort_values(["entity", "ts"]).reset_index(drop=True)
    assert len(got) == len(series)
    for e, g in got.groupby("entity"):
        x = series[series.entity == e].ret.reset_index(drop=True)
        for w in (2, 5, 9):
            np.testing.assert_allclose(g[f"vol_{w}"].to_numpy(float), x.rolling(w).std().to_numpy(), atol=1e-12)


def test_the_row_before_over_gaps(spark, series):
    got = CH.with_previous(frame(spark, series), ["entity"], ["ret"]).toPandas().sort_values(["entity", "ts"])
    for e, g in got.groupby("entity"):
        before = [None if p is None else (p["ts"], p["ret"]) for p in g["prev"]]
        rows = [(t, r if r == r else None) for t, r in zip(g["ts"], g["ret"])]
        assert [None if b is None else (b[0], b[1]) for b in before] == [None, *rows[:-1]]


@pytest.mark.parametrize("size", [2, 5, 1000])
def test_three_day_trend_with_chunk_borders(spark, series, size):
    df = frame(spark, series).withColumnsRenamed({"ret": "vol_5"}).withColumn("state", F.pmod(F.xxhash64("ts"), F.lit(3)).cast("int"))
    got = {(r.entity, r.state): r.avg_trend for r in AN.vol_trend_by_state(df, chunk_rows=size).collect()}
    pdf = df.toPandas().sort_values(["entity", "ts"])
    for e, g in pdf.groupby("entity"):
        want = g.assign(t=g.vol_5.astype(float).rolling(3).mean().diff()).groupby("state").t.mean()
        for s, v in want.items():
            assert got[(e, s)] == pytest.approx(v, abs=1e-12) or (v != v and got[(e, s)] is None)


def test_no_task_holds_an_entity(spark, series):
    """No window over the rows of an entity: the only one by entity alone runs over one row per month."""
    prices = frame(spark, series).withColumn("price", F.exp("ret")).select("entity", "ts", "price")
    for df in (pnl.with_prev(prices), feat.rolling_vol(frame(spark, series)), feat.normalized_returns(frame(spark, series)), feat.normalize_vols(feat.rolling_vol(frame(spark, series)))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        for spec in re.findall(r"\+?-? Window \[(.*)\], \[([^\]]*)\], \[?([^\n]*)", plan):
            keys = re.sub(r"#\d+L?", "", spec[1])
            assert keys != "entity" or "_m" in spec[2] or "_b" in spec[2] or "_c" in spec[0], spec


def test_moments_leave_out_null_and_nan(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", None), ("a", float("nan")), ("b", float("nan")), ("c", 2.0)]
    got = {r.entity: r for r in CH.moments(spark.createDataFrame(rows, "entity STRING, v DOUBLE"), ["entity"], ["v"]).collect()}
    assert (got["a"].v_n, got["a"].v_mean, got["a"].v_lo, got["a"].v_hi) == (2, 2.0, 1.0, 3.0) and got["a"].v_sd == pytest.approx(2**0.5)
    assert (got["b"].v_n, got["b"].v_mean, got["c"].v_sd) == (0, None, None)


def test_one_nan_changes_no_histogram_quantile_or_test(spark):
    base = [("a", DAY + dt.timedelta(days=i), float(i % 10), float(i), i % 2) for i in range(100)]
    ddl = "entity STRING, ts TIMESTAMP_NTZ, normalized_returns DOUBLE, vol_5 DOUBLE, state INT"
    nan = [("a", DAY + dt.timedelta(days=200), float("nan"), float("nan"), 1)]
    for fn in (AN.returns_histogram, AN.regime_histograms, AN.vol_quantiles, AN.regime_capture, AN.anova_returns):
        with_nan = sorted(map(tuple, fn(spark.createDataFrame(base + nan, ddl)).collect()))
        assert with_nan == sorted(map(tuple, fn(spark.createDataFrame(base, ddl)).collect()))


def test_capture_scans_its_input_twice(spark):
    """All measures' brackets in one aggregate, then one counting pass."""
    df = spark.range(6000).selectExpr("'a' entity", "timestamp_ntz '2024-01-01' + make_dt_interval(id) ts", "sin(id) vol_5", "cos(id) vol_10", "cast(id % 3 as int) state")
    plan = AN.bracket_counts(df, ["entity"], ["vol_5", "vol_10"], 0.95, ("state",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 2
    got = {(r.measure, r.state): r.share for r in AN.regime_capture(df).collect()}
    pdf = df.toPandas()
    for m in ("vol_5", "vol_10"):
        want = pdf[pdf[m] >= pdf[m].quantile(0.95)].state.value_counts(normalize=True)
        assert {s: got[(m, s)] for s in want.index} == pytest.approx(want.to_dict())
