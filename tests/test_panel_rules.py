"""Prices as they are, bars without a time zone, the calendar of the complete-panel rule, isolated fits."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from regimekit.operators import panel as pnl
from regimekit.params import FitParams, PanelSpec
from regimekit.plans import hmm as H
from regimekit.plans import hmm_kernels as K
from regimekit.sources import panels as src


def _prices(spark, rows):
    return spark.createDataFrame(rows, "entity STRING, day INT, price DOUBLE").select(
        "entity", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(day)").alias("ts"), "price"
    )


def _days(df):
    return sorted((r["ts"] - dt.datetime(2024, 1, 1)).days for r in df.collect())


def test_small_and_large_prices_are_averaged_as_they_are(spark, tmp_dir):
    values = [0.0041, 0.0046, 0.0051, 0.0056, 0.0061, 1e17]
    spark.createDataFrame([("A", dt.datetime(2024, 1, i + 1, 9), v) for i, v in enumerate(values)], "e STRING, t TIMESTAMP_NTZ, v DOUBLE").write.parquet(f"{tmp_dir}/obs.parquet")
    panel = src.price_panel(spark, tmp_dir, PanelSpec("obs", "e", "t", "v", "day"))
    got = [r["price"] for r in panel.where("entity = 'A'").orderBy("ts").collect()]
    assert got == values


@pytest.mark.parametrize(
    "day2",
    [
        [("A", 2, None), ("B", 2, None)],  # a calendar row without any price
        [("A", 2, -1.0)],  # an invalid price and a missing row
        [("A", 2, 0.0), ("B", 2, float("nan"))],
    ],
)
def test_a_calendar_row_without_valid_prices_breaks_the_chain(spark, day2):
    rows = [(e, d, 10.0 + d) for e in ("A", "B") for d in (0, 1, 3, 4, 5)] + day2
    prices = _prices(spark, rows)
    assert _days(pnl.kept_calendar(prices)) == [1, 4, 5]
    assert _days(pnl.complete_calendar(prices).where("kept")) == [1, 4, 5]
    returns = pnl.log_returns(prices)
    assert returns.count() == 6 and returns.where("ret is null").count() == 0


def test_calendar_lag_crosses_years(spark):
    rows = [(e, d, 10.0 + d) for e in ("A", "B") for d in range(360, 370)]
    cal = pnl.complete_calendar(_prices(spark, rows))
    assert cal.where("prev_ts is null").count() == 1 and cal.where("kept").count() == 9


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_bars_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        obs = spark.createDataFrame([("2024-03-10 02:30:15.5",), ("2024-11-03 01:59:59",)], "s STRING").select(F.to_timestamp_ntz("s").alias("ts"))
        got = obs.select(*[src.period_start("ts", p).cast("string").alias(p) for p in ("minute", "hour", "day", "week", "month", "year")]).orderBy("minute").collect()
        assert tuple(got[0]) == ("2024-03-10 02:30:00", "2024-03-10 02:00:00", "2024-03-10 00:00:00", "2024-03-04 00:00:00", "2024-03-01 00:00:00", "2024-01-01 00:00:00")
        assert got[1]["hour"] == "2024-11-03 01:00:00" and got[1]["week"] == "2024-10-28 00:00:00"
        assert pnl.date_filter(obs, "2024-03-10 02:30:15", "2024-03-10 02:31:00").count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_numbers_without_a_window_over_the_sequence(spark):
    days = list(range(0, 400, 3))
    df = _prices(spark, [(e, d, 1.0) for e in ("A", "B") for d in days])
    got = H.sequences(df, ["price"], FitParams(shuffle=True)).orderBy("entity", "ts").collect()
    assert [r["t"] for r in got] == 2 * list(range(1, len(days) + 1))
    assert {r["n"] for r in got} == {len(days)}
    assert sum(r["split"] == "train" for r in got) == 2 * int(0.8 * len(days))


def _start(k=2, d=2):
    return np.full(k, 1 / k), np.full((k, k), 1 / k), np.arange(k)[:, None] * np.ones((k, d)), np.stack([np.eye(d)] * k)


def test_one_broken_restart_leaves_the_others_alone():
    x = np.random.default_rng(0).normal(size=(200, 2))
    sp, tm, mu, cv = (np.stack([a] * 3) for a in _start())
    alone = K.em_fit(x, sp[:1], tm[:1], mu[:1], cv[:1], max_iter=20)
    cv = cv.copy()
    cv[1, 0] = [[1.0, 2.0], [2.0, 1.0]]  # indefinite
    out = K.em_fit(x, sp, tm, mu, cv, max_iter=20)
    assert list(out[6] == "failed") == [False, True, False]
    assert out[7][1] != "" and out[7][0] == ""
    for got, want in zip(out[:5], alone[:5]):
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[2], want[0])  # bit for bit


def test_a_restart_does_not_depend_on_its_batch():
    x = np.random.default_rng(1).normal(size=(301, 3))
    r = np.random.default_rng(2)
    sp, tm, mu, cv = (np.stack([a] * 20) for a in _start(d=3))
    mu = mu + r.normal(size=mu.shape)
    many = K.em_fit(x, sp, tm, mu, cv, max_iter=30)
    for i in (0, 7, 19):
        one = K.em_fit(x, sp[i : i + 1], tm[i : i + 1], mu[i : i + 1], cv[i : i + 1], max_iter=30)
        assert all(np.array_equal(a[i], b[0]) for a, b in zip(many, one))


def test_shifted_data_fit_alike(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(0, 1, 120), r.normal(3, 2, 120)])
    fits = []
    for shift in (0.0, 1e6):
        df = _prices(spark, [("A", i, float(v + shift)) for i, v in enumerate(x)])
        fit = FitParams(n_restarts=2, max_iter=15)
        fits.append(H.fit_grid(H.sequences(df, ["price"], fit), fit).orderBy("seed").collect())
    for a, b in zip(*fits):
        assert a["status"] != "failed" and b["status"] != "failed"
        assert abs(a["train_loglik"] - b["train_loglik"]) < 1e-3 and abs(a["means"][0][0] - b["means"][0][0] + 1e6) < 1e-3
