"""Feature build against hand-made fixtures and a pandas rendering of the reference's rules."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from regimekit.operators import features as feat
from regimekit.operators import panel as pnl
from regimekit.params import FeatureParams


def _prices(spark, rows):
    return spark.createDataFrame(
        [(e, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), float(p)) for e, d, p in rows],
        "entity STRING, ts TIMESTAMP_NTZ, price DOUBLE",
    )


def _wide_reference(rows):
    """The reference's wide-frame semantics: log(p/p.shift(1)).dropna() on the union calendar."""
    df = pd.DataFrame(rows, columns=["entity", "day", "price"]).pivot(index="day", columns="entity", values="price")
    return np.log(df / df.shift(1)).dropna()


def test_gap_panel_drops_t_and_t_plus_1(spark):
    rows = [(e, d, 100 + d + i) for i, e in enumerate("ABC") for d in range(8) if not (e == "B" and d == 3)]
    ret = pnl.log_returns(_prices(spark, rows)).toPandas()
    kept_days = sorted({(t - pd.Timestamp("2024-01-01")).days for t in ret["ts"]})
    expected = sorted(_wide_reference(rows).index)
    assert kept_days == expected == [1, 2, 5, 6, 7]
    assert len(ret) == 3 * len(expected)
    ref = _wide_reference(rows)
    for _, r in ret.iterrows():
        day = (r["ts"] - pd.Timestamp("2024-01-01")).days
        assert r["ret"] == pytest.approx(ref.loc[day, r["entity"]], abs=1e-15)


def test_calendar_rule_matches_lag_form(spark):
    rng = np.random.default_rng(3)
    rows = [(e, d, 50 + rng.random()) for e in "ABCD" for d in range(60) if rng.random() > 0.08]
    prices = _prices(spark, rows)
    a = sorted(r[0] for r in pnl.kept_calendar(prices).collect())
    b = sorted(r[0] for r in pnl.complete_calendar(prices).where("kept").select("ts").collect())
    assert a == b
    assert [(t - dt.datetime(2024, 1, 1)).days for t in a] == sorted(_wide_reference(rows).index)


def test_constant_price_gives_no_rows(spark):
    rows = [("A", d, 10.0) for d in range(30)]
    out = feat.build_features(_prices(spark, rows + [("^MKT", d, 5.0 + d) for d in range(30)]))
    assert out.where("entity = 'A'").count() == 0


def test_zero_and_negative_prices_do_not_raise(spark):
    rows = [("A", 0, 1.0), ("A", 1, 0.0), ("A", 2, -1.0), ("A", 3, 2.0), ("A", 4, 3.0)]
    ret = pnl.log_returns(_prices(spark, rows)).collect()
    assert all(r["ret"] is not None and np.isfinite(r["ret"]) for r in ret)


def test_rolling_vol_and_zscore_match_pandas(spark):
    rng = np.random.default_rng(0)
    n = 80
    rows = [("A", d, 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n))[d])) for d in range(n)]
    rows += [("^MKT", d, 20 + rng.random()) for d in range(n)]
    p = FeatureParams()
    out = feat.build_features(_prices(spark, rows), p).where("entity = 'A'").orderBy("ts").toPandas()
    ref = _wide_reference(rows)
    r = ref["A"]
    expect = pd.DataFrame({"normalized_returns": r - r.mean()})
    for w in p.vol_windows:
        v = r.rolling(w).std()
        expect[f"vol_{w}"] = (v - v.mean()) / v.std()
    proxy = pd.Series([x[2] for x in rows if x[0] == "^MKT"], index=range(n))
    expect["market_vola"] = ((proxy - proxy.mean()) / proxy.std()).reindex(expect.index)
    expect = expect.dropna()
    assert len(out) == len(expect)
    for c in p.feature_columns:
        assert np.abs(out[c].to_numpy() - expect[c].to_numpy()).max() < 1e-10


@pytest.mark.parametrize("mode", ["raw", "smoothed", "returns", "zscore"])
def test_proxy_modes_match_pandas(spark, mode):
    vals = [10, 12, 11, 15, 14, 13, 16, 18, 17, 19]
    s = pd.Series(vals, dtype=float)
    expect = {
        "raw": s,
        "smoothed": s.rolling(5).mean(),
        "returns": np.log(s / s.shift(1)).dropna(),
        "zscore": (s - s.mean()) / s.std(),
    }[mode]
    prices = _prices(spark, [("^MKT", d, v) for d, v in enumerate(vals)])
    got = feat.proxy_transform(prices, mode, 5).orderBy("ts").toPandas()["market_vola"].to_numpy()
    exp = expect.to_numpy()
    assert len(got) == len(exp)
    assert np.allclose(np.nan_to_num(got.astype(float), nan=-9), np.nan_to_num(exp, nan=-9))


def test_unknown_methods_raise(spark):
    prices = _prices(spark, [("A", 0, 1.0)])
    with pytest.raises(ValueError):
        feat.build_features(prices, FeatureParams(vol_norm="bogus"))
    with pytest.raises(ValueError):
        feat.proxy_transform(prices, "bogus")


def test_date_filter_inclusive(spark):
    prices = _prices(spark, [("A", d, 1.0 + d) for d in range(10)])
    out = pnl.date_filter(prices, "2024-01-03", "2024-01-05").count()
    assert out == 3


def test_entity_order_and_partitioning_do_not_matter(spark):
    rng = np.random.default_rng(11)
    rows = [(e, d, 50 + rng.random()) for e in "ABC" for d in range(60)] + [("^MKT", d, 5 + rng.random()) for d in range(60)]
    a = feat.build_features(_prices(spark, rows)).orderBy("entity", "ts").toPandas()
    b = feat.build_features(_prices(spark, rows[::-1]).repartition(7)).orderBy("entity", "ts").toPandas()
    pd.testing.assert_frame_equal(a, b)
