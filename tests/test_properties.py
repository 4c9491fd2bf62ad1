"""Property-based checks of the complete-panel rule against the wide-frame semantics."""

import datetime as dt

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from regimekit.operators import panel as pnl

panels = st.lists(
    st.tuples(st.integers(0, 3), st.integers(0, 24), st.floats(0.5, 200.0, allow_nan=False)),
    min_size=1,
    max_size=70,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=panels)
def test_kept_returns_equal_wide_shift_dropna(spark, rows):
    dedup = {}
    for e, d, p in rows:
        dedup[(f"E{e}", d)] = p
    data = [(e, d, p) for (e, d), p in dedup.items()]
    wide = pd.DataFrame(data, columns=["entity", "day", "price"]).pivot(index="day", columns="entity", values="price")
    expect = np.log(wide / wide.shift(1)).dropna()
    df = spark.createDataFrame(
        [(e, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), float(p)) for e, d, p in data],
        "entity STRING, ts TIMESTAMP_NTZ, price DOUBLE",
    )
    got = pnl.log_returns(df, materialize=False).toPandas()
    got["day"] = (got["ts"] - pd.Timestamp("2024-01-01")).dt.days
    assert sorted(got["day"].unique().tolist()) == sorted(expect.index.tolist())
    for _, r in got.iterrows():
        assert abs(r["ret"] - expect.loc[r["day"], r["entity"]]) < 1e-12
    kept = sorted((t - dt.datetime(2024, 1, 1)).days for (t,) in pnl.kept_calendar(df).collect())
    assert kept == sorted(expect.index.tolist())
