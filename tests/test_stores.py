"""Stores and files that grow or repeat: transition files of any size, panel cache, model store, sinks, wide prices, registry."""

import datetime as dt
import glob
import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from regimekit.plans import variants as V
from regimekit.plans.manager import RegimeManager
from regimekit.sources import model_store as MS
from regimekit.sources import panel_store as PS
from regimekit.sources import tables as TB
from regimekit.sources import wide

TRANS = "entity STRING, layer_idx INT, from_state INT, to_state INT, prob DOUBLE"
PRICES = "entity STRING, ts TIMESTAMP_NTZ, price DOUBLE"


def matrix(entity, layer, k):
    return [(entity, layer, i, j, round(random.Random(f"{entity}{i}{j}").random(), 6)) for i in range(k) for j in range(k)]


# ---------------------------------------------------------------- S7, S8


def test_matrices_of_2_3_4_and_12_states_side_by_side(spark, tmp_dir):
    rows = [*matrix("AA", 0, 2), *matrix("BB", 0, 3), *matrix("BB", 1, 4), *matrix("C C+%", 10, 12)]
    TB.write_transition_csv(spark.createDataFrame(rows, TRANS), f"{tmp_dir}/t")
    back = TB.read_transition_csv(spark, f"{tmp_dir}/t").collect()
    assert sorted(map(tuple, back)) == sorted(rows)
    for r in TB.row_sums(TB.read_transition_csv(spark, f"{tmp_dir}/t")).collect():
        assert r.row_sum is not None


def test_a_file_of_the_sink_reads_as_the_published_layout(spark, tmp_dir):
    TB.write_transition_csv(spark.createDataFrame(matrix("^VIX", 1, 2), TRANS), f"{tmp_dir}/t")
    folder = f"{tmp_dir}/t/entity_dir=VIX/layer_idx=1"
    (name,) = [x for x in os.listdir(folder) if x.startswith("part")]
    pdf = pd.read_csv(f"{folder}/{name}", index_col=0)
    assert list(pdf.columns) == list(pdf.index) == ["VS1_0", "VS1_1"]


def test_the_file_without_a_layer_is_a_fallback(spark, tmp_dir):
    files = {
        "A_transition_matrix.csv": ",VS0,VS1\nVS0,0.5,0.5\nVS1,0.1,0.9\n",
        "A_transition_matrix_layer0.csv": ",VS0_0,VS0_1,VS0_2\r\nVS0_0,1,0,0\r\nVS0_1,0,1,0\r\nVS0_2,0,0,1\r\n",
        "^B_transition_matrix.csv": '"","VS0","VS1"\n"VS0",0.25,0.75\n"VS1",,1\n',
        "empty_transition_matrix.csv": "",
    }
    for name, text in files.items():
        with open(f"{tmp_dir}/{name}", "w", newline="") as f:
            f.write(text)
    got = {(r.entity, r.layer_idx, r.from_state, r.to_state): r.prob for r in TB.read_transition_csv(spark, f"{tmp_dir}/*.csv").collect()}
    assert {k: v for k, v in got.items() if k[0] == "A"} == {("A", 0, i, j): float(i == j) for i in range(3) for j in range(3)}
    assert {k: v for k, v in got.items() if k[0] != "A"} == {("^B", 0, 0, 0): 0.25, ("^B", 0, 0, 1): 0.75, ("^B", 0, 1, 1): 1.0}


# ---------------------------------------------------------------- S4, U2


def prices_of(entities, first, days):
    return [(e, first + dt.timedelta(days=d), float(100 + i + d)) for i, e in enumerate(entities) for d in range(days)]


def test_the_second_refill_computes_only_what_is_missing(spark, tmp_dir):
    full = spark.createDataFrame(prices_of("ABC", dt.datetime(2024, 1, 1), 130), PRICES)
    asked = []

    def source(pairs, first, last):
        asked.append(sorted((r.entity, str(r.month)) for r in pairs.collect()))
        return full.where(F.col("ts").between(F.lit(first).cast("timestamp_ntz"), F.add_months(F.lit(last), 1).cast("timestamp_ntz")))

    path = f"{tmp_dir}/cache"
    one = PS.months_of(["A", "B"], "2024-01-01", "2024-03-01", spark)
    two = PS.months_of(["A", "C", "none"], "2024-02-01", "2024-04-01", spark)
    assert PS.refill(spark, path, one, source) == 6
    assert PS.refill(spark, path, one, source) == 0 and len(asked) == 1
    assert PS.refill(spark, path, two, source) == 7
    assert asked[1] == sorted([("A", "2024-04-01"), *((e, f"2024-0{m}-01") for e in ("C", "none") for m in (2, 3, 4))])
    assert PS.missing_pairs(spark, path, one.unionByName(two)).isEmpty()  # also the entity that the source doesn't have
    want = {tuple(r) for r in full.collect() if (r.entity in "AB" and r.ts.month <= 3) or (r.entity in "AC" and 2 <= r.ts.month <= 4)}
    got = [tuple(r) for r in PS.read(spark, path).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r.entity for r in PS.read(spark, path, two).collect()} == {"A", "C"}


def test_an_interrupted_refill_leaves_the_old_rows(spark, tmp_dir):
    path = f"{tmp_dir}/cache"
    old = spark.createDataFrame(prices_of("AB", dt.datetime(2024, 1, 1), 40), PRICES)
    pairs = PS.months_of(["A", "B"], "2024-01-01", "2024-02-01", spark)
    PS.refill(spark, path, pairs, lambda *_: old)
    before = sorted(map(tuple, PS.read(spark, path).collect()))
    broken = old.withColumn("price", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        PS.refill(spark, path, pairs, lambda *_: broken, refresh=pairs)
    assert sorted(map(tuple, PS.read(spark, path).collect())) == before
    assert PS.refill(spark, path, pairs, lambda *_: old.withColumn("price", F.col("price") + 1), refresh=pairs.where("entity = 'A'")) == 2
    after = {(r.entity, r.ts): r.price for r in PS.read(spark, path).collect()}
    assert after == {(e, t): p + (e == "A") for e, t, p in before}


def test_rows_that_no_finished_refill_named_are_not_read(spark, tmp_dir):
    path = f"{tmp_dir}/cache"
    rows = spark.createDataFrame(prices_of("A", dt.datetime(2024, 1, 1), 3), PRICES)
    rows.withColumns({"month": F.lit("2024-01-01"), "bucket": F.pmod(F.xxhash64("entity"), F.lit(PS.BUCKETS))}).write.partitionBy("month", "bucket").parquet(f"{path}/rows")
    assert PS.read(spark, path).isEmpty()
    assert PS.refill(spark, path, PS.months_of(["A"], "2024-01-01", "2024-01-01", spark), lambda *_: rows) == 1
    assert PS.read(spark, path).count() == 3


# ---------------------------------------------------------------- S9, M15, X3


def feature_rows(spark, entities, n=30, scale=1.0):
    rows = [(e, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), scale * float((d * 7 + i) % 31)) for i, e in enumerate(entities) for d in range(n)]
    return spark.createDataFrame(rows, "entity STRING, ts TIMESTAMP_NTZ, vol_5 DOUBLE")


def test_only_changed_entities_are_fitted_again(spark, tmp_dir):
    fitted = []

    class Counting(V.ThresholdModel):
        def fit(self, features):
            fitted.append(sorted(r.entity for r in features.select("entity").distinct().collect()))
            return super().fit(features)

    store = f"{tmp_dir}/store"
    manager = RegimeManager(Counting("vol_5", (0.5,)), store)
    first = manager.train_all(feature_rows(spark, "ABCD"))
    changed = feature_rows(spark, "ABCD").withColumn("vol_5", F.when(F.col("entity") < "C", F.col("vol_5") + 1).otherwise(F.col("vol_5")))
    second = manager.train_all(changed)
    third = manager.train_all(changed)
    more = manager.train_all(changed.unionByName(feature_rows(spark, "E")))
    assert fitted == [list("ABCD"), list("AB"), ["E"]]
    for r in (second, third):
        assert sorted(map(tuple, r.states.collect())) == sorted(map(tuple, manager.variant.fit(changed).states.collect()))
    assert first.states.count() == 120 and more.states.count() == 150
    assert RegimeManager(Counting("vol_5", (0.4,)), store).train_all(changed) and fitted[-1] == list("ABCD")  # another configuration


def test_a_save_run_twice_or_left_unfinished_gives_one_model_each(spark, tmp_dir):
    model = V.ThresholdModel("vol_5", (0.5,))
    feats = feature_rows(spark, "AB")
    keys, models, path = MS.entity_keys(feats, model.config()), model.fit(feats).models, f"{tmp_dir}/store"
    assert MS.load_models(spark, path, keys) is None and MS.without_models(spark, path, keys).count() == 2
    MS.with_rows_of(models, keys.withColumnRenamed("key", "fingerprint"), ["entity"], "inner").write.parquet(f"{path}/batches/batch=lost")  # no manifest
    assert MS.load_models(spark, path, keys) is None
    MS.save_models(models, path, keys)
    MS.save_models(models, path, keys)
    assert sorted(r.entity for r in MS.load_models(spark, path, keys).collect()) == ["A", "B"]
    twin = spark.read.parquet(f"{path}/manifest/*").withColumn("batch", F.lit("zz"))  # a second writer at the same time
    MS._read(spark, f"{path}/batches", merge=True).where("batch != 'lost'").drop("batch").write.parquet(f"{path}/batches/batch=zz")
    twin.write.parquet(f"{path}/manifest/zz")
    assert MS.load_models(spark, path, keys).count() == 2 and MS.without_models(spark, path, keys).isEmpty()


def test_an_entity_that_cannot_be_fitted_is_reported(spark):
    feats = feature_rows(spark, "A").unionByName(feature_rows(spark, "B", n=5)).unionByName(feature_rows(spark, "C").withColumn("vol_5", F.lit(None).cast("double")))
    result = RegimeManager(V.variant("threshold", feature="vol_5")).train_all(feats)
    assert {r.entity: r.status for r in result.fits.collect()} == {"A": "ok", "B": "skipped", "C": "skipped"}
    assert {r.entity for r in result.states.select("entity").distinct().collect()} == {"A"}


def test_the_registry_is_open_and_checks_its_classes(spark):
    class Sign(V._Variant):
        name, layers = "sign", ["regime_layer0"]

        def config(self):
            return {}

        def run(self, features, models=None):
            model = features.select("entity").distinct().selectExpr("entity", "'regime_layer0' layer", "2 k")
            state = (F.col("vol_5") > 15).cast("int")
            states = features.select("entity", "ts", F.lit("regime_layer0").alias("layer"), state.alias("raw_state"), state.alias("state"))
            return V.RegimeResult(self.name, None, model, states, model.selectExpr("entity", "layer", "0 from_state", "0 to_state", "1D prob"))

    try:
        V.register_variant(Sign)
        assert V.register_variant(Sign) is Sign
        assert RegimeManager(V.variant("sign")).train_all(feature_rows(spark, "A")).states.count() == 30
        with pytest.raises(ValueError, match="already"):
            V.register_variant(type("Other", (Sign,), {}))
        bad = type("Bad", (Sign,), {"name": "bad", "run": lambda self, f, m=None: V.RegimeResult("bad", None, f, f, f)})
        with pytest.raises(ValueError, match="models lacks layer, k"):
            RegimeManager(V.register_variant(bad)()).train_all(feature_rows(spark, "A"))
    finally:
        V.VARIANTS.pop("sign", None)
        V.VARIANTS.pop("bad", None)
    with pytest.raises(ValueError, match="no variant 'sign'"):
        V.variant("sign")
    with pytest.raises(TypeError, match="lacks"):
        V.register_variant(type("Nothing", (), {"name": "nothing"}))


# ---------------------------------------------------------------- S5, S1


def test_an_entity_with_most_rows_is_written_by_many_tasks(spark, tmp_dir):
    big = spark.range(9000).selectExpr("'^BIG' entity", "timestamp_ntz '2024-01-01' + make_dt_interval(0, id) ts", "cast(id as double) vol_5", "cast(id % 3 as int) regime_layer0")
    small = spark.range(1000).selectExpr("concat('S', id % 50) entity", "timestamp_ntz '2024-01-01' + make_dt_interval(0, id) ts", "cast(id as double) vol_5", "cast(id % 3 as int) regime_layer0")
    rows = big.unionByName(small)
    path = f"{tmp_dir}/labeled"
    TB.write_state_labeled(rows, path, rows_per_file=1000)
    back = TB.read_state_labeled(spark, path)
    assert sorted(map(tuple, back.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    files = [r[0] for r in back.where("entity = '^BIG'").groupBy(F.col("_metadata.file_path")).count().select("count").collect()]
    assert len(files) >= 5 and max(files) <= 2000 and sum(files) == 9000


def test_wide_prices_of_files_with_other_columns(spark, tmp_dir):
    one = pd.DataFrame({"Date": ["2024-01-02", "2024-01-03"], "AA": [1.5, None], "^B": ["2", "x"]})
    one.to_csv(f"{tmp_dir}/one.csv", index=False)
    with open(f"{tmp_dir}/two.csv", "w") as f:
        f.write('Date,"C D",AA\r\n2024-01-04,7,8.25\r\n2024-01-05,,\r\n')
    got = {(r.entity, r.ts.day): r.price for r in wide.read_wide_prices(spark, f"{tmp_dir}/*.csv").collect()}
    assert got == {("AA", 2): 1.5, ("^B", 2): 2.0, ("C D", 4): 7.0, ("AA", 4): 8.25}


def test_a_wide_plan_does_not_grow_with_the_tickers(spark, tmp_dir):
    plans = []
    for n in (5, 1500):
        rows = spark.range(n * 3).selectExpr(f"concat('T', id % {n}) entity", f"timestamp_ntz '2024-01-01' + make_dt_interval(cast(id div {n} as int)) ts", "sqrt(id) price")
        wide.write_wide_prices(rows, f"{tmp_dir}/{n}")
        back = wide.read_wide_prices(spark, f"{tmp_dir}/{n}")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
        plans.append(len(back._jdf.queryExecution().optimizedPlan().toString()))
    assert plans[1] - plans[0] < 50


def test_the_time_of_a_wide_file_grows_with_its_cells_not_with_their_square(spark, tmp_dir):
    rows = spark.range(20_000 * 8).selectExpr("concat('T', id % 20000) entity", "timestamp_ntz '2024-01-01' + make_dt_interval(cast(id div 20000 as int)) ts", "sqrt(id) price").where("hash(price) % 9 <> 0")
    began = time.monotonic()
    wide.write_wide_prices(rows, f"{tmp_dir}/many")
    back = wide.read_wide_prices(spark, f"{tmp_dir}/many")
    assert back.exceptAll(rows).isEmpty() and back.count() == rows.count()
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("block", [1, 3, 100])
def test_wide_lines_are_put_together_and_taken_apart_by_pieces(spark, tmp_dir, monkeypatch, block):
    monkeypatch.setattr(wide, "BLOCK", block)
    cells = {"A": {5: 1.5}, "B": {2: None}, "C": {2: 2.5, 3: float("nan"), 5: 3.5}, "D": {}, "E": {1: 4.5}, "F": {}, "G": {4: 5.5}, "H": {1: None}}
    rows = [(e, dt.datetime(2024, 1, d), v) for e, days in cells.items() for d, v in days.items()]
    wide.write_wide_prices(spark.createDataFrame(rows, PRICES), f"{tmp_dir}/w")
    (file,) = glob.glob(f"{tmp_dir}/w/part-*")
    with open(file) as f:
        assert f.read().splitlines() == [
            "Date,A,B,C,E,G,H",
            "2024-01-01 00:00:00,,,,4.5,,",
            "2024-01-02 00:00:00,,,2.5,,,",
            "2024-01-03 00:00:00,,,NaN,,,",
            "2024-01-04 00:00:00,,,,,5.5,",
            "2024-01-05 00:00:00,1.5,,3.5,,,",
        ]
    got = {(r.entity, r.ts.day): r.price for r in wide.read_wide_prices(spark, f"{tmp_dir}/w").collect()}
    assert got == {("E", 1): 4.5, ("C", 2): 2.5, ("G", 4): 5.5, ("A", 5): 1.5, ("C", 5): 3.5}
    with pytest.raises(Exception, match="occurs twice"):
        wide.write_wide_prices(spark.createDataFrame([rows[0], rows[0]], PRICES), f"{tmp_dir}/twice")
