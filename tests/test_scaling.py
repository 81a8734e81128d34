import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import panel, rows_by
from pricetide.config import FEATURES, Settings
from pricetide.operators import features, quantiles, registry, scaling, splits
from pricetide.plans import preparation


def test_split_edges_cover_everything(spark):
    s = Settings()
    one = dt.timedelta(days=1)
    dates = [(s.train_end,), (s.train_end + one,), (s.val_end,), (s.val_end + one,)]
    df = spark.createDataFrame(dates, "SHOP_DATE date")
    got = splits.split_by_date(df, s.train_end, s.val_end).orderBy("SHOP_DATE").collect()
    assert [r.split for r in got] == ["train", "val", "val", "test"]


def test_null_and_nan_are_different(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3)], "x double, i int")
    assert {r.i for r in splits.drop_null_rows(df).collect()} == {1, 2}
    assert {r.i: r.x for r in splits.zero_nan(df).collect()} == {1: 1.0, 2: 0.0, 3: None}


def test_booleans_become_floats(spark):
    df = spark.createDataFrame([(True,), (False,)], "b boolean")
    assert {r.b for r in splits.as_float32(df, ["b"]).collect()} == {0.0, 1.0}


@pytest.mark.parametrize("kind", scaling.KINDS)
def test_scalers_match_numpy_and_invert(spark, kind):
    rng = random.Random(1)
    x = [rng.gauss(5, 3) for _ in range(500)]
    df = spark.createDataFrame([(i, v, 4.0) for i, v in enumerate(x)] + [(-1, float("nan"), 4.0), (-2, None, 4.0)],
                               "i int, x double, c double")
    stats = scaling.fit_scalers(df, ["x", "c"], kind)
    got = rows_by(stats, "column")
    q = np.quantile(x, [0.25, 0.5, 0.75])
    center, scale = (np.mean(x), np.std(x)) if kind == "standard" else (q[1], q[2] - q[0])
    assert got["x"].center == pytest.approx(center) and got["x"].scale == pytest.approx(scale)
    assert (got["c"].center, got["c"].scale) == (4.0, 1.0)
    scaled = scaling.apply_scalers(df, stats, ["x", "c"])
    back = scaling.apply_scalers(scaled, stats, ["x", "c"], inverse=True).where("i >= 0").orderBy("i")
    assert [r.x for r in back.collect()] == pytest.approx(x)
    assert scaled.where("i = -2").first().x is None


def test_column_without_statistics_is_left_alone(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 8.0)], "x double, y double")
    out = scaling.apply_scalers(df, scaling.fit_scalers(df, ["x"]), ["x", "y"]).orderBy("y").collect()
    assert [(r.x, r.y) for r in out] == [(-1.0, 7.0), (1.0, 8.0)]


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        scaling.fit_scalers(spark.createDataFrame([(1.0,)], "x double"), ["x"], "minmax")


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 20_011])
def test_exact_quantiles_against_numpy(spark, n):
    rng = random.Random(n)
    # a third of the rows share one value
    x = [7.0 if rng.random() < 0.34 else rng.lognormvariate(2, 1) for _ in range(n)]
    df = spark.createDataFrame([(v, -v) for v in x], "a double, b double").repartition(3)
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = rows_by(quantiles.exact_quantiles(df, ["a", "b"], probabilities), "column")
    assert got["a"].quantiles == pytest.approx(list(np.quantile(x, probabilities)), rel=1e-12)
    assert got["b"].quantiles == pytest.approx(list(np.quantile([-v for v in x], probabilities)), rel=1e-12)
    assert got["a"].n == n


@pytest.mark.parametrize("digit, few", [(11, 1024), (3, 4), (16, 0)])
def test_quantiles_of_all_distinct_all_equal_and_wild_columns(spark, monkeypatch, digit, few):
    monkeypatch.setattr(quantiles, "DIGIT", digit)
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = random.Random(4)
    wild = [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(1000)] + [0.0, -0.0, float("inf"), -float("inf")]
    rows = [(float(i), 3.25, w, float(i % 2) if i % 3 else None, float("nan")) for i, w in enumerate(wild)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(4)
    probabilities = [0.0, 0.25, 0.5, 0.77, 1.0]
    got = rows_by(quantiles.exact_quantiles(df, list("abcde"), probabilities), "column")
    assert set(got) == set("abcd") and got["d"].n == 669
    for k, c in enumerate("abd"):
        mine = [r["abcde".index(c)] for r in rows if r["abcde".index(c)] is not None]
        assert got[c].quantiles == pytest.approx(list(np.quantile(mine, probabilities)), rel=1e-12)
    sorted_wild = sorted(wild)
    assert got["c"].quantiles[0] == -float("inf") and got["c"].quantiles[4] == float("inf")
    low, high = sorted_wild[501], sorted_wild[502]
    assert got["c"].quantiles[2] == pytest.approx(low + (high - low) * 0.5)


def test_quantiles_of_nothing(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "a double"), ["a"], [0.5]).collect() == []


@pytest.mark.parametrize("n", [1, 5, 2000])
def test_dense_ids_follow_sorted_order(spark, n):
    ids = [f"P{i:05d}" for i in random.Random(3).sample(range(99_999), n)]
    df = spark.createDataFrame([(i,) for i in ids + ids[:10]], "product_id string")
    got = {r.product_id: r.dense_id for r in registry.dense_ids(df).collect()}
    assert got == {p: k for k, p in enumerate(sorted(ids))}


def test_registry_maps_both_ways(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "product_id string, v int")
    ids = registry.dense_ids(df)
    dense = registry.to_dense(df, ids)
    assert {(r.dense_id, r.v) for r in dense.collect()} == {(1, 1), (0, 2)}
    assert {(r.product_id, r.v) for r in registry.to_raw(dense, ids).collect()} == {("b", 1), ("a", 2)}


def test_known_ids_keep_their_numbers(spark):
    old = registry.dense_ids(spark.createDataFrame([("m",), ("c",)], "product_id string"))
    more = spark.createDataFrame([("a",), ("m",), ("z",), ("a",), (None,)], "product_id string")
    assert {r.product_id: r.dense_id for r in registry.extended_ids(old, more).collect()} == {"c": 0, "m": 1, "a": 2, "z": 3}
    assert {r.product_id: r.dense_id for r in registry.extended_ids(old.limit(0), more).collect()} == {"a": 0, "m": 1, "z": 2}


def test_constants_default_to_zero(spark):
    df = panel(spark, [("A", 0, 1, 1), ("A", 1, 3, 5), ("B", 0, 9, 2)])
    constants = registry.product_constants(df.where("PROD_CODE = 'A'"))
    got = rows_by(registry.attach_constants(df, constants).select("PROD_CODE", "median_price", "sales_volatility"), "PROD_CODE")
    assert (got["A"].median_price, got["B"].median_price, got["B"].sales_volatility) == (2.0, 0.0, 0.0)
    assert registry.sales_volatility(df.where("PROD_CODE = 'B'")).first().sales_volatility is None
    assert registry.average_daily_revenue(df.where("PROD_CODE = 'A'")).first().avg_daily_revenue == 8.0


def test_scaled_training_columns_are_standard(spark):
    df = panel(spark, [(p, d, 2 + (d * 7 + len(p)) % 5, 10 + (d * 3) % 11) for p in ("A", "BB") for d in range(60)])
    s = Settings(train_end=dt.date(2008, 2, 10), val_end=dt.date(2008, 2, 20))
    split = preparation.split_features(df, s)
    train = splits.as_float32(split.where("split = 'train'"), FEATURES)
    stats = scaling.fit_scalers(train, FEATURES)
    for warmup, rows in (("missing", 120), ("mean", 120), ("drop", 64)):
        scaled = preparation.scaled_split(split, stats, FEATURES, warmup)
        assert scaled.count() == rows
        part = scaled.where("split = 'train'").select(
            F.avg(F.nanvl(F.col("avg_price"), F.lit(None))).alias("m"), F.stddev_pop("avg_price").alias("s")).first()
        if warmup != "drop":
            assert part.m == pytest.approx(0, abs=1e-6) and part.s == pytest.approx(1, abs=1e-6)
    missing = preparation.scaled_split(split, stats, FEATURES).where("isnan(lag_28_units)")
    assert missing.count() == 56
    assert features.LAGS[-1] == 28


def test_revenue_of_a_panel_keeps_no_second_table_of_days(spark):
    from catalog.queries import QUERIES
    from conftest import SMALLEST

    df = panel(spark, [("A", 0, 2, 4), ("A", 1, 3, 2), ("B", 1, 5, 1)])
    dateless = df.unionByName(df.where("PROD_CODE = 'B'").withColumn("SHOP_DATE", F.lit(None).cast("date")))
    for one_row_a_day in (False, True):
        found = registry.average_daily_revenue(dateless, one_row_a_day=one_row_a_day).collect()
        assert {r.PROD_CODE: r.avg_daily_revenue for r in found} == {"A": 7.0, "B": 10.0}
    plan = QUERIES["avg_daily_revenue"](spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    assert "distinct" not in plan and plan.split("Initial Plan")[-1].count("HashAggregate") == 4
