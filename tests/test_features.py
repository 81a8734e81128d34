import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from helpers import panel, rows_by
from pricetide.config import DATE, FEATURES
from pricetide.functions import calendar, numeric
from pricetide.operators import features


def test_single_row_has_no_history(spark):
    row = features.time_series_features(panel(spark, [("A", 0, 3, 7)])).first()
    for c in FEATURES:
        if c.startswith(("lag", "rolling")) or c == "price_change_pct":
            assert row[c] is None
    assert row.price_position == 0.0 and row.days_since_price_change == 1


def test_warmup_fills_row_by_row(spark):
    df = features.time_series_features(panel(spark, [("A", d, 3, d + 1) for d in range(30)]))
    rows = df.orderBy(DATE).collect()
    assert [i + 1 for i, r in enumerate(rows) if r.lag_28_units is not None] == [29, 30]
    assert [i + 1 for i, r in enumerate(rows) if r.rolling_mean_28_units is not None] == [28, 29, 30]
    assert rows[6].rolling_mean_7_units == 4.0
    assert math.isclose(rows[6].rolling_std_7_units, math.sqrt(28 / 6))
    assert rows[29].lag_1_units == 29 and rows[29].lag_28_units == 2


def test_prices(spark):
    rows = features.time_series_features(panel(spark, [("A", 0, 2, 1), ("A", 1, 3, 1), ("A", 2, 4, 1)])).orderBy(DATE).collect()
    assert math.isclose(rows[1].price_change_pct, 3 / (2 + 1e-6) - 1)
    assert math.isclose(rows[1].price_position, 1 / (2 + 1e-6))


def test_constant_price_has_position_zero(spark):
    df = features.time_series_features(panel(spark, [("A", d, 5, 1) for d in range(10)]))
    assert {r.price_position for r in df.collect()} == {0.0}


def test_lags_follow_dates_not_row_order(spark):
    df = panel(spark, [("A", 2, 1, 30), ("A", 0, 1, 10), ("A", 1, 1, 20)])
    assert [r.lag_1_units for r in features.time_series_features(df).orderBy(DATE).collect()] == [None, 10, 20]


def test_weekdays_and_iso_weeks(spark):
    days = spark.createDataFrame([(dt.date(2008, 1, 12),), (dt.date(2008, 12, 29),)], "SHOP_DATE date")
    rows = rows_by(days.withColumns(features.calendar_columns()), DATE)
    saturday, monday = rows[dt.date(2008, 1, 12)], rows[dt.date(2008, 12, 29)]
    assert (saturday.day_of_week, saturday.week_of_year, saturday.is_weekend) == (6, 2, True)
    assert (monday.day_of_week, monday.week_of_year, monday.is_weekend) == (1, 1, False)
    assert math.isclose(monday.day_of_week_sin, math.sin(2 * math.pi / 7))


def test_finite_or_zero(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, float("-inf")), (4, None), (5, 2.5)],
                               "i int, x double")
    got = {r.i: r.y for r in df.withColumn("y", numeric.finite_or_zero(F.col("x"))).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.0, 4: None, 5: 2.5}


def test_week_index_starts_on_monday(spark):
    week = lambda d: spark.range(1).select(calendar.period_index(F.lit(d), "week")).first()[0]
    assert week(dt.date(2008, 1, 6)) + 1 == week(dt.date(2008, 1, 7)) == week(dt.date(2008, 1, 13))


def test_blocks_give_the_same_rows(spark):
    sizes = {"A": 1, "B": 28, "C": 33, "D": 64, "E": 200, "F": 97, None: 40}
    rows = [(p, d * (1 + (p or "x").count("F")) + d // 50 * 30, (d * 7 + len(p or "")) % 5 + 1, (d * d) % 11)
            for p, n in sizes.items() for d in range(n)]
    df = panel(spark, rows).withColumn("avg_price", F.when(F.col("total_units") != 4, F.col("avg_price")))
    whole = features.time_series_features(df)
    for block_rows, era_days in ((28, 10), (32, 45), (1000, 365)):
        parts = features.time_series_features(df, block_rows, era_days)
        assert [(f.name, f.dataType) for f in parts.schema] == [(f.name, f.dataType) for f in whole.schema]
        key = lambda r: (str(r.PROD_CODE), r.SHOP_DATE)
        for a, b in zip(sorted(parts.collect(), key=key), sorted(whole.collect(), key=key), strict=True):
            assert repr(a) == repr(b)
    assert features.time_series_features(df.limit(0), 32).count() == 0


def test_blocks_are_dealt_with_the_rows_before_them(spark):
    df = panel(spark, [("A", d, 3, d) for d in range(100)])
    dealt = features._dealt(df, 40, 7).groupBy("__block").agg(F.sum(F.col("__own").cast("int")), F.count("*"))
    assert {tuple(r) for r in dealt.collect()} == {(0, 40, 40), (1, 40, 68), (2, 20, 48), (3, 0, 8)}  # none follow the last 8
    with pytest.raises(ValueError):
        features.time_series_features(df, 27)
