import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import day, panel, rows_by
from pricetide import schemas
from pricetide.config import DATE, PRODUCT, WEEK
from pricetide.operators import panel as ops
from pricetide.sources.transactions import clean_transactions

RAW = "SHOP_DATE int, SHOP_WEEK int, PROD_CODE string, SPEND double, QUANTITY long, CUST_CODE string, BASKET_ID long, " \
      "BASKET_SIZE string, __null_dask_index__ long"


def raw(spark, *rows):
    return spark.createDataFrame([(*r, "c", 1, "S", 0) for r in rows], RAW)


def test_clean_transactions_parses_and_drops(spark):
    cleaned = clean_transactions(raw(spark, (20080110, 200802, "A", 2.0, 1)))
    assert cleaned.columns == [DATE, WEEK, PRODUCT, "SPEND", "QUANTITY"]
    assert cleaned.first()[DATE] == dt.date(2008, 1, 10)


def test_text_dates_parse_too(spark):
    df = raw(spark, (20080110, 200802, "A", 2.0, 1)).withColumn(DATE, F.col(DATE).cast("string"))
    assert clean_transactions(df).first()[DATE] == dt.date(2008, 1, 10)


@pytest.mark.parametrize("bad", [20081301, 20080230, 200801, 200801101])
def test_bad_dates_fail(spark, bad):
    with pytest.raises(Exception):
        clean_transactions(raw(spark, (bad, 200802, "A", 2.0, 1))).collect()


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="CUST_CODE"):
        clean_transactions(raw(spark, (20080110, 200802, "A", 2.0, 1)).drop("CUST_CODE"))


def test_either_product_column_is_accepted(spark):
    df = panel(spark, [("A", 0, 1, 1)])
    assert "product_id" in schemas.standard_product_id(df).columns
    assert "product_id" in schemas.standard_product_id(schemas.standard_product_id(df)).columns
    with pytest.raises(ValueError):
        schemas.standard_product_id(df.drop(PRODUCT))


def test_zero_quantity_leaves_the_price_mean_alone(spark):
    df = clean_transactions(raw(spark, (20080110, 200802, "A", 10.0, 2), (20080110, 200801, "A", 5.0, 0)))
    row = ops.daily_panel(df).first()
    assert (row.avg_price, row.total_sales, row.total_units, row.SHOP_WEEK) == (5.0, 15.0, 2, 200801)


def test_gap_is_counted_and_filtered(spark):
    df = panel(spark, [("A", 0, 1, 1), ("A", 1, 1, 1), ("A", 2, 1, 1), ("B", 0, 1, 9), ("B", 2, 1, 9), ("C", 5, 1, 1)])
    missing = {p: r.missing_periods for p, r in rows_by(ops.date_completeness(df), PRODUCT).items()}
    assert missing == {"A": 0, "B": 1, "C": 0}
    assert set(rows_by(ops.complete_products(df), PRODUCT)) == {"A", "C"}
    assert set(rows_by(ops.complete_products(df, "week"), PRODUCT)) == {"A", "B", "C"}


def test_equal_sales_rank_by_id(spark):
    df = panel(spark, [("C", 0, 2, 5), ("A", 0, 2, 5), ("B", 0, 2, 5)])
    assert [(r["rank"], r[PRODUCT]) for r in ops.top_products(df, 2).orderBy("rank").collect()] == [(1, "A"), (2, "B")]


def test_year_change_does_not_break_a_period_index(spark):
    df = panel(spark, [("A", d, 1, 1) for d in range(-40, 40)])
    for grain in ("day", "week", "month"):
        assert ops.date_completeness(df, grain).first().missing_periods == 0


def test_first_products_are_ordered(spark):
    df = panel(spark, [("C", 0, 1, 1), ("A", 0, 1, 1), ("B", 0, 1, 1)])
    assert {r[0] for r in ops.first_products(df, 2).collect()} == {"A", "B"}
    kept = ops.keep_products(df, ops.first_products(df, 1))
    assert [r[PRODUCT] for r in kept.collect()] == ["A"] and kept.first()[DATE] == day(0)


def test_days_and_late_lines_are_added_to_a_stored_panel(spark, tmp_path):
    from pricetide.operators.panel import daily_panel, finished_panel
    from pricetide.sources import tables
    from pricetide.sources.transactions import transactions_from_lines

    lines, path = transactions_from_lines(spark, "/root/testdata/sf0.001"), str(tmp_path / "parts")
    lines = lines.where(F.date_trunc("quarter", "SHOP_DATE") == F.lit("1995-04-01").cast("timestamp"))
    cuts = [F.col("QUANTITY") % 3 == k for k in range(3)]
    for cut in cuts:
        tables.add_to_panel(spark, lines.where(cut), path)
    got = finished_panel(tables.read_panel_parts(spark, path)).collect()
    want = {(r.SHOP_DATE, r.PROD_CODE): r for r in daily_panel(lines).collect()}
    assert len(got) == len(want) > 100
    for r in got:
        w = want[r.SHOP_DATE, r.PROD_CODE]
        assert (r.total_units, r.SHOP_WEEK) == (w.total_units, w.SHOP_WEEK)
        assert abs(r.avg_price - w.avg_price) < 1e-6 and abs(r.total_sales - w.total_sales) < 1e-6
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "parts").rglob("*.parquet")}
    day = lines.select("SHOP_DATE").orderBy("SHOP_DATE").first()[0]
    tables.add_to_panel(spark, lines.where(F.col("SHOP_DATE") == day), path)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "parts").rglob("*.parquet")}
    assert {f for f in before if after.get(f) != before[f]} == {f for f in before if str(day) in str(f)}


def test_stored_panel_keeps_lines_without_a_date(spark, tmp_path):
    from pricetide.operators.panel import finished_panel
    from pricetide.sources import tables
    from pricetide.sources.transactions import transactions_from_lines

    lines, path = transactions_from_lines(spark, "/root/testdata/sf0.001").limit(20), str(tmp_path / "parts")
    undated = lines.withColumn("SHOP_DATE", F.lit(None).cast("date"))
    for part in (undated, lines, undated, lines.limit(0)):
        tables.add_to_panel(spark, part, path, "month")
    parts = finished_panel(tables.read_panel_parts(spark, path))
    units = lines.agg(F.sum("QUANTITY")).first()[0]
    found = dict(parts.groupBy(F.col("SHOP_DATE").isNull()).agg(F.sum("total_units")).collect())
    assert found == {True: 2 * units, False: units}
