import datetime as dt
import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import SMALLEST
from pricetide.__main__ import parser
from pricetide.config import FEATURES, Settings
from pricetide.operators import demand, evaluation, kpi
from pricetide.plans import evaluation as jobs
from pricetide.plans import preparation
from pricetide.sources import tables
from pricetide.sources.transactions import raw_transactions_from_lines, transactions_from_lines

SETTINGS = replace(Settings(), train_end=dt.date(2000, 1, 10), val_end=dt.date(2000, 4, 10), top_n=5, horizon=20)


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("jobs")
    raw = str(folder / "raw")
    raw_transactions_from_lines(spark, SMALLEST).write.parquet(raw)
    data, model = str(folder / "data"), str(folder / "model")
    preparation.prepare_data(spark, data, raw_path=raw, settings=SETTINGS, grain="month")
    jobs.train_demand(spark, data, model, SETTINGS, n_trees=3)
    return folder, data, model


def test_prepared_tables(spark, prepared):
    _, data, _ = prepared
    top = tables.read_product_ids(spark, f"{data}/top_products").orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2, 3, 4, 5]
    panel = tables.read_daily_panel(spark, f"{data}/daily")
    assert {r[0] for r in panel.select("PROD_CODE").distinct().collect()} == {r.PROD_CODE for r in top}
    counts = {s: tables.read_parquet(spark, f"{data}/{s}_scaled").count() for s in ("train", "val", "test")}
    assert sum(counts.values()) == panel.count() and all(counts.values())
    assert tables.read_scaler_stats(spark, f"{data}/scaler_stats").count() == len(FEATURES)
    train = tables.read_parquet(spark, f"{data}/train_scaled")
    assert dict(train.dtypes)["is_weekend"] == "float"
    assert train.where(F.isnan("lag_28_units")).count() == 28 * 5
    assert train.where("lag_28_units IS NULL").count() == 0


def test_given_panel_gives_the_same_features(spark, prepared):
    folder, data, _ = prepared
    other = str(folder / "again")
    preparation.prepare_data(spark, other, panel_path=f"{data}/daily", settings=SETTINGS)
    a, b = (tables.read_parquet(spark, f"{d}/test_scaled") for d in (data, other))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_registry(spark, prepared):
    folder, data, _ = prepared
    rows, registry, revenue = preparation.load_data_registry(spark, f"{data}/test_scaled", str(folder / "registry"))
    assert {r.dense_id for r in registry.collect()} == set(range(5))
    assert revenue.count() == 5 and rows.where(F.isnan("lag_28_units")).count() == 0
    with pytest.raises(Exception):
        tables.read_product_registry(spark, str(folder / "nowhere")).collect()


def test_model_keeps_feature_order_and_scores(spark, prepared):
    _, data, model = prepared
    assert tables.feature_names(tables.load_model(model)) == FEATURES
    quality = jobs.evaluate_demand(spark, data, model).first()
    assert quality.mae > 0 and quality.rmse >= quality.mae
    assert jobs.calibrate_noise(spark, data, model).first().noise_std > 0
    series = jobs.demand_series(spark, data, model)
    assert series.select("product_id").distinct().count() == 1


def test_quality_definitions(spark):
    df = spark.createDataFrame([(1, 1.5), (2, 2.0), (4, 3.0)], "total_units int, prediction double")
    row = demand.model_quality(df).first()
    mean = 7 / 3
    total = sum((y - mean) ** 2 for y in (1, 2, 4))
    assert row.r2 == pytest.approx(1 - 1.25 / total)
    assert row.mae == pytest.approx(0.5) and row.rmse == pytest.approx(math.sqrt(1.25 / 3))


def test_tree_scorer_replaces_only_the_price(spark, prepared):
    _, data, path = prepared
    stats = tables.read_scaler_stats(spark, f"{data}/scaler_stats")
    model = tables.load_model(path)
    rows = jobs.priced_rows(tables.read_parquet(spark, f"{data}/test_scaled"), stats)
    scorer = demand.tree_scorer(model, stats)
    scored = scorer.predict(scorer.prepare(rows), {"price": "same"})
    plain = demand.predict(model, rows)
    both = scored.select("product_id", "SHOP_DATE", "same").join(plain, ["product_id", "SHOP_DATE"])
    assert both.where("abs(same - prediction) > 1e-6").count() <= both.count() * 0.01


def test_full_evaluation_writes_reports(spark, prepared):
    folder, data, model = prepared
    reports = str(folder / "reports")
    report = jobs.run_full_evaluation(spark, data, model, reports, SETTINGS, num_products=3, n_bootstraps=10)
    assert report.count() == 3
    log = tables.read_parquet(spark, f"{reports}/policy_results")
    assert log.count() == 3 * 3 * 19
    head = spark.read.option("header", True).csv(f"{reports}/evaluation_summary")
    assert head.count() == 3 and "total_revenue_lower" in head.columns
    assert spark.read.option("header", True).csv(f"{reports}/detailed_evaluation_results").count() == log.count()
    totals = {r.policy: r.total_revenue for r in kpi.compute_kpis(log).collect()}
    assert totals["Best Multiplier"] > 0


def test_product_evaluation_report(spark, prepared):
    folder, data, model = prepared
    reports = str(folder / "products")
    products, portfolio = jobs.evaluate_products(spark, data, model, reports, SETTINGS, episodes=2)
    assert products.count() == 5
    csv = spark.read.option("header", True).csv(f"{reports}/evaluation_results")
    assert set(csv.columns) == set(evaluation.REPORT_TITLES.values())
    total = portfolio.first()
    assert total.total_agent_profit == pytest.approx(sum(r.agent_profit_mean for r in products.collect()))


def test_scan_reads_four_columns_and_pushes_the_filter(spark):
    from pricetide.operators.panel import daily_panel

    df = daily_panel(transactions_from_lines(spark, SMALLEST))
    plan = df._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert all(c in schema for c in ("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"))
    assert "l_orderkey" not in schema and "l_discount" not in schema
    assert plan.count("Exchange") == 1


def test_features_shuffle_once_by_product(spark):
    from pricetide.operators.features import time_series_features
    from pricetide.operators.panel import daily_panel

    df = time_series_features(daily_panel(transactions_from_lines(spark, SMALLEST)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(PROD_CODE") == 1
    assert plan.count("Exchange") == 2


def test_command_line():
    args = parser().parse_args(["prepare", "--raw", "r", "--out", "o", "--train-end", "2000-01-10"])
    assert args.train_end == dt.date(2000, 1, 10) and args.top_n == 100
    with pytest.raises(SystemExit):
        parser().parse_args(["prepare", "--out", "o"])
