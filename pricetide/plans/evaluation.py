"""Model and policy evaluation jobs over the prepared tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import PRODUCT_ID, Settings
from ..functions.numeric import unstandardise
from ..operators.backtest import evaluate_policies
from ..operators.demand import (Scorer, model_quality, predict, prediction_series, residual_noise, train_demand_model,
                                tree_scorer)
from ..operators.episodes import random_product
from ..operators.evaluation import portfolio_summary, product_evaluation, report_columns
from ..operators.kpi import kpi_report
from ..operators.panel import first_products
from ..operators.pricing import (BEST, HISTORICAL, RULE_MEDIAN, best_multiplier, historical_multiplier,
                                 median_multiplier, unit_cost)
from ..operators.registry import global_median_price, product_constants
from ..operators.scaling import scaler_values
from ..operators.splits import zero_nan
from ..schemas import standard_product_id
from ..sources import tables


def train_demand(spark: SparkSession, data_dir: str, model_path: str, settings: Settings = Settings(),
                 n_trees: int | None = None) -> None:
    train = tables.read_parquet(spark, f"{data_dir}/train_scaled")
    tables.save_model(train_demand_model(train, n_trees=n_trees, settings=settings), model_path)


def evaluate_demand(spark: SparkSession, data_dir: str, model_path: str, split: str = "test") -> DataFrame:
    """R squared, MAE and RMSE on a split."""
    rows = tables.read_parquet(spark, f"{data_dir}/{split}_scaled")
    return model_quality(predict(tables.load_model(model_path), rows))


def demand_series(spark: SparkSession, data_dir: str, model_path: str, product_id: str | None = None,
                  seed: int = 42) -> DataFrame:
    """Actual and predicted units of a given product, or of one drawn by the seed."""
    rows = tables.read_parquet(spark, f"{data_dir}/test_scaled")
    if product_id is None:
        product_id = random_product(rows, seed).first()[0]
    return prediction_series(predict(tables.load_model(model_path), rows), product_id)


def calibrate_noise(spark: SparkSession, data_dir: str, model_path: str) -> DataFrame:
    """Noise level from the validation split, over the model's own features."""
    rows = tables.read_parquet(spark, f"{data_dir}/val_scaled")
    return residual_noise(predict(tables.load_model(model_path), rows))


def priced_rows(scaled: DataFrame, stats: DataFrame) -> DataFrame:
    """Scaled rows with the unscaled ``price`` beside them; missing features count as 0."""
    rows = zero_nan(standard_product_id(scaled))
    center, scale = scaler_values(stats, ["avg_price"])["avg_price"]
    return rows.withColumn("price", unstandardise(F.col("avg_price").cast("double"), center, scale))


def standard_policies(global_median: Column) -> dict[str, Column]:
    """Observed price, median rule and profit-maximising multiplier."""
    return {
        HISTORICAL: historical_multiplier(),
        RULE_MEDIAN: median_multiplier(F.col("price"), global_median),
        BEST: F.col("best_multiplier"),
    }


def policy_results(rows: DataFrame, train_panel: DataFrame, constants: DataFrame, scorer: Scorer,
                   settings: Settings = Settings(), actions: Sequence[float] | None = None, log: str = "shifted",
                   measure: str = "profit", noise_std: float = 0.0) -> DataFrame:
    """Backtest log of the standard policies.

    The rule's median is the exact median over the unscaled training panel.
    """
    actions = settings.multipliers if actions is None else actions
    median = global_median_price(train_panel).scalar()
    priced = rows.join(constants.select(PRODUCT_ID, "median_price"), PRODUCT_ID, "left") \
        .withColumn("unit_cost", unit_cost(F.col("median_price"), settings.policy_cost)) \
        .withColumn("global_median", median)

    def prepare(df: DataFrame) -> DataFrame:
        return best_multiplier(scorer.prepare(df), scorer, settings.multipliers, measure=measure)

    return evaluate_policies(priced, standard_policies(F.col("global_median")), Scorer(prepare, scorer.predict),
                             actions, settings.horizon, log, measure, noise_std, settings.seed)


def run_full_evaluation(spark: SparkSession, data_dir: str, model_path: str, report_dir: str,
                        settings: Settings = Settings(), num_products: int | None = None,
                        n_bootstraps: int | None = None, log: str = "shifted") -> DataFrame:
    """Backtest on the test split, KPIs with intervals, and both CSV reports."""
    stats = tables.read_scaler_stats(spark, f"{data_dir}/scaler_stats")
    scaled = standard_product_id(tables.read_parquet(spark, f"{data_dir}/test_scaled"))
    if num_products is not None:
        scaled = scaled.join(first_products(scaled, num_products, PRODUCT_ID), PRODUCT_ID, "left_semi")
    panel = standard_product_id(tables.read_daily_panel(spark, f"{data_dir}/daily"))
    train_panel = panel.where(F.col("SHOP_DATE") <= F.lit(settings.train_end))
    scorer = tree_scorer(tables.load_model(model_path), stats)
    results = policy_results(priced_rows(scaled, stats), train_panel, product_constants(panel, PRODUCT_ID), scorer,
                             settings, log=log, noise_std=settings.noise_std)
    tables.write_parquet(results, f"{report_dir}/policy_results")
    stored = tables.read_parquet(spark, f"{report_dir}/policy_results")
    tables.write_csv_report(stored, f"{report_dir}/detailed_evaluation_results")
    report = kpi_report(stored, n_bootstraps or settings.bootstraps, settings.ci_level, settings.seed)
    tables.write_csv_report(report, f"{report_dir}/evaluation_summary")
    return report


def evaluate_products(spark: SparkSession, data_dir: str, model_path: str, report_dir: str,
                      settings: Settings = Settings(), episodes: int = 1, product_ids: list[str] | None = None,
                      align: str = "position") -> tuple[DataFrame, DataFrame]:
    """Per-product evaluation and portfolio totals on the test split; writes the CSV report."""
    stats = tables.read_scaler_stats(spark, f"{data_dir}/scaler_stats")
    panel = standard_product_id(tables.read_daily_panel(spark, f"{data_dir}/daily"))
    rows = priced_rows(tables.read_parquet(spark, f"{data_dir}/test_scaled"), stats)
    if product_ids:
        rows = rows.where(F.col(PRODUCT_ID).isin(product_ids))
    products = product_evaluation(rows, panel, product_constants(panel, PRODUCT_ID),
                                  tree_scorer(tables.load_model(model_path), stats), settings, episodes,
                                  settings.noise_std, align=align)
    tables.write_parquet(products, f"{report_dir}/product_evaluation")
    stored = tables.read_parquet(spark, f"{report_dir}/product_evaluation")
    tables.write_csv_report(report_columns(stored), f"{report_dir}/evaluation_results")
    return stored, portfolio_summary(stored)
