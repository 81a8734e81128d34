"""Every operator as a query over whole tables.

Order lines stand in for transactions and suppliers for products unless a query says otherwise.
Doubles are rounded only here, at the output, so that two engines' sums compare equal.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalog.oracle import ROUNDING_SHIFT
from pricetide.config import DATE, FEATURES, PRODUCT, PRODUCT_ID, TARGET, WEEK, Settings
from pricetide.functions.numeric import improvement_pct, standardise
from pricetide.operators import backtest, boosting, demand, episodes, evaluation, features, kpi, panel, pricing, registry, scaling, splits
from pricetide.plans import evaluation as evaluation_plan
from pricetide.plans import preparation
from pricetide.schemas import standard_product_id
from pricetide.session import materialize, shared_folder
from pricetide.sources import tables, transactions

SETTINGS = replace(Settings(), train_end=dt.date(2000, 1, 10), val_end=dt.date(2000, 4, 10))
SEED = SETTINGS.seed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(column: str | Column, places: int, name: str | None = None) -> Column:
    """Round for comparison. Prices are short decimals, so many means lie exactly on a rounding
    boundary, where the last bit of a sum decides; a shift by a hundredth of the last place, in both
    engines, moves them off it."""
    value = F.col(column) if isinstance(column, str) else column
    shift = F.lit(ROUNDING_SHIFT) * F.lit(float(f"1e-{places}"))
    return F.round(value.cast("double") + shift, places).alias(name or column)


# --- shared inputs -----------------------------------------------------------------------------

def lines(spark: SparkSession, sf: str, product: str = "supplier") -> DataFrame:
    return transactions.transactions_from_lines(spark, sf, product)


def daily(spark: SparkSession, sf: str, product: str = "supplier") -> DataFrame:
    return panel.daily_panel(lines(spark, sf, product))


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    return standard_product_id(daily(spark, sf))


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """The panel as a written table, for queries that read it more than once."""
    return materialize(keyed(spark, sf))


def train_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(DATE) <= F.lit(SETTINGS.train_end))


def test_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(DATE) > F.lit(SETTINGS.val_end))


def priced(df: DataFrame) -> DataFrame:
    """Rows with their price and unit cost."""
    constants = registry.median_prices(df, PRODUCT_ID)
    return test_rows(df).join(constants, PRODUCT_ID, "left") \
        .withColumn("price", F.col("avg_price")) \
        .withColumn("unit_cost", pricing.unit_cost(F.col("median_price"), SETTINGS.policy_cost))


def straight_lines(df: DataFrame) -> demand.Scorer:
    return demand.line_scorer(demand.price_lines(train_rows(df)))


def results(spark: SparkSession, sf: str, **options) -> DataFrame:
    df = stored(spark, sf)
    rows = test_rows(df).withColumn("price", F.col("avg_price"))
    return evaluation_plan.policy_results(
        rows, train_rows(df), registry.product_constants(df, PRODUCT_ID), straight_lines(df), SETTINGS, **options)


# --- transactions and panel --------------------------------------------------------------------

@query
def load_transactions(spark, sf):
    raw = transactions.raw_transactions_from_lines(spark, sf)
    return transactions.clean_transactions(raw).select(DATE, WEEK, PRODUCT, "SPEND", "QUANTITY")


@query
def line_prices(spark, sf):
    return panel.line_prices(lines(spark, sf, "part")).select(PRODUCT, DATE, "QUANTITY", rounded("PRICE", 6))


def _panel_columns(df: DataFrame) -> DataFrame:
    return df.select(DATE, PRODUCT, rounded("avg_price", 6), "total_units", rounded("total_sales", 2), WEEK)


@query
def daily_panel(spark, sf):
    return _panel_columns(daily(spark, sf))


@query
def daily_panel_by_part(spark, sf):
    return _panel_columns(daily(spark, sf, "part"))


@query
def daily_panel_by_brand(spark, sf):
    return _panel_columns(daily(spark, sf, "brand"))


def _completeness(df: DataFrame) -> DataFrame:
    return df.select(PRODUCT, "min_date", "max_date", F.col("unique_periods").cast("long").alias("unique_periods"),
                     F.col("missing_periods").cast("long").alias("missing_periods"))


@query
def date_completeness(spark, sf):
    return _completeness(panel.date_completeness(daily(spark, sf)))


@query
def date_completeness_by_week(spark, sf):
    return _completeness(panel.date_completeness(daily(spark, sf, "brand"), "week"))


@query
def date_completeness_by_month(spark, sf):
    return _completeness(panel.date_completeness(daily(spark, sf), "month"))


@query
def product_sales(spark, sf):
    return panel.complete_products(daily(spark, sf), "month").select(PRODUCT, rounded("total_sales", 2))


@query
def top_products(spark, sf):
    best = panel.top_products(daily(spark, sf), SETTINGS.top_n, "month")
    return best.select("rank", PRODUCT, rounded("total_sales", 2))


@query
def top_brands(spark, sf):
    best = panel.top_products(daily(spark, sf, "brand"), 10, "week")
    return best.select("rank", PRODUCT, rounded("total_sales", 2))


@query
def top_product_panel(spark, sf):
    df = daily(spark, sf)
    return _panel_columns(panel.keep_products(df, panel.top_products(df, 20, "month")))


@query
def first_products(spark, sf):
    return panel.first_products(daily(spark, sf), 5)


# --- features ----------------------------------------------------------------------------------

@query
def calendar_features(spark, sf):
    days = lines(spark, sf).select(DATE).distinct().withColumns(features.calendar_columns())
    return days.select(DATE, "day_of_week", "month", "year", "day_of_month", "week_of_year", "is_weekend",
                       *[rounded(c, 6) for c in ("day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos")])


@query
def lag_features(spark, sf):
    return daily(spark, sf).withColumns(features.lag_columns()).select(
        DATE, PRODUCT, TARGET, *features.lag_columns())


@query
def rolling_features(spark, sf):
    return daily(spark, sf).withColumns(features.rolling_columns()).select(
        DATE, PRODUCT, TARGET, *[rounded(c, 6) for c in features.rolling_columns()])


@query
def price_features(spark, sf):
    return daily(spark, sf).withColumns(features.price_columns()).select(
        DATE, PRODUCT, *[rounded(c, 6) for c in features.price_columns()])


@query
def row_index(spark, sf):
    return daily(spark, sf).withColumns(features.row_index_columns()).select(
        DATE, PRODUCT, "row_index", "days_since_price_change")


def _feature_output(df: DataFrame, product: str = PRODUCT) -> DataFrame:
    whole = {"lag_1_units", "lag_7_units", "lag_14_units", "lag_28_units", "day_of_month", "week_of_year",
             "is_weekend", "days_since_price_change"}
    places = {"total_sales": 2}
    return df.select(DATE, product, TARGET, WEEK, "day_of_week", "month", "year",
                     *[F.col(c) if c in whole else rounded(c, places.get(c, 6)) for c in FEATURES])


@query
def feature_panel(spark, sf):
    return _feature_output(features.time_series_features(daily(spark, sf)))


@query
def feature_panel_by_brand(spark, sf):
    return _feature_output(features.time_series_features(daily(spark, sf, "brand")))


@query
def feature_panel_in_blocks(spark, sf):
    """The features of few products with long histories: windows over blocks of 256 rows."""
    return _feature_output(features.time_series_features(materialize(daily(spark, sf, "brand")), 256))


# --- splits and scaling ------------------------------------------------------------------------

def feature_splits(spark: SparkSession, sf: str) -> DataFrame:
    return preparation.split_features(daily(spark, sf), SETTINGS)


@query
def split_counts(spark, sf):
    df = splits.split_by_date(daily(spark, sf), SETTINGS.train_end, SETTINGS.val_end)
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min(DATE).alias("first_date"),
                                   F.max(DATE).alias("last_date"))


@query
def complete_feature_rows(spark, sf):
    df = splits.drop_null_rows(feature_splits(spark, sf))
    return df.groupBy("split", PRODUCT_ID).agg(F.count(F.lit(1)).alias("n_rows"))


@query
def standard_scaler_stats(spark, sf):
    train = splits.as_float32(feature_splits(spark, sf).where("split = 'train'"), FEATURES)
    return scaling.fit_scalers(train, FEATURES).select(
        "column", "kind", rounded("center", 4), rounded("scale", 4))


@query
def robust_scaler_stats(spark, sf):
    train = splits.as_float32(feature_splits(spark, sf).where("split = 'train'"), FEATURES)
    values = materialize(train.select(*FEATURES))
    return scaling.fit_scalers(values, FEATURES, "robust").select(
        "column", "kind", rounded("center", 4), rounded("scale", 4))


def scaled_splits(spark: SparkSession, sf: str, warmup: str) -> DataFrame:
    rows = materialize(feature_splits(spark, sf))
    train = splits.as_float32(rows.where("split = 'train'"), FEATURES)
    return preparation.scaled_split(rows, scaling.fit_scalers(train, FEATURES), FEATURES, warmup)


@query
def scaled_panel(spark, sf):
    return scaled_splits(spark, sf, "mean").select(
        "split", DATE, PRODUCT_ID, TARGET, *[rounded(c, 3) for c in FEATURES])


@query
def scaled_panel_without_warmup(spark, sf):
    return scaled_splits(spark, sf, "drop").groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), *[rounded(F.avg(c), 3, c) for c in FEATURES])


@query
def prepared_top_products(spark, sf):
    """Best sellers only, all the way to scaled columns."""
    df = materialize(daily(spark, sf))
    top = panel.keep_products(df, panel.top_products(df, 20, "month"))
    rows = materialize(preparation.split_features(top, SETTINGS))
    train = splits.as_float32(rows.where("split = 'train'"), FEATURES)
    scaled = preparation.scaled_split(rows, scaling.fit_scalers(train, FEATURES), FEATURES, "mean")
    return scaled.select("split", DATE, PRODUCT_ID, TARGET, *[rounded(c, 3) for c in FEATURES])


@query
def unscaled_prices(spark, sf):
    """Scaling and its inverse give the price back."""
    df = daily(spark, sf)
    stats = scaling.fit_scalers(train_rows(df), ["avg_price"])
    back = scaling.apply_scalers(scaling.apply_scalers(df, stats, ["avg_price"]), stats, ["avg_price"], inverse=True)
    return back.select(DATE, PRODUCT, rounded("avg_price", 5))


# --- registry ----------------------------------------------------------------------------------

@query
def product_registry(spark, sf):
    return registry.dense_ids(standard_product_id(lines(spark, sf, "part")))


@query
def dense_product_rows(spark, sf):
    df = stored(spark, sf)
    dense = registry.to_dense(df, registry.dense_ids(df))
    return dense.groupBy("dense_id").agg(F.count(F.lit(1)).alias("n_days"), F.sum(TARGET).alias("total_units"))


@query
def median_price(spark, sf):
    return registry.median_prices(daily(spark, sf)).select(PRODUCT, rounded("median_price", 6))


@query
def global_median_price(spark, sf):
    prices = materialize(train_rows(daily(spark, sf)).select("avg_price"))
    return registry.global_median_price(prices).select(rounded("median_price", 6))


@query
def sales_volatility(spark, sf):
    return registry.sales_volatility(daily(spark, sf)).select(PRODUCT, rounded("sales_volatility", 6))


@query
def avg_daily_revenue(spark, sf):
    return registry.average_daily_revenue(daily(spark, sf), one_row_a_day=True).select(PRODUCT, rounded("avg_daily_revenue", 4))


@query
def attached_constants(spark, sf):
    """Training constants beside every row; a product not seen in training gets 0."""
    df = daily(spark, sf, "part")
    constants = registry.product_constants(train_rows(df))
    return registry.attach_constants(test_rows(df).select(DATE, PRODUCT), constants).select(
        DATE, PRODUCT, rounded("median_price", 6), rounded("sales_volatility", 6))


# --- demand ------------------------------------------------------------------------------------

@query
def price_lines(spark, sf):
    return demand.price_lines(train_rows(keyed(spark, sf))).select(
        PRODUCT_ID, rounded("slope", 8), rounded("intercept", 4), rounded("mean_units", 6))


def predictions(spark: SparkSession, sf: str, rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    df = stored(spark, sf)
    scorer = straight_lines(df)
    return scorer.predict(scorer.prepare(rows(df)), {"avg_price": "prediction"})


def val_rows(df: DataFrame) -> DataFrame:
    return df.where((F.col(DATE) > F.lit(SETTINGS.train_end)) & (F.col(DATE) <= F.lit(SETTINGS.val_end)))


@query
def residual_noise(spark, sf):
    return demand.residual_noise(predictions(spark, sf, val_rows)).select(rounded("noise_std", 6))


@query
def model_quality(spark, sf):
    return demand.model_quality(predictions(spark, sf, test_rows)).select(
        rounded("r2", 6), rounded("mae", 6), rounded("rmse", 6))


@query
def prediction_series(spark, sf):
    df = predictions(spark, sf, test_rows)
    picked = episodes.random_product(df, SEED)
    return df.join(picked, PRODUCT_ID, "left_semi").select(PRODUCT_ID, DATE, TARGET, rounded("prediction", 5))


@query
def random_product(spark, sf):
    return episodes.random_product(standard_product_id(lines(spark, sf, "part")), SEED)


@query
def simulated_demand(spark, sf):
    df = predictions(spark, sf, test_rows)
    noise = demand.demand_noise(SETTINGS.noise_std, SEED, F.col(PRODUCT_ID), F.col(DATE))
    units = demand.simulate_demand(F.col("prediction"), noise)
    return df.select(PRODUCT_ID, DATE, rounded(units, 5, "demand"), rounded(noise, 6, "noise"))


# --- pricing -----------------------------------------------------------------------------------

@query
def median_rule(spark, sf):
    df = materialize(daily(spark, sf))
    median = registry.global_median_price(train_rows(df)).scalar()
    rows = test_rows(df).withColumn("median", median)
    multiplier = pricing.median_multiplier(F.col("avg_price"), F.col("median"))
    return rows.select(DATE, PRODUCT, rounded(multiplier, 6, "price_multiplier"))


@query
def nearest_action(spark, sf):
    df = daily(spark, sf)
    rows = test_rows(df).join(registry.median_prices(train_rows(df)), PRODUCT)
    multiplier = pricing.median_multiplier(F.col("avg_price"), F.col("median_price"))
    nearest = pricing.nearest_action(multiplier, SETTINGS.multipliers)
    return rows.select(DATE, PRODUCT, nearest["index"].alias("action_index"), nearest["action"].alias("action"))


@query
def historical_action(spark, sf):
    """Each line's price as the history; the day after every sale as the request."""
    history = panel.line_prices(lines(spark, sf)).select(F.col(PRODUCT).alias(PRODUCT_ID), DATE,
                                                         F.col("PRICE").alias("price"))
    requests = history.select(PRODUCT_ID, F.date_add(DATE, 1).alias(DATE)).distinct()
    found = pricing.historical_actions(requests, history, DATE, 500.0, 3000.0)
    return found.select(PRODUCT_ID, DATE, rounded("action", 6))


@query
def candidate_prices(spark, sf):
    grid = pricing.candidate_prices(daily(spark, sf), SETTINGS.multipliers, "avg_price")
    return grid.select(DATE, PRODUCT, "action_index", "price_multiplier", rounded("new_price", 4))


@query
def counterfactual_profit(spark, sf):
    df = stored(spark, sf)
    grid = pricing.counterfactual(priced(df), straight_lines(df), SETTINGS.multipliers)
    return grid.select(DATE, PRODUCT_ID, "action_index", "units", rounded("revenue", 2), rounded("profit", 2))


@query
def best_multiplier(spark, sf):
    df = stored(spark, sf)
    scorer = straight_lines(df)
    best = pricing.best_multiplier(scorer.prepare(priced(df)), scorer, SETTINGS.multipliers)
    return best.select(DATE, PRODUCT_ID, "best_multiplier", rounded("best_profit", 2))


@query
def best_revenue_on_grid(spark, sf):
    df = stored(spark, sf)
    scorer = straight_lines(df)
    grid = pricing.action_grid(SETTINGS.action_low, SETTINGS.action_high, 9)
    best = pricing.best_multiplier(scorer.prepare(priced(df)), scorer, grid, measure="revenue")
    return best.select(DATE, PRODUCT_ID, rounded("best_multiplier", 6), rounded("best_revenue", 2))


# --- episodes and backtest ---------------------------------------------------------------------

@query
def episode_rows(spark, sf):
    cut = episodes.episode_rows(test_rows(keyed(spark, sf)), SETTINGS.horizon)
    return cut.select(PRODUCT_ID, DATE, "step", F.col("steps").cast("int").alias("steps"), "next_date")


@query
def random_start_episodes(spark, sf):
    cut = episodes.episode_rows(test_rows(keyed(spark, sf)), SETTINGS.horizon, seed=SEED)
    return cut.select(PRODUCT_ID, DATE, "step", F.col("steps").cast("int").alias("steps"))


@query
def horizon_rows(spark, sf):
    head = episodes.first_rows(test_rows(keyed(spark, sf)), SETTINGS.horizon)
    return head.select(PRODUCT_ID, DATE, "position", rounded("avg_price", 6))


@query
def aligned_by_position(spark, sf):
    df = stored(spark, sf)
    return episodes.align_rows(test_rows(df), df).select(PRODUCT_ID, DATE, rounded("avg_price", 6), rounded("raw_price", 6))


@query
def aligned_by_date(spark, sf):
    df = keyed(spark, sf)
    return episodes.align_rows(test_rows(df), df, "date").select(
        PRODUCT_ID, DATE, rounded("avg_price", 6), rounded("raw_price", 6))


def _log(df: DataFrame) -> DataFrame:
    return df.select("date", PRODUCT_ID, "policy", rounded("price_multiplier", 6), rounded("price", 5),
                     rounded("reward", 2), "units_sold")


@query
def policy_backtest(spark, sf):
    return _log(results(spark, sf))


@query
def policy_backtest_own_date(spark, sf):
    return _log(results(spark, sf, log="own_date", measure="revenue"))


@query
def noisy_policy_backtest(spark, sf):
    return _log(results(spark, sf, noise_std=SETTINGS.noise_std))


@query
def raw_price_backtest(spark, sf):
    """Base price from the raw panel at the same position, cost at 0.7 of the median."""
    df = stored(spark, sf)
    aligned = episodes.align_rows(priced(df), df).withColumn("price", F.col("raw_price")) \
        .withColumn("unit_cost", pricing.unit_cost(F.col("median_price"), 0.7))
    policies = {pricing.HISTORICAL: pricing.historical_multiplier(), "Discount": F.lit(0.93)}
    return _log(backtest.evaluate_policies(aligned, policies, straight_lines(df), SETTINGS.multipliers,
                                           SETTINGS.horizon))


@query
def continuous_action_backtest(spark, sf):
    """The policy's own multiplier is applied, not the nearest listed one."""
    df = stored(spark, sf)
    policies = {pricing.HISTORICAL: pricing.historical_multiplier(), "Discount": F.lit(0.93)}
    return _log(backtest.evaluate_policies(priced(df), policies, straight_lines(df), None, SETTINGS.horizon))


# --- KPIs --------------------------------------------------------------------------------------

def _kpi_columns() -> list[Column]:
    return ["policy", rounded("total_revenue", 2), "total_units_sold", rounded("average_price", 5),
            rounded("average_daily_revenue", 4), rounded("price_volatility", 5), "total_price_changes"]


@query
def policy_kpis(spark, sf):
    return kpi.compute_kpis(results(spark, sf)).select(*_kpi_columns())


@query
def bootstrap_replicates(spark, sf):
    parts = materialize(kpi.product_parts(results(spark, sf)))
    return kpi.bootstrap_replicates(parts, SETTINGS.bootstraps, SEED).select("replicate", *_kpi_columns())


@query
def bootstrap_replicates_counted(spark, sf):
    """A product drawn twice counts twice."""
    parts = materialize(kpi.product_parts(results(spark, sf)))
    return kpi.bootstrap_replicates(parts, SETTINGS.bootstraps, SEED, counted=True).select("replicate", *_kpi_columns())


def _bounds() -> list[Column]:
    return [rounded(f"{k}_{side}", 3) for k in kpi.KPIS for side in ("lower", "upper")]


@query
def bootstrap_ci(spark, sf):
    return kpi.bootstrap_intervals(results(spark, sf), SETTINGS.bootstraps, SETTINGS.ci_level, SEED).select(
        "policy", *_bounds())


@query
def policy_report(spark, sf):
    report = kpi.kpi_report(results(spark, sf), SETTINGS.bootstraps, SETTINGS.ci_level, SEED)
    return report.select(*_kpi_columns(), *_bounds())


# --- per-product evaluation --------------------------------------------------------------------

@query
def price_step_volatility(spark, sf):
    return evaluation.price_step_volatility(daily(spark, sf), [PRODUCT], DATE, "avg_price").select(
        PRODUCT, rounded("price_volatility", 5))


def _baseline(spark: SparkSession, sf: str, align: str, noise_std: float = 0.0) -> DataFrame:
    df = stored(spark, sf)
    rows = test_rows(df).withColumn("price", F.col("avg_price"))
    return evaluation.historical_baseline(rows, df, straight_lines(df), SETTINGS.horizon, align=align,
                                          noise_std=noise_std).select(
        PRODUCT_ID, rounded("historical_profit", 2), rounded("historical_volatility", 5))


@query
def historical_baseline(spark, sf):
    return _baseline(spark, sf, "position")


@query
def historical_baseline_with_noise(spark, sf):
    return _baseline(spark, sf, "position", 2.0)


@query
def historical_baseline_by_date(spark, sf):
    return _baseline(spark, sf, "date")


def evaluated_products(spark: SparkSession, sf: str, episode_count: int, noise_std: float,
                       settings: Settings = SETTINGS) -> DataFrame:
    df = stored(spark, sf)
    rows = test_rows(df).withColumn("price", F.col("avg_price"))
    return evaluation.product_evaluation(
        rows, df, registry.product_constants(df, PRODUCT_ID), straight_lines(df), settings, episode_count, noise_std)


def _evaluation_columns(df: DataFrame) -> DataFrame:
    return df.select(PRODUCT_ID, *[rounded(c, 3) for c in df.columns if c != PRODUCT_ID])


@query
def product_evaluation(spark, sf):
    return _evaluation_columns(evaluated_products(spark, sf, 1, 0.0))


@query
def product_evaluation_cost_ratio(spark, sf):
    return _evaluation_columns(evaluated_products(spark, sf, 1, 0.0, replace(SETTINGS, cost_ratio=0.6)))


@query
def product_evaluation_with_noise(spark, sf):
    return _evaluation_columns(evaluated_products(spark, sf, 3, 2.0))


@query
def portfolio_summary(spark, sf):
    total = evaluation.portfolio_summary(evaluated_products(spark, sf, 1, 0.0))
    return total.select(*[rounded(c, 2) for c in total.columns])


@query
def sales_improvement(spark, sf):
    """Improvement in percent of test over training revenue per day; infinite without training sales."""
    df = daily(spark, sf, "part")
    now = registry.average_daily_revenue(test_rows(df), one_row_a_day=True).withColumnRenamed("avg_daily_revenue", "now")
    before = registry.average_daily_revenue(train_rows(df), one_row_a_day=True).withColumnRenamed("avg_daily_revenue", "before")
    joined = registry.attach_constants(now, before)
    gain = improvement_pct(F.col("now"), F.col("before"))
    return joined.select(PRODUCT, F.when(gain == float("inf"), True).otherwise(False).alias("is_new"),
                         rounded(F.when(gain < float("inf"), gain), 4, "gain_pct"))


# --- boosted trees -----------------------------------------------------------------------------

#: Fitted models by application and folder: the queries below share one training.
_FITTED: dict[tuple[str, str], boosting.BoostedTrees] = {}


def boosted(spark: SparkSession, sf: str):
    """Scaled rows, scaler table and the configured model, trained on the training split."""
    rows = materialize(feature_splits(spark, sf))
    train = splits.as_float32(rows.where("split = 'train'"), FEATURES)
    stats = materialize(scaling.fit_scalers(train, FEATURES))
    scaled = materialize(preparation.scaled_split(rows, stats, FEATURES))
    known = spark.sparkContext.applicationId, sf
    if known not in _FITTED:
        _FITTED[known] = demand.train_demand_model(scaled.where("split = 'train'"), settings=SETTINGS)
    return scaled, stats, _FITTED[known]


def boosted_rows(spark: SparkSession, sf: str):
    """Priced test rows with the unit cost, the scaler table and the model."""
    scaled, stats, model = boosted(spark, sf)
    constants = registry.median_prices(keyed(spark, sf), PRODUCT_ID)
    rows = evaluation_plan.priced_rows(scaled.where("split = 'test'").drop("split"), stats) \
        .join(constants, PRODUCT_ID, "left").withColumn("unit_cost", pricing.unit_cost(F.col("median_price"), SETTINGS.policy_cost))
    return rows, stats, model


@query
def boosted_demand_quality(spark, sf):
    scaled, _, model = boosted(spark, sf)
    rows = demand.predict(model, scaled.where("split = 'test'"))
    return demand.model_quality(rows).select(rounded("r2", 4), rounded("mae", 4), rounded("rmse", 4))


@query
def boosted_demand_facts(spark, sf):
    """What is known for certain of the configured model: its size, a finite prediction for every test row, and a smaller
    absolute error there than the product's mean over the training rows has."""
    scaled, _, model = boosted(spark, sf)
    means = scaled.where("split = 'train'").groupBy(PRODUCT_ID).agg(F.avg(TARGET).alias("mean_units"))
    rows = demand.predict(model, scaled.where("split = 'test'")).join(means, PRODUCT_ID, "left")
    p = F.col("prediction")
    return rows.agg(
        F.lit(len(model.trees)).alias("trees"), F.lit(max(len(t.values) for t in model.trees)).alias("most_leaves"),
        F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(p) < float("inf")).alias("finite"),
        (F.avg(F.abs(F.col(TARGET) - p)) < F.avg(F.abs(F.col(TARGET) - F.coalesce("mean_units", F.lit(0.0))))).alias("better_than_mean"))


@query
def boosted_price_response(spark, sf):
    """Five candidate prices read off the step function of price equal five full predictions, for every test row."""
    rows, stats, model = boosted_rows(spark, sf)
    center, scale = scaling.scaler_values(stats, ["avg_price"])["avg_price"]
    actions = SETTINGS.multipliers
    scorer = demand.tree_scorer(model, stats)
    df = rows.where(F.col("price").isNotNull()).withColumns({f"p{k}": F.col("price") * a for k, a in enumerate(actions)})
    df = scorer.predict(scorer.prepare(df), {f"p{k}": f"u{k}" for k in range(len(actions))})
    plain = demand.model_inputs(df, model.features)
    at = model.features.index("avg_price")
    for k in range(len(actions)):
        inputs = [*plain[:at], standardise(F.col(f"p{k}"), center, scale), *plain[at + 1:]]
        df = df.withColumn(f"full{k}", boosting.scores(model, inputs))
    return df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(F.abs(F.col(f"u{k}") - F.col(f"full{k}")) < 1e-8).alias(f"equal_{k}") for k in range(len(actions))])


@query
def continuous_best_price(spark, sf):
    """The exact best price between the lowest and highest action against the best of 5 and of 41 candidates."""
    rows, stats, model = boosted_rows(spark, sf)
    price, low, high = F.col("price"), SETTINGS.action_low, SETTINGS.action_high
    rows = rows.where((price > 0) & F.col("median_price").isNotNull())
    df = demand.price_steps(rows, model, stats, price * low, price * high)
    df = pricing.best_price_on_steps(df).withColumnsRenamed({"best_price": "exact_price", "best_profit": "exact_profit"})
    scorer = demand.tree_scorer(model, stats)
    for name, grid in (("few", SETTINGS.multipliers), ("many", pricing.action_grid(low, high, 41))):
        df = pricing.best_multiplier(df, scorer, grid).withColumnRenamed("best_profit", f"profit_{name}").drop(
            "best_price", "best_multiplier", "best_predicted")
    inside = (F.col("exact_price") >= price * low - 1e-9) & (F.col("exact_price") <= price * high + 1e-9)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(inside).alias("inside"),
        F.count_if(F.col("exact_profit") >= F.col("profit_few") - 1e-6).alias("not_below_5"),
        F.count_if(F.col("exact_profit") >= F.col("profit_many") - 1e-6).alias("not_below_41"))


@query
def boosted_product_evaluation(spark, sf):
    scaled, stats, model = boosted(spark, sf)
    df = materialize(keyed(spark, sf))
    rows = evaluation_plan.priced_rows(scaled.where("split = 'test'").drop("split"), stats)
    return _evaluation_columns(evaluation.product_evaluation(
        rows, df, registry.product_constants(df, PRODUCT_ID), demand.tree_scorer(model, stats), SETTINGS,
        noise_std=SETTINGS.noise_std))


# --- stores and jobs ---------------------------------------------------------------------------

@query
def stored_panel(spark, sf):
    """The daily panel written and read as the panel aggregated earlier."""
    path = f"{shared_folder(spark)}/daily"
    tables.write_parquet(daily(spark, sf), path)
    return _panel_columns(tables.read_daily_panel(spark, path))


@query
def stored_top_products(spark, sf):
    path = f"{shared_folder(spark)}/top_products"
    tables.write_product_ids(panel.top_products(daily(spark, sf), SETTINGS.top_n, "month"), path)
    return tables.read_product_ids(spark, path)


@query
def stored_product_registry(spark, sf):
    path = f"{shared_folder(spark)}/registry"
    tables.write_product_registry(registry.dense_ids(standard_product_id(lines(spark, sf, "part"))), path)
    return tables.read_product_registry(spark, path)


@query
def raw_product_rows(spark, sf):
    """Raw ids to dense ones and back, through the stored registry."""
    df, path = keyed(spark, sf), f"{shared_folder(spark)}/registry"
    tables.write_product_registry(registry.dense_ids(df), path)
    known = tables.read_product_registry(spark, path)
    dense = df.join(known, PRODUCT_ID).drop(PRODUCT_ID)
    return registry.to_raw(dense, known).groupBy(PRODUCT_ID).agg(
        F.count(F.lit(1)).alias("n_days"), F.sum(TARGET).alias("total_units"))


@query
def stored_scaler_stats(spark, sf):
    path = f"{shared_folder(spark)}/scaler_stats"
    train = splits.as_float32(feature_splits(spark, sf).where("split = 'train'"), FEATURES)
    tables.write_scaler_stats(scaling.fit_scalers(train, FEATURES), path)
    return tables.read_scaler_stats(spark, path).select("column", "kind", rounded("center", 4), rounded("scale", 4))


@query
def stored_csv_report(spark, sf):
    """A report written as CSV and read with its types; the date comes back as a date."""
    df, path = daily(spark, sf, "brand"), f"{shared_folder(spark)}/report"
    tables.write_csv_report(df, path)
    return _panel_columns(tables.read_csv_report(spark, path, df.schema))


@query
def stored_feature_names(spark, sf):
    """The model's inputs in trained order, out of the stored model."""
    _, _, model = boosted(spark, sf)
    path = f"{shared_folder(spark)}/model"
    tables.save_model(model, path)
    names = tables.feature_names(tables.load_model(path))
    return spark.createDataFrame(list(enumerate(names)), "place int, feature string")


@query
def registry_job(spark, sf):
    """Registry and revenue per day of a stored scaled split."""
    scaled, folder = scaled_splits(spark, sf, "missing"), shared_folder(spark)
    tables.write_parquet(scaled.where("split = 'test'"), f"{folder}/test_scaled")
    rows, known, revenue = preparation.load_data_registry(spark, f"{folder}/test_scaled", f"{folder}/registry")
    counts = rows.groupBy(PRODUCT_ID, "dense_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(revenue, PRODUCT_ID).select(PRODUCT_ID, "dense_id", "n_rows", rounded("avg_daily_revenue", 3))


@query
def prepare_data_job(spark, sf):
    """The preparation job from transactions to the three scaled splits on disk."""
    folder = shared_folder(spark)
    preparation.prepare_data(spark, folder, settings=replace(SETTINGS, top_n=20), grain="month", transactions=lines(spark, sf))
    made = None
    for split in splits.SPLITS:
        part = splits.zero_nan(tables.read_parquet(spark, f"{folder}/{split}_scaled")).select(
            F.lit(split).alias("split"), DATE, PRODUCT_ID, TARGET, *[rounded(c, 3) for c in FEATURES])
        made = part if made is None else made.unionByName(part)
    return made


def _evaluation_folder(spark: SparkSession, sf: str) -> str:
    """Prepared tables and the stored model, as the evaluation jobs read them."""
    folder = shared_folder(spark)
    tables.write_parquet(daily(spark, sf), f"{folder}/panel")
    preparation.prepare_data(spark, folder, panel_path=f"{folder}/panel", settings=SETTINGS)
    tables.write_parquet(tables.read_daily_panel(spark, f"{folder}/panel"), f"{folder}/daily")
    tables.save_model(boosted(spark, sf)[2], f"{folder}/model")
    return folder


@query
def evaluate_policies_job(spark, sf):
    """The full policy evaluation with both CSV reports; what is certain of its log, and that the reports are whole."""
    folder = _evaluation_folder(spark, sf)
    report = evaluation_plan.run_full_evaluation(spark, folder, f"{folder}/model", f"{folder}/reports", SETTINGS)
    log = tables.read_parquet(spark, f"{folder}/reports/policy_results")
    csv = tables.read_csv_report(spark, f"{folder}/reports/detailed_evaluation_results", log.schema)
    summary = tables.read_csv_report(spark, f"{folder}/reports/evaluation_summary", report.schema)
    known = csv.groupBy("policy").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(PRODUCT_ID).alias("n_products"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    held = summary.select("policy", ((F.col("total_revenue_lower") <= F.col("total_revenue_upper"))
                                     & F.col("average_price").isNotNull()).alias("has_intervals"))
    return known.join(held, "policy")


@query
def evaluate_products_job(spark, sf):
    """The per-product evaluation with its CSV report: all test products are in it, and the totals add up."""
    folder = _evaluation_folder(spark, sf)
    products, portfolio = evaluation_plan.evaluate_products(spark, folder, f"{folder}/model", f"{folder}/reports", SETTINGS)
    titles = evaluation.report_columns(products).schema
    csv = tables.read_csv_report(spark, f"{folder}/reports/evaluation_results", titles)
    profit = evaluation.REPORT_TITLES["agent_profit_mean"]
    sums = csv.agg(F.count(F.lit(1)).alias("n_products"), F.sum(F.abs(profit)).alias("size"), F.sum(profit).alias("total"))
    return sums.crossJoin(portfolio).select(  # one row each
        "n_products", (F.abs(F.col("total") - F.col("total_agent_profit")) <= 1e-9 * F.col("size")).alias("adds_up"))


@query
def panel_in_two_steps(spark, sf):
    """The panel built from the lines up to a date and then from all later ones and some late ones: as built at once."""
    path, df = f"{shared_folder(spark)}/panel_parts", lines(spark, sf)
    late = (F.col(DATE) > F.lit(SETTINGS.train_end)) | (F.col("QUANTITY") == 7)
    tables.add_to_panel(spark, df.where(~late), path, "month")
    tables.add_to_panel(spark, df.where(late), path, "month")
    return _panel_columns(panel.finished_panel(tables.read_panel_parts(spark, path)))


@query
def registry_with_arrivals(spark, sf):
    """Products of the training days first, then all others: old numbers stay."""
    df, folder = standard_product_id(lines(spark, sf, "part")), shared_folder(spark)
    tables.write_product_registry(registry.dense_ids(train_rows(df)), f"{folder}/first")
    first = tables.read_product_registry(spark, f"{folder}/first")
    tables.write_product_registry(registry.extended_ids(first, df), f"{folder}/second")
    return tables.read_product_registry(spark, f"{folder}/second")
