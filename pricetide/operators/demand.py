"""Demand models: training, prediction at any price, and fit checks.

A ``Scorer`` answers "how many units at this price" for whole tables. ``prepare`` adds what the
model needs to every row once; ``predict`` then adds one column of expected units per price column.
Neither changes the number of rows or shuffles, so scoring five prices costs five expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DATE, FEATURES, PRODUCT, PRODUCT_ID, TARGET, Settings
from ..functions.noise import hash_normal
from ..functions.numeric import non_negative, standardise, unstandardise
from . import boosting
from .boosting import BoostedTrees
from .scaling import scaler_values

# Fixed value: how the columns of product categories begin.
CATEGORY_PREFIX = "PROD_CATEGORY_DEP_"


@dataclass(frozen=True)
class Scorer:
    prepare: Callable[[DataFrame], DataFrame]
    predict: Callable[[DataFrame, dict[str, str]], DataFrame]


# --- boosted trees -----------------------------------------------------------------------------

def model_inputs(df: DataFrame, features: list[str]) -> list[Column]:
    """Features as doubles in trained order. Missing values (NULL or NaN) stay missing; a product category column that
    the table does not have is 0."""
    inputs = []
    for c in features:
        if c in df.columns:
            inputs.append(F.col(c).cast("double").alias(c))
        elif c.startswith(CATEGORY_PREFIX):
            inputs.append(F.lit(0.0).alias(c))
        else:
            raise ValueError(f"feature {c!r} is missing; found {df.columns}")
    return inputs


def train_demand_model(train: DataFrame, features: list[str] | None = None, target: str = TARGET,
                       n_trees: int | None = None, settings: Settings = Settings(),
                       rows_a_task: int = boosting.ROWS_A_TASK) -> BoostedTrees:
    """Boosted leaf-wise regression trees on the scaled training split, minimising absolute error."""
    features = features or FEATURES
    keys = [c for c in (PRODUCT_ID, PRODUCT, DATE) if c in train.columns] or features
    rows = train.where(F.col(target).isNotNull()).select(
        *model_inputs(train, features), F.greatest(F.col(target).cast("double"), F.lit(0.0)).alias("_label"),
        F.xxhash64(*keys).alias("_row"))
    options = boosting.Options(
        n_trees or settings.n_trees, settings.learning_rate, settings.leaves, settings.subsample, settings.subsample,
        settings.lambda_l1, settings.lambda_l2, seed=settings.seed)
    return boosting.fit(rows, features, "_label", F.col("_row"), options, rows_a_task)


def predict(model: BoostedTrees, df: DataFrame, output: str = "prediction") -> DataFrame:
    """Expected units at the row's own (scaled) features."""
    boosting.ship(df.sparkSession)
    return df.withColumn(output, boosting.scores(model, model_inputs(df, model.features)))


def tree_scorer(model: BoostedTrees, scaler_stats: DataFrame, price: str = "avg_price") -> Scorer:
    """Score unscaled prices with a model trained on scaled features.

    Only the price is replaced; everything else, the day's sales included, stays as observed. All prices of a row are
    read off one step function of price, so five cost about as much as one.
    """
    center, scale = scaler_values(scaler_stats, [price])[price]

    def score(df: DataFrame, prices: dict[str, str]) -> DataFrame:
        at = [standardise(F.col(c), center, scale) for c in prices]
        found = boosting.responses(model, model_inputs(df, model.features), price, at)
        scored = df.withColumn("_units", found)
        return scored.withColumns({output: F.col("_units")[k] for k, output in enumerate(prices.values())}).drop("_units")

    def prepare(df: DataFrame) -> DataFrame:
        boosting.ship(df.sparkSession)
        return df

    return Scorer(prepare, score)


def price_steps(df: DataFrame, model: BoostedTrees, scaler_stats: DataFrame, low: Column, high: Column,
                output: str = "price_steps", price: str = "avg_price") -> DataFrame:
    """Add the row's predicted units as a step function of its (unscaled) price from ``low`` to ``high``: an array of
    (upper, units), where units hold up to and with the price ``upper``."""
    boosting.ship(df.sparkSession)
    center, scale = scaler_values(scaler_stats, [price])[price]
    scaled = [standardise(bound, center, scale) for bound in (low, high)]
    df = df.withColumn("_steps", boosting.price_steps(model, model_inputs(df, model.features), price, *scaled))

    def unscaled(step: Column, k: Column) -> Column:
        plain = unstandardise(step["upper"], center, scale)
        # Rounding may put the price a hair beyond the step's end; the next price below is on it.
        inside = F.when(standardise(plain, center, scale) > step["upper"], plain - F.abs(plain) * 4e-16).otherwise(plain)
        upper = F.when(k == F.size("_steps") - 1, high).otherwise(F.least(inside, high))
        return F.struct(upper.alias("upper"), step["value"].alias("units"))

    return df.withColumn(output, F.transform("_steps", unscaled)).drop("_steps")


# --- straight lines ----------------------------------------------------------------------------

def price_lines(train: DataFrame, product: str = PRODUCT_ID) -> DataFrame:
    """Least-squares line of units on price per product: a closed-form scorer for checks."""
    price, units = F.col("avg_price"), F.col(TARGET)
    return train.groupBy(product).agg(
        F.regr_slope(units, price).alias("slope"),
        F.regr_intercept(units, price).alias("intercept"),
        F.avg(units).alias("mean_units"))


def line_scorer(lines: DataFrame, product: str = PRODUCT_ID) -> Scorer:
    """Score with the product's line; its mean units where the price never moved."""
    def score(df: DataFrame, prices: dict[str, str]) -> DataFrame:
        return df.withColumns({
            output: F.coalesce(F.col("intercept") + F.col("slope") * F.col(column), F.col("mean_units"), F.lit(0.0))
            for column, output in prices.items()})

    return Scorer(lambda df: df.join(lines, product, "left"), score)


# --- simulated demand --------------------------------------------------------------------------

def unscale_units(scorer: Scorer, scaler_stats: DataFrame, units: str = TARGET) -> Scorer:
    """For a model trained on scaled units: bring predictions back to units, where the statistics
    hold the units column."""
    known = scaler_values(scaler_stats, [units])
    if units not in known:
        return scorer
    center, scale = known[units]

    def score(df: DataFrame, prices: dict[str, str]) -> DataFrame:
        return scorer.predict(df, prices).withColumns(
            {c: unstandardise(F.col(c), center, scale) for c in prices.values()})

    return Scorer(scorer.prepare, score)


def demand_noise(std: float, seed: int, *keys: Column) -> Column:
    """Normal noise, reproducible per key."""
    return F.lit(float(std)) * hash_normal(seed, *keys)


def simulate_demand(prediction: Column, noise: Column | None = None) -> Column:
    """Predicted units plus noise, never negative."""
    return non_negative(prediction if noise is None else prediction + noise)


# --- fit checks --------------------------------------------------------------------------------

def residual_noise(df: DataFrame, prediction: str = "prediction", target: str = TARGET) -> DataFrame:
    """One row: population deviation of actual minus predicted, the noise level for simulation."""
    return df.agg(F.stddev_pop(F.col(target) - F.col(prediction)).alias("noise_std"))


def model_quality(df: DataFrame, prediction: str = "prediction", target: str = TARGET) -> DataFrame:
    """One row: R squared, mean absolute error and root mean squared error."""
    y, error = F.col(target).cast("double"), F.col(target) - F.col(prediction)
    return df.agg(
        (1 - F.sum(error * error) / (F.count(error) * F.var_pop(y))).alias("r2"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"))


def prediction_series(df: DataFrame, product_id: str, product: str = PRODUCT_ID,
                      prediction: str = "prediction", target: str = TARGET) -> DataFrame:
    """Actual and predicted units of one product by date."""
    return df.where(F.col(product) == product_id).select(product, DATE, target, prediction).orderBy(DATE)
