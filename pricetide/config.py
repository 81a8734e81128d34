"""Names and default parameters shared by every job."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# Column names of the stored tables.
DATE = "SHOP_DATE"
WEEK = "SHOP_WEEK"
PRODUCT = "PROD_CODE"
PRODUCT_ID = "product_id"
UNUSED_TRANSACTION_COLUMNS = ["CUST_CODE", "BASKET_ID", "BASKET_SIZE", "__null_dask_index__"]

# The demand model's inputs, in the order it is trained on, and its target.
FEATURES = [
    "avg_price", "total_sales",
    "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
    "lag_1_units", "lag_7_units", "lag_14_units", "lag_28_units",
    "rolling_mean_7_units", "rolling_mean_28_units",
    "rolling_std_7_units", "rolling_std_28_units",
    "price_change_pct",
    "day_of_month", "week_of_year", "is_weekend",
    "days_since_price_change", "price_position",
]
TARGET = "total_units"

# Lags and rolling window lengths, in rows.
LAGS = [1, 7, 14, 28]
ROLLING_WINDOWS = [7, 28]

# Guard added to price denominators.
PRICE_EPSILON = 1e-6


@dataclass(frozen=True)
class Settings:
    """The defaults of the published configuration."""

    top_n: int = 100
    train_end: dt.date = dt.date(2008, 1, 10)
    val_end: dt.date = dt.date(2008, 4, 10)
    multipliers: tuple[float, ...] = (0.9, 0.95, 1.0, 1.05, 1.1)
    action_low: float = 0.9
    action_high: float = 1.1
    horizon: int = 90
    noise_std: float = 0.0719
    #: Unit cost as a share of the price on both sides; None takes each side's own default below.
    cost_ratio: float | None = None
    policy_cost_ratio: float = 0.75
    baseline_cost_ratio: float = 0.7
    bootstraps: int = 1000
    ci_level: float = 0.95
    seed: int = 42
    n_trees: int = 2000
    learning_rate: float = 0.01
    subsample: float = 0.8
    leaves: int = 31
    lambda_l1: float = 0.1
    lambda_l2: float = 0.1

    @property
    def policy_cost(self) -> float:
        """The policy's unit cost as a share of the product's median price."""
        return self.policy_cost_ratio if self.cost_ratio is None else self.cost_ratio

    @property
    def baseline_cost(self) -> float:
        """The historical baseline's unit cost as a share of its own price."""
        return self.baseline_cost_ratio if self.cost_ratio is None else self.cost_ratio
