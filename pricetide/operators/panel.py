"""From transactions to the daily panel, completeness and the best sellers.

Transactions are scanned once: the daily panel is the only aggregate over them, and completeness,
sales totals and the top list are computed from the panel, which has one row per product and day.
Map-side partial aggregation shrinks a product that holds a large share of all lines to at most
one row per day and task before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DATE, PRODUCT, WEEK
from ..functions.calendar import period_index
from ..functions.numeric import unit_price


def line_prices(transactions: DataFrame) -> DataFrame:
    """Add the price per unit of every line."""
    return transactions.withColumn("PRICE", unit_price(F.col("SPEND"), F.col("QUANTITY")))


def daily_panel(transactions: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """One row per product and day: unweighted mean of line prices, units, sales, week.

    A line with zero quantity counts in units and sales but not in the mean price. ``SHOP_WEEK``
    is constant within a date; the smallest one is taken so that row order cannot matter.
    """
    if products is not None:
        transactions = keep_products(transactions, products)
    return line_prices(transactions).groupBy(DATE, PRODUCT).agg(
        F.avg("PRICE").alias("avg_price"),
        F.sum("QUANTITY").alias("total_units"),
        F.sum("SPEND").alias("total_sales"),
        F.min(WEEK).alias(WEEK),
    )


def panel_parts(transactions: DataFrame) -> DataFrame:
    """The panel before its mean: sum and number of line prices per product and day, so that parts of one day add up."""
    return line_prices(transactions).groupBy(DATE, PRODUCT).agg(
        F.sum("PRICE").alias("price_sum"), F.count("PRICE").alias("price_count"),
        F.sum("QUANTITY").alias("total_units"), F.sum("SPEND").alias("total_sales"), F.min(WEEK).alias(WEEK))


def merged_parts(*parts: DataFrame) -> DataFrame:
    """One row per product and day from any number of `panel_parts`."""
    union = parts[0]
    for more in parts[1:]:
        union = union.unionByName(more)
    return union.groupBy(DATE, PRODUCT).agg(
        *[F.sum(c).alias(c) for c in ("price_sum", "price_count", "total_units", "total_sales")], F.min(WEEK).alias(WEEK))


def finished_panel(parts: DataFrame) -> DataFrame:
    """The daily panel of merged parts."""
    return parts.select(DATE, PRODUCT, F.try_divide("price_sum", "price_count").alias("avg_price"), "total_units", "total_sales", WEEK)


def keep_products(df: DataFrame, products: DataFrame) -> DataFrame:
    """Rows of the listed products (semi join; adaptive execution broadcasts a small list)."""
    return df.join(products.select(PRODUCT), PRODUCT, "left_semi")


def date_completeness(panel: DataFrame, grain: str = "day") -> DataFrame:
    """Per product: first and last date, distinct periods, missing periods and total sales.

    ``missing`` counts the periods without a sale inside the product's own lifetime. With the day
    grain the panel already has one row per period, so one aggregate on the product is enough;
    coarser grains add a step that first merges the days of a period.
    """
    periods = panel.select(
        PRODUCT, DATE, "total_sales", period_index(F.col(DATE), grain).alias("period"),
    )
    if grain == "day":
        periods = periods.select(
            "*", F.col(DATE).alias("first_date"), F.col(DATE).alias("last_date"))
    else:
        periods = periods.groupBy(PRODUCT, "period").agg(
            F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"),
            F.sum("total_sales").alias("total_sales"))
    summary = periods.groupBy(PRODUCT).agg(
        F.min("first_date").alias("min_date"),
        F.max("last_date").alias("max_date"),
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.count("period").alias("unique_periods"),
        F.sum("total_sales").alias("total_sales"),
    )
    missing = F.col("last_period") - F.col("first_period") + 1 - F.col("unique_periods")
    return summary.withColumn("missing_periods", missing).drop("first_period", "last_period")


def complete_products(panel: DataFrame, grain: str = "day") -> DataFrame:
    """Products without a gap, with their total sales."""
    return date_completeness(panel, grain).where("missing_periods = 0").select(PRODUCT, "total_sales")


def top_products(panel: DataFrame, n: int = 100, grain: str = "day") -> DataFrame:
    """The ``n`` best-selling gap-free products with their rank; equal sales rank by id.

    Completeness and sales come out of the same aggregate, so no semi join back to the lines is
    needed. The ordered limit keeps ``n`` rows per task; ranking touches those ``n`` rows only.
    """
    best = complete_products(panel, grain).orderBy(F.desc("total_sales"), PRODUCT).limit(n)
    by_rank = Window.orderBy(F.desc("total_sales"), PRODUCT)
    return best.select(F.row_number().over(by_rank).alias("rank"), PRODUCT, "total_sales")


def first_products(df: DataFrame, k: int, product: str = PRODUCT) -> DataFrame:
    """The first ``k`` product ids in id order, to restrict a trial evaluation."""
    return df.select(product).distinct().orderBy(product).limit(k)
