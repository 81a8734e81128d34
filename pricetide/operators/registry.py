"""Product ids and per-product constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DATE, PRODUCT, PRODUCT_ID
from .quantiles import exact_quantiles

PIVOTS = 256


def dense_ids(df: DataFrame, column: str = PRODUCT_ID) -> DataFrame:
    """Distinct ids with their position in sorted order, from 0.

    Numbering every row in one window would put all ids in one task. Instead a fixed number of ids,
    those with the smallest hashes, cut the id range into buckets of similar size; each id is
    numbered inside its bucket, after the count of all earlier buckets.
    """
    ids = df.select(column).where(F.col(column).isNotNull()).distinct()
    sample = ids.orderBy(F.xxhash64(column), column).limit(PIVOTS)
    pivots = sample.agg(F.sort_array(F.collect_list(column)).alias("pivots")).scalar()
    # coalesce makes the bucket non-null; the join would otherwise infer a null check on it and push
    # that, with the pivot search, below the distinct.
    bucket = F.coalesce(F.size(F.filter("pivots", lambda p: p < F.col(column))), F.lit(0))
    bucketed = ids.select(column, pivots.alias("pivots")).select(column, bucket.alias("bucket"))
    # At most PIVOTS + 1 rows from here to the offsets.
    sizes = bucketed.groupBy("bucket").count()
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy(column))
    return bucketed.join(F.broadcast(offsets), "bucket").select(
        column, (F.col("offset") + inside - 1).cast("int").alias("dense_id"))


def extended_ids(registry: DataFrame, df: DataFrame, column: str = PRODUCT_ID) -> DataFrame:
    """The registry with the ids of ``df`` it does not know, numbered after all it has; known ids keep their numbers."""
    new = dense_ids(df.select(column).distinct().join(registry.select(column), column, "left_anti"), column)
    after = registry.agg(F.coalesce(F.max("dense_id") + 1, F.lit(0))).scalar()
    return registry.select(column, "dense_id").unionByName(
        new.select(column, (F.col("dense_id") + after).cast("int").alias("dense_id")))


def to_dense(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Replace raw product ids by dense ids."""
    return df.join(registry, PRODUCT_ID).drop(PRODUCT_ID)


def to_raw(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Replace dense ids by raw product ids."""
    return df.join(registry, "dense_id").drop("dense_id")


def median_prices(panel: DataFrame, product: str = PRODUCT) -> DataFrame:
    """Exact median price per product; a product has at most one price per calendar day."""
    return panel.groupBy(product).agg(F.median("avg_price").alias("median_price"))


def sales_volatility(panel: DataFrame, product: str = PRODUCT) -> DataFrame:
    """Sample deviation of units per product; NULL for a single row."""
    return panel.groupBy(product).agg(F.stddev_samp("total_units").alias("sales_volatility"))


def product_constants(panel: DataFrame, product: str = PRODUCT) -> DataFrame:
    """Median price and sales volatility per product in one pass."""
    return panel.groupBy(product).agg(
        F.median("avg_price").alias("median_price"),
        F.stddev_samp("total_units").alias("sales_volatility"))


def global_median_price(panel: DataFrame) -> DataFrame:
    """One row: the exact median price over the whole panel."""
    return exact_quantiles(panel, ["avg_price"], [0.5]).select(F.col("quantiles")[0].alias("median_price"))


def average_daily_revenue(panel: DataFrame, product: str = PRODUCT, sales: str = "total_sales",
                          one_row_a_day: bool = False) -> DataFrame:
    """Sales per distinct day and product; 0 without a day. Any sales column can be given.

    Of a table with ``one_row_a_day`` and product, as `daily_panel` gives it, each row with a date is a day of its own:
    then the days need no tables by product and day beside the panel's own in a task's memory.
    """
    days = F.count(DATE) if one_row_a_day else F.count_distinct(DATE)
    return panel.groupBy(product).agg(
        F.when(days > 0, F.sum(sales) / days).otherwise(0.0).alias("avg_daily_revenue"))


def attach_constants(df: DataFrame, constants: DataFrame, product: str = PRODUCT) -> DataFrame:
    """Left join of per-product constants; a product without them gets 0."""
    names = [c for c in constants.columns if c != product]
    joined = df.join(constants, product, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in names})
