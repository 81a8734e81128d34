"""Episode cuts: which rows of a product a backtest walks through."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DATE, PRODUCT_ID
from ..functions.noise import hash_integer, hash_key


def episode_rows(df: DataFrame, horizon: int, product: str = PRODUCT_ID, seed: int | None = None) -> DataFrame:
    """The rows of one episode per product, with ``step`` from 1, ``steps`` and ``next_date``.

    An episode starts at the first row, or with a seed at a row drawn uniformly among those that
    leave a whole horizon. It ends after ``horizon`` rows or before the product's last row, and
    always has one step.
    """
    by_product = Window.partitionBy(product)
    by_date = by_product.orderBy(DATE)
    numbered = df.select(
        "*",
        F.row_number().over(by_date).alias("_row"),
        F.count(F.lit(1)).over(by_product).cast("int").alias("_rows"),
        F.lead(DATE).over(by_date).alias("next_date"))
    if seed is None:
        start = F.lit(0)
    else:
        choices = F.col("_rows") - horizon
        drawn = hash_integer(hash_key(seed, F.col(product))) % choices
        start = F.when(choices > 1, drawn).otherwise(F.lit(0)).cast("int")
    steps = F.greatest(F.lit(1), F.least(F.lit(horizon), F.col("_rows") - 1 - F.col("_start")))
    return (
        numbered.withColumn("_start", start)
        .withColumns({"step": F.col("_row") - F.col("_start"), "steps": steps})
        .where((F.col("step") >= 1) & (F.col("step") <= F.col("steps")))
        .drop("_row", "_rows", "_start"))


def random_product(df: DataFrame, seed: int, product: str = PRODUCT_ID) -> DataFrame:
    """One product id, drawn by the smallest seeded hash."""
    ids = df.select(product).distinct()
    return ids.orderBy(F.md5(hash_key(seed, F.col(product))), product).limit(1)


def first_rows(df: DataFrame, horizon: int, product: str = PRODUCT_ID) -> DataFrame:
    """The first ``horizon`` rows of every product, with their ``position`` from 1."""
    position = F.row_number().over(Window.partitionBy(product).orderBy(DATE))
    return df.withColumn("position", position).where(F.col("position") <= horizon)


def align_rows(df: DataFrame, raw: DataFrame, how: str = "position", product: str = PRODUCT_ID) -> DataFrame:
    """Put the raw panel's price beside each row as ``raw_price``.

    ``position`` pairs the i-th row of a product with its i-th raw row, even where the two start on
    different dates; ``date`` pairs equal dates.
    """
    if how == "date":
        prices = raw.select(product, DATE, F.col("avg_price").alias("raw_price"))
        return df.join(prices, [product, DATE])
    if how != "position":
        raise ValueError(f"how must be position or date, not {how!r}")
    by_date = Window.partitionBy(product).orderBy(DATE)
    prices = raw.select(product, F.row_number().over(by_date).alias("_row"), F.col("avg_price").alias("raw_price"))
    return df.withColumn("_row", F.row_number().over(by_date)).join(prices, [product, "_row"]).drop("_row")
