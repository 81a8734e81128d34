"""Data preparation: transactions to scaled, split feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DATE, FEATURES, PRODUCT_ID, WEEK, Settings
from ..operators.features import time_series_features
from ..operators.panel import daily_panel, keep_products, top_products
from ..operators.scaling import apply_scalers, fit_scalers
from ..operators.splits import as_float32, drop_null_rows, split_by_date, zero_nan
from ..schemas import standard_product_id
from ..sources import tables
from ..sources.transactions import load_raw_data

ID_COLUMNS = [DATE, PRODUCT_ID, WEEK]


def scaled_split(rows: DataFrame, stats: DataFrame, features: list[str] | None = None,
                 warmup: str = "missing") -> DataFrame:
    """Scale one split (or all of them) with the training statistics.

    ``warmup`` says what becomes of rows whose lags or windows are not filled yet: ``missing``
    keeps them with NaN, ``mean`` puts 0, the mean of a scaled column, and ``drop`` drops them.
    """
    features = features or FEATURES
    scaled = as_float32(apply_scalers(as_float32(rows, features), stats, features), features)
    if warmup == "drop":
        return drop_null_rows(scaled)
    missing = {"missing": float("nan"), "mean": 0.0}[warmup]
    kept = drop_null_rows(scaled, [c for c in scaled.columns if c not in features])
    return kept.na.fill(missing, features) if warmup == "mean" else kept.withColumns({
        c: F.coalesce(F.col(c), F.lit(missing).cast("float")) for c in features})


def process_and_save_split(rows: DataFrame, output_path: str, stats_path: str, train: bool,
                           features: list[str] | None = None) -> DataFrame:
    """Fit (training split) or load the scaler table, scale the rows and write them."""
    features = features or FEATURES
    if train:
        tables.write_scaler_stats(fit_scalers(as_float32(rows, features), features), stats_path)
    stats = tables.read_scaler_stats(rows.sparkSession, stats_path)
    tables.write_parquet(scaled_split(rows, stats, features), output_path)
    return stats


def split_features(panel: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Features of the whole panel, then the split column."""
    return split_by_date(standard_product_id(time_series_features(panel)), settings.train_end, settings.val_end)


def prepare_data(spark: SparkSession, output_dir: str, raw_path: str | None = None, panel_path: str | None = None,
                 settings: Settings = Settings(), grain: str = "day", transactions: DataFrame | None = None) -> None:
    """Run data preparation and write every table under ``output_dir``.

    From ``raw_path`` (or given transactions) the daily panel of all products is written in one scan
    of the transactions; the top list and everything after read that table. With ``panel_path`` an
    existing panel is used as it is. Features are computed once for all three splits.
    """
    if panel_path is None:
        if transactions is None:
            transactions = load_raw_data(spark, raw_path)
        tables.write_parquet(daily_panel(transactions), f"{output_dir}/daily_all")
        everything = tables.read_daily_panel(spark, f"{output_dir}/daily_all")
        tables.write_product_ids(top_products(everything, settings.top_n, grain), f"{output_dir}/top_products")
        chosen = tables.read_product_ids(spark, f"{output_dir}/top_products")
        panel_path = f"{output_dir}/daily"
        tables.write_parquet(keep_products(everything, chosen), panel_path)
    panel = tables.read_daily_panel(spark, panel_path)
    tables.write_parquet(split_features(panel, settings), f"{output_dir}/features", ["split"])
    features = tables.read_parquet(spark, f"{output_dir}/features")
    for split in ("train", "val", "test"):
        rows = features.where(F.col("split") == split).drop("split")
        process_and_save_split(rows, f"{output_dir}/{split}_scaled", f"{output_dir}/scaler_stats", split == "train")


def load_data_registry(spark: SparkSession, scaled_path: str, registry_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A scaled split with NaN as 0, its product registry (written) and revenue per day and product."""
    from ..operators.registry import average_daily_revenue, dense_ids

    rows = standard_product_id(zero_nan(tables.read_parquet(spark, scaled_path)))
    tables.write_product_registry(dense_ids(rows), registry_path)
    registry = tables.read_product_registry(spark, registry_path)
    return rows.join(registry, PRODUCT_ID), registry, average_daily_revenue(rows, PRODUCT_ID)
