"""Column scalers: statistics as a table, applied as constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import nan_to_null, standardise, unstandardise
from .quantiles import exact_quantiles

KINDS = ("standard", "robust")


def fit_scalers(train: DataFrame, columns: list[str], kind: str = "standard") -> DataFrame:
    """Scaler statistics (``column, kind, center, scale``), fitted on the training split.

    ``standard``: mean and population deviation. ``robust``: median and interquartile range.
    Missing values are ignored, and a zero scale becomes 1.
    """
    if kind == "standard":
        return _fit_standard(train, columns)
    if kind == "robust":
        return _fit_robust(train, columns)
    raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")


def _fit_standard(train: DataFrame, columns: list[str]) -> DataFrame:
    """One aggregate over all columns, one row out of every task."""
    values = train.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in columns])
    row = values.agg(*[
        F.struct(F.lit(c).alias("column"), F.lit("standard").alias("kind"),
                 F.avg(c).alias("center"), _scale(F.stddev_pop(c)).alias("scale")).alias(c)
        for c in columns
    ])
    return row.select(F.inline(F.array(*[F.col(c) for c in columns])))


def _fit_robust(train: DataFrame, columns: list[str]) -> DataFrame:
    q = F.col("quantiles")
    return exact_quantiles(train, columns, [0.25, 0.5, 0.75]).select(
        "column", F.lit("robust").alias("kind"), q[1].alias("center"), _scale(q[2] - q[0]).alias("scale"))


def _scale(spread: Column) -> Column:
    return F.when(spread == 0, 1.0).otherwise(spread)


def scaler_values(stats: DataFrame, columns: list[str]) -> dict[str, tuple[Column, Column]]:
    """Center and scale of the listed columns as constants.

    The statistics have one row per column, so this reads a few numbers to the driver; as constants
    they leave nothing to join and keep scaling inside generated code. A column without statistics
    is not in the result.
    """
    rows = stats.where(F.col("column").isin(columns)).select("column", "center", "scale").collect()
    return {r["column"]: tuple(F.lit(r[part]).cast("double") for part in ("center", "scale")) for r in rows}


def apply_scalers(df: DataFrame, stats: DataFrame, columns: list[str], inverse: bool = False) -> DataFrame:
    """Scale (or unscale) columns in place; a column without statistics is left as it is."""
    step = unstandardise if inverse else standardise
    return df.withColumns({
        c: step(F.col(c).cast("double"), center, scale)
        for c, (center, scale) in scaler_values(stats, columns).items()})
