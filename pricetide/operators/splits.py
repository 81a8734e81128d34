"""Date splits and row filters on missing values."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..config import DATE

SPLITS = ("train", "val", "test")


def split_by_date(df: DataFrame, train_end: dt.date, val_end: dt.date) -> DataFrame:
    """Add ``split``: train up to the first cut, val up to the second, test after it.

    Apply it after the features, so that the first rows of val and test still see earlier rows.
    Stored tables are partitioned by this column, which makes a split a directory to read.
    """
    date = F.col(DATE)
    return df.withColumn(
        "split", F.when(date <= F.lit(train_end), "train").when(date <= F.lit(val_end), "val").otherwise("test"))


def drop_null_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without a NULL. NaN is a value here, so ``dropna``, which drops both, is not used."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns or df.columns]))


def zero_nan(df: DataFrame) -> DataFrame:
    """NaN becomes 0 in every floating column; NULL is left alone."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({
        c: F.nanvl(F.col(c), F.lit(0.0)).cast(df.schema[c].dataType) for c in floating
    })


def as_float32(df: DataFrame, columns: list[str]) -> DataFrame:
    """Single precision for storage; a boolean becomes 0 or 1."""
    return df.withColumns({c: F.col(c).cast("float") for c in columns})
