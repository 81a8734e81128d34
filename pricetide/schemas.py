"""Table schemas and the checks made where a table enters a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .config import DATE, PRODUCT, PRODUCT_ID, UNUSED_TRANSACTION_COLUMNS, WEEK

TRANSACTIONS = T.StructType([
    T.StructField(DATE, T.IntegerType()),
    T.StructField(WEEK, T.IntegerType()),
    T.StructField(PRODUCT, T.StringType()),
    T.StructField("SPEND", T.DoubleType()),
    T.StructField("QUANTITY", T.LongType()),
])

DAILY = T.StructType([
    T.StructField(DATE, T.DateType()),
    T.StructField(PRODUCT, T.StringType()),
    T.StructField("avg_price", T.DoubleType()),
    T.StructField("total_units", T.LongType()),
    T.StructField("total_sales", T.DoubleType()),
    T.StructField(WEEK, T.IntegerType()),
])

SCALER_STATS = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("center", T.DoubleType()),
    T.StructField("scale", T.DoubleType()),
])

POLICY_RESULTS = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField(PRODUCT_ID, T.StringType()),
    T.StructField("price_multiplier", T.DoubleType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("reward", T.DoubleType()),
    T.StructField("units_sold", T.LongType()),
    T.StructField("policy", T.StringType()),
])


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail at plan time when a column is missing (``drop`` alone ignores unknown names)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Keep exactly the schema's columns, in its order, cast to its types."""
    require_columns(df, schema.fieldNames())
    return df.select(*[_cast(F.col(f.name), df.schema[f.name].dataType, f.dataType).alias(f.name)
                       for f in schema.fields])


def _cast(column: Column, have: T.DataType, want: T.DataType) -> Column:
    return column if have == want else column.cast(want)


def standard_product_id(df: DataFrame) -> DataFrame:
    """Accept either name of the product column and return it as ``product_id``."""
    if PRODUCT_ID in df.columns:
        return df
    require_columns(df, [PRODUCT])
    return df.withColumnRenamed(PRODUCT, PRODUCT_ID)


def drop_unused(df: DataFrame) -> DataFrame:
    """Drop the transaction columns nothing downstream reads; all of them must be there."""
    require_columns(df, UNUSED_TRANSACTION_COLUMNS)
    return df.drop(*UNUSED_TRANSACTION_COLUMNS)
