"""Transaction tables: the raw format and a view of order lines in that format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..config import DATE, PRODUCT, WEEK
from ..functions.calendar import parse_yyyymmdd
from ..schemas import drop_unused, require_columns


def clean_transactions(raw: DataFrame) -> DataFrame:
    """Parse the date strictly and drop the unused columns."""
    require_columns(raw, [DATE, WEEK, PRODUCT, "SPEND", "QUANTITY"])
    parsed = parse_yyyymmdd(F.col(DATE), raw.schema[DATE].dataType)
    return drop_unused(raw).withColumn(DATE, parsed)


def load_raw_data(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Lazy scan of a raw transaction table. Give the schema to skip reading footers up front."""
    reader = spark.read.schema(schema) if schema else spark.read
    return clean_transactions(reader.parquet(path))


# How a product code is read off an order line; the supplier and part keys need no join.
LINE_KEYS = {"supplier": "l_suppkey", "part": "l_partkey"}
PART_KEYS = {"brand": "p_brand", "type": "p_type", "name": "p_name"}


def line_items(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/lineitem.parquet")


def transactions_from_lines(spark: SparkSession, folder: str, product: str = "supplier") -> DataFrame:
    """Order lines as cleaned transactions, with the date already a date.

    ``product`` names the level that stands for a product. The part levels join the part table
    without a hint: it grows with the data, so adaptive execution picks the join from its size.
    """
    lines = line_items(spark, folder)
    if product in LINE_KEYS:
        code = F.col(LINE_KEYS[product])
    else:
        column = PART_KEYS[product]
        parts = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", column)
        lines = lines.join(parts, lines.l_partkey == parts.p_partkey)
        code = F.col(column)
    day = F.col("l_shipdate").cast("date")
    return lines.select(
        day.alias(DATE),
        (F.year(day) * 100 + F.weekofyear(day)).alias(WEEK),
        code.cast("string").alias(PRODUCT),
        F.col("l_extendedprice").alias("SPEND"),
        F.col("l_quantity").cast("long").alias("QUANTITY"),
    )


def raw_transactions_from_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines in the raw on-disk format: integer date and the columns that get dropped."""
    return (
        transactions_from_lines(spark, folder)
        .withColumn(DATE, F.date_format(DATE, "yyyyMMdd").cast("int"))
        .withColumns({
            "CUST_CODE": F.lit(None).cast("string"),
            "BASKET_ID": F.lit(None).cast("long"),
            "BASKET_SIZE": F.lit(None).cast("string"),
            "__null_dask_index__": F.lit(0).cast("long"),
        })
    )
