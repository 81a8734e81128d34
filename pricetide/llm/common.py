"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricetide.session import materialize

__all__ = ["documents", "free_name", "map_arrow", "materialize", "numbered", "salt", "sampled", "ship"]

#: Rows that one numbering bucket holds on average; a bucket is sorted in one task.
BUCKET_ROWS = 1_000

#: The session's bound on a batch of rows on their way to Python, and what it is set to where it is not given. By
#: default batches grow to 64 MB, and each has buffers of up to twice its size in the executor and once more in Python.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "8m"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application, so that tasks can import it anywhere."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="code-"), "pricetide_code.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(spark.sparkContext.applicationId)


_SHIPPED: set[str] = set()


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` whose tasks can import this package and get rows in batches of a few MB."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)
    return df.mapInArrow(function, schema)


def salt(row: Column, salts: int) -> Column:
    """A number from 0 to salts-1 fixed by the row's id: deals the rows of one key over many tasks."""
    return F.pmod(F.xxhash64(row, F.lit("salt")), F.lit(salts)).cast("int")


def sampled(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows, chosen by hash of ``keys``; all of them if there are no more.

    A share of the hash range is kept, so no task sends more than its part of the sample anywhere. The share aims at
    nine tenths of the bound; the limit makes the bound strict.
    """
    total = df.count()
    if total <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1 << 30)) < int(0.9 * rows / total * (1 << 30))).limit(rows)


def numbered(df: DataFrame, keys: list[str], row_id: str, name: str, rows: int) -> DataFrame:
    """``df`` with ``name``: gapless numbers from 0 within ``keys``, in an order fixed by the rows' ids.

    Rows of one key are dealt over hash buckets; only a bucket (`BUCKET_ROWS` rows on average, by the count
    ``rows`` of the table) is sorted in one task, and the buckets' offsets are running sums of their counts.
    """
    buckets = max(1, -(-rows // BUCKET_ROWS))
    bucket = free_name(df, "bucket")
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(F.col(row_id), F.lit("bucket")), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    # Buckets per key, not rows: a running sum over them in two levels keeps each window small.
    per = 1024
    sizes = sizes.withColumn("_block", F.floor(F.col(bucket) / per).cast("int"))
    blocks = sizes.groupBy(*keys, "_block").agg(F.sum("_n").alias("_bn")).withColumn(
        "_before", F.sum("_bn").over(Window.partitionBy(*[F.col(k) for k in keys]).orderBy("_block")) - F.col("_bn"))
    offsets = sizes.join(blocks.drop("_bn"), [*keys, "_block"]).withColumn(
        "_offset", F.col("_before") + F.sum("_n").over(
            Window.partitionBy(*[F.col(k) for k in keys], "_block").orderBy(bucket)) - F.col("_n")
    ).select(*keys, bucket, "_offset")
    place = F.row_number().over(Window.partitionBy(*[F.col(k) for k in keys], bucket).orderBy(row_id)) - 1
    return dealt.withColumn("_place", place).join(offsets, [*keys, bucket]).withColumn(
        name, (F.col("_offset") + F.col("_place")).cast("long")).drop(bucket, "_place", "_offset")
