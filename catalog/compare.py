"""Run registered queries on Spark and their twins on DuckDB and compare every value.

    python -m catalog.compare SF_DIR [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import DataFrame

from .oracle import ORACLE
from .queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns and rows in value order; dates as text, missing as None."""
    frame = frame[sorted(frame.columns)].copy()
    for column in frame.columns:
        kind = str(frame[column].dtype)
        if kind.startswith("datetime") or column.endswith(("date", "DATE")):
            frame[column] = pd.to_datetime(frame[column]).dt.strftime("%Y-%m-%d")
        elif kind.startswith(("float", "int")):
            frame[column] = frame[column].astype("float64") + 0.0
        elif frame[column].map(lambda v: isinstance(v, (int, float))).any() and not kind.startswith("bool"):
            frame[column] = pd.to_numeric(frame[column]).astype("float64")
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def _kind(name: str) -> str:
    name = name.lower()
    return {"int": "integer", "string": "varchar"}.get(name, name)


def differences(spark_result: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a Spark result and a SQL result; empty when they are equal."""
    schema = {row[0]: row[1].lower() for row in connection.execute(f"DESCRIBE {sql}").fetchall()}
    mine = {name: _kind(kind) for name, kind in spark_result.dtypes}
    if mine != schema:
        return [f"schema: spark-only {sorted(mine.items() - schema.items())}, sql-only {sorted(schema.items() - mine.items())}"]
    left, right = _sorted(spark_result.toPandas()), _sorted(connection.execute(sql).df())
    if len(left) != len(right):
        return [f"rows: {len(left)} against {len(right)}"]
    found = []
    for column in left.columns:
        a, b = left[column], right[column]
        unequal = ~((a == b) | (a.isna() & b.isna()))
        if unequal.any():
            i = unequal.idxmax()
            found.append(f"{column}: {int(unequal.sum())} of {len(a)} differ, first {a[i]!r} against {b[i]!r}")
    return found


def main() -> int:
    from pricetide.session import build_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = connect(folder), 0
    for name in names:
        start = time.time()
        try:
            result = QUERIES[name](spark, folder)
            if name in ORACLE:
                found, rows = differences(result, connection, ORACLE[name]), ""
            else:
                found, rows = [], f"{len(result.collect())} rows, no twin"
        except Exception as error:  # report and go on with the next query
            found, rows = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok':4} {name} {time.time() - start:.1f}s {rows} {' | '.join(found)}", flush=True)
    print(f"{len(names) - failed} of {len(names)} equal")
    return failed


if __name__ == "__main__":
    sys.exit(main())
