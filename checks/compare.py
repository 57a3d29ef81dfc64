"""Run every registered query and its SQL twin, and compare rows.

    python -m checks.compare <folder> [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from .catalog import ORACLES, QUERIES

DRIVER_TABLES = ["events", "orders", "lineitem", "customer", "part"]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in DRIVER_TABLES:
        connection.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def _cell(value) -> str:
    if value is None or value != value:
        return ""
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def spark_rows(df: DataFrame) -> list[tuple]:
    return rows_of(df.columns, df.collect())


def duckdb_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    result = connection.sql(sql)
    return result.columns, rows_of(result.columns, result.fetchall())


def main(folder: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = 0
    for name in names or QUERIES:
        try:
            start = time.time()
            df = QUERIES[name](spark, folder)
            mine = spark_rows(df)
            middle = time.time()
            columns, theirs = duckdb_rows(connection, ORACLES[name])
            end = time.time()
        except Exception as error:
            failed += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            continue
        same = sorted(df.columns) == sorted(columns) and mine == theirs
        failed += not same
        print(
            f"{'ok   ' if same else 'DIFF '} {name}: {len(mine)} rows, {len(theirs)} expected,"
            f" {middle - start:.1f} s, twin {end - middle:.1f} s",
            flush=True,
        )
        if not same:
            print("  columns", set(df.columns) ^ set(columns))
            a, b = set(mine), set(theirs)
            print("  only here ", sorted(a - b)[:2])
            print("  only there", sorted(b - a)[:2])
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
