"""Compares registered queries with their DuckDB form, value by value."""

from __future__ import annotations

import glob
import math
import os

import duckdb
from pyspark.sql import DataFrame


def duckdb_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as connection:
        for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
            name = os.path.basename(path).removesuffix(".parquet")
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
        cursor = connection.execute(sql)
        columns = [column[0] for column in cursor.description]
        return columns, cursor.fetchall()


def _canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(value):
        if isinstance(value, float) and math.isnan(value):
            return "nan"
        return repr(value)

    picked = sorted(tuple(text(row[i]) for i in order) for row in rows)
    return [columns[i] for i in order], picked


def compare(spark_frame: DataFrame, sql: str, sf_dir: str) -> int:
    """Raises on a difference; gives the number of rows."""
    mine = _canonical(spark_frame.columns, [tuple(row) for row in spark_frame.collect()])
    theirs = _canonical(*duckdb_rows(sql, sf_dir))
    assert mine[0] == theirs[0], f"columns {mine[0]} against {theirs[0]}"
    assert len(mine[1]) == len(theirs[1]), f"{len(mine[1])} rows against {len(theirs[1])}"
    wrong = [pair for pair in zip(mine[1], theirs[1]) if pair[0] != pair[1]]
    assert not wrong, f"{len(wrong)} rows differ, first {wrong[0]}"
    return len(mine[1])
