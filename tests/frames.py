"""Small literal frames for the tests."""

from __future__ import annotations

import contextlib
import io
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

READING = "event_id long, link_id long, speed double, volume int, ts timestamp_ntz"
LINKS = "link_id long, x double, y double"


def readings(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (link, speed, volume, time); the event id is the place in the list."""
    data = [(n, link, speed, volume, at) for n, (link, speed, volume, at) in enumerate(rows)]
    return spark.createDataFrame(data, READING)


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def plan_text(df: DataFrame) -> str:
    """The formatted plan, which names pushed filters in full."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def as_set(df: DataFrame, *columns: str) -> set[tuple]:
    rows = [tuple(row) for row in df.select(*columns).collect()]
    assert len(rows) == len(set(rows)), "repeated rows"
    return set(rows)


def as_rows(df: DataFrame) -> list[tuple]:
    """All rows in a fixed order, for frames that may repeat a row."""
    columns = sorted(df.columns)
    return sorted(tuple(map(repr, row)) for row in df.select(*columns).collect())
