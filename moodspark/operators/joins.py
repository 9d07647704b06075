"""Helpers for tables that are small by construction."""

from __future__ import annotations

from pyspark.sql import DataFrame


def collect_bounded(df: DataFrame, max_rows: int, what: str) -> list:
    """Collect a table that is bounded by construction; fail loudly otherwise."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows; refusing to collect to the driver")
    return rows
