"""Distinct values and key tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_values(df: DataFrame, value: str) -> DataFrame:
    """Each value once, by content."""
    return df.select(value).distinct()


def keep_largest(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row for each key, with its largest value."""
    return df.groupBy(key).agg(F.max(value).alias(value))


def insert(table: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows added to a key table; the largest value of a key stays."""
    return keep_largest(table.select(key, value).unionByName(rows.select(key, value)), key, value)


def find(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Each key with the table's row, or nulls."""
    return keys.join(table, key, "left")


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without the given keys."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def entry_count(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    """Number of distinct keys."""
    return df.agg(F.count_distinct(key).alias(out))
