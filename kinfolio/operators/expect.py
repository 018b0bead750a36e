"""Checks that raise with the first rows that break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _none(bad: DataFrame, what: str) -> None:
    rows = bad.limit(3).collect()
    if rows:
        raise AssertionError(f"{what}: {[r.asDict() for r in rows]}")


def unique(df: DataFrame, *key: str) -> DataFrame:
    _none(df.groupBy(*key).count().where("count > 1"), f"{key} repeats")
    return df


def row_count(df: DataFrame, n: int) -> DataFrame:
    if (found := df.count()) != n:
        raise AssertionError(f"{found} rows where {n} are expected")
    return df


def complete_grid(df: DataFrame, expected: DataFrame) -> DataFrame:
    _none(expected.join(df, expected.columns, "left_anti"), "cells are missing")
    return df


def same_keys(a: DataFrame, b: DataFrame, *key: str) -> None:
    _none(a.select(*key).exceptAll(b.select(*key)), "keys only on the left")
    _none(b.select(*key).exceptAll(a.select(*key)), "keys only on the right")


def subset(a: DataFrame, b: DataFrame, *key: str) -> None:
    _none(a.select(*key).join(b.select(*key), list(key), "left_anti"), "keys are unknown")


def disjoint(a: DataFrame, b: DataFrame, *key: str) -> None:
    _none(a.select(*key).join(b.select(*key).distinct(), list(key), "left_semi"), "keys are shared")


def one_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key has one value: no conflicting mapping, no collision."""
    _none(df.groupBy(key).agg(F.count_distinct(value).alias("values")).where("values > 1"), f"{key} has several {value}")
    return df


def holds(df: DataFrame, condition: Column, what: str) -> DataFrame:
    """``condition`` is true for every row; null counts as false."""
    _none(df.where(~F.coalesce(condition, F.lit(False))), what)
    return df


def not_blank(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        holds(df, F.length(F.trim(c)) > 0, f"{c} is blank")
    return df
