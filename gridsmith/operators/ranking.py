"""Picks, ranks and pages with stated orders and null places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order. Window group limits keep n rows a
    task before anything moves."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def last_value(df: DataFrame, keys: list[str], ordinal: str, values: list[str], skip_empty: bool = True) -> DataFrame:
    """For each key the last value of each column by an ordinal; empty ones don't count if so wanted."""

    def last(c: str) -> Column:
        some = (F.col(c).isNotNull() & (F.col(c).cast("string") != "")) if skip_empty else F.lit(True)
        return F.max_by(F.struct(F.col(c)), F.when(some, F.col(ordinal)))[c].alias(c)

    return df.groupBy(*keys).agg(*(last(c) for c in values))


def page(df: DataFrame, order: list[Column], number: int, size: int, sizes: tuple[int, ...] = (25, 50, 100, 250)) -> DataFrame:
    """One page of an order; sizes beyond the list become 50, numbers below 1 become 1."""
    size = size if size in sizes else 50
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def nearest_lower(values: Column, q: float) -> Column:
    """The value at place floor((n - 1) * q) of the sorted values; a counted histogram
    of distinct values keeps the group small."""
    ranked = F.sort_array(F.collect_list(values))
    return F.element_at(ranked, (F.floor((F.size(ranked) - 1) * F.lit(q)) + 1).cast("int"))
