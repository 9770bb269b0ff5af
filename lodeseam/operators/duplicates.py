"""Repeated contents: which pages are copies, and the first of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(pages: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each content, the first in order. Only keys and places are grouped, with partial minima, never contents."""
    place = F.struct(*order)
    first = pages.groupBy(key).agg(F.min(place).alias("__first"))
    return pages.join(first, key).where(place == F.col("__first")).drop("__first")


def report(pages: DataFrame, key: str, place: str) -> DataFrame:
    """(first_place, dup_place, key) of all contents met twice or more; a hot content is one joined row, not a group."""
    sizes = pages.groupBy(key).agg(F.min(place).alias("first_place"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return pages.select(key, F.col(place).alias("dup_place")).join(sizes, key).where(F.col("dup_place") != F.col("first_place")).select("first_place", "dup_place", key)


def repeated_bytes(pages: DataFrame, key: str, size: str) -> DataFrame:
    """Counts of all, distinct and repeated pages and bytes."""
    per = pages.groupBy(key).agg(F.count("*").alias("n"), F.max(size).alias("size"))
    return per.agg(
        F.sum("n").alias("pages"),
        F.count("*").alias("distinct_pages"),
        F.sum(F.col("n") - 1).alias("dup_pages"),
        F.sum((F.col("n") - 1) * F.col("size")).alias("dup_bytes"),
    )


def numbered(pages: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Every row with its number among the rows of its content."""
    return pages.withColumn("seen", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
