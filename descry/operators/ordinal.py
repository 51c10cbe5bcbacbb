"""Ordinal columns: declared order, or the numbers that the labels begin with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from descry.functions.strings import leading_number
from descry.functions.values import share
from descry.operators.freq import counts, everything


def order_by_number(df: DataFrame, column: str, most: int = 30) -> list[str] | None:
    """The levels by leading number, if every level begins with one and no two with the same."""
    rows = counts(df, column).select("level", leading_number(F.col("level")).alias("x")).limit(most + 1).collect()
    if not rows or len(rows) > most or any(r.x is None for r in rows) or len({r.x for r in rows}) < len(rows):
        return None
    return [r.level for r in sorted(rows, key=lambda r: r.x)]


def table(df: DataFrame, column: str, levels: list[str] | None = None) -> DataFrame:
    """(position, level, n, share, cumulative) in natural order. Declared levels that don't occur have n = 0; others come last, by name.

    Without declared levels, the order is the leading number's.
    """
    c = counts(df, column)
    if levels is None:
        placed = c.withColumn("position", leading_number(F.col("level")))
    else:
        declared = df.sparkSession.createDataFrame(list(enumerate(levels, 1)), "position long, level string")
        both = c.join(F.broadcast(declared), "level", "full")
        placed = both.select("level", F.coalesce("n", F.lit(0)).alias("n"), "position")
    by = Window.orderBy(F.asc_nulls_last("position"), "level")
    total = F.sum("n").over(everything())
    return placed.select(
        F.row_number().over(by).cast("long").alias("position"), "level", "n", share(F.col("n"), total).alias("share"),
        share(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)), total).alias("cumulative"),
    )


def quartiles(df: DataFrame, column: str, levels: list[str] | None = None) -> DataFrame:
    """One row: the first level at which the cumulative share reaches 25, 50 and 75 %, and the mode (ties: the lower level)."""
    t = table(df, column, levels).withColumn(
        "cum_n", F.sum("n").over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)),
    ).withColumn("total", F.sum("n").over(everything()))
    at = lambda q: F.min_by("level", F.when(F.col("cum_n") * 100 >= F.col("total") * q, F.col("position")))
    return t.agg(
        at(25).alias("q1"), at(50).alias("median"), at(75).alias("q3"),
        F.min_by("level", F.struct((-F.col("n")).alias("n"), "position")).alias("mode"),
    )
