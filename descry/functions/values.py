"""Columns of numbers and instants in the shape that the operators count on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """A column by its plain name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def field(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise ValueError(f"no column {name!r}; there are {df.columns}")
    return df.schema[name].dataType


def first_existing(df: DataFrame, *names: str) -> str:
    """The first of the names that is a column."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of {names} is a column")


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN as null and -0.0 as 0.0."""
    c = col(name)
    if isinstance(field(df, name), (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c + F.lit(0.0))
    return c


def number(df: DataFrame, name: str) -> Column:
    """The cleaned column as double; durations as seconds."""
    kind = field(df, name)
    if isinstance(kind, T.DayTimeIntervalType):
        return seconds(col(name))
    return clean(df, name).cast("double")


def seconds(interval: Column) -> Column:
    """A day-time interval in seconds with fractions."""
    return F.extract(F.lit("day"), interval) * 86400.0 + F.extract(F.lit("hour"), interval) * 3600.0 + F.extract(F.lit("minute"), interval) * 60.0 + F.extract(F.lit("second"), interval).cast("double")


def level(df: DataFrame, name: str) -> Column:
    """The cleaned column as text, the form that frequency tables show."""
    return clean(df, name).cast("string")


def numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def instant(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def share(part: Column, whole: Column) -> Column:
    """part / whole as a fraction, null for an empty whole."""
    return part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")


def batch_only(df: DataFrame) -> DataFrame:
    if not hasattr(df, "isStreaming"):
        raise TypeError(f"a PySpark DataFrame is needed, not {type(df).__module__}.{type(df).__name__}")
    if df.isStreaming:
        raise ValueError("a stream has no end to profile; call this on the batches of foreachBatch")
    return df
