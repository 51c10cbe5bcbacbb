"""Instants and durations. `now` is a parameter, so that results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descry.functions.dates import FORMATS, UNITS, cycle, formats, period
from descry.functions.values import col, share
from descry.operators.numeric import following


def instants(df: DataFrame, column: str) -> DataFrame:
    return df.select(col(column).cast("timestamp_ntz").alias("t"))


def coverage(df: DataFrame, column: str) -> DataFrame:
    """One row: first and last instant, days between them, counts."""
    t = F.col("t")
    return instants(df, column).agg(
        F.count("*").alias("n"), F.count(t).alias("n_valid"), F.count_distinct(t).alias("k"), F.min(t).alias("first"), F.max(t).alias("last"),
        (F.timestamp_diff("MICROSECOND", F.min(t), F.max(t)) / 86_400_000_000.0).alias("days"),
    )


def granularity(df: DataFrame, column: str) -> DataFrame:
    """One row: the coarsest unit whose starts all instants are; null without instants, `subsecond` where none fits."""
    t = F.col("t")
    got = instants(df, column).where("t is not null").agg(*[F.bool_and(t == period(t, u)).alias(u) for u in UNITS])
    return got.select(F.coalesce(*[F.when(F.col(u), u) for u in UNITS], F.when(F.col("second").isNotNull(), "subsecond")).alias("granularity"))


def text_formats(df: DataFrame, column: str) -> DataFrame:
    """(format, n, share): texts that fit each date format, all counted in one pass."""
    got = df.agg(F.count(col(column)).alias("n_valid"), *formats(col(column)))
    names = ", ".join("'" + f.replace("'", "\\'") + "', `" + f + "`" for f in FORMATS)
    return got.select(
        "n_valid", F.expr(f"stack({len(FORMATS)}, {names}) as (format, n)"),
    ).select("format", "n", share(F.col("n"), F.col("n_valid")).alias("share"))


def dominant_format(df: DataFrame, column: str) -> dict | None:
    """The format that most texts fit (ties: the one tried first), or None."""
    got = [r.asDict() for r in text_formats(df, column).collect()]
    best = max(got, key=lambda r: (r["n"], -FORMATS.index(r["format"])))
    return best if best["n"] else None


def per_period(df: DataFrame, column: str, unit: str = "day") -> DataFrame:
    """(period, n)."""
    return instants(df, column).where("t is not null").groupBy(period(F.col("t"), unit).alias("period")).agg(F.count("*").alias("n"))


def gaps(df: DataFrame, column: str, unit: str = "day") -> DataFrame:
    """(after, before, empty): neighbouring periods with rows that have `empty` periods without any between them."""
    step = {"second": "SECOND", "minute": "MINUTE", "hour": "HOUR", "day": "DAY", "week": "WEEK", "month": "MONTH", "quarter": "QUARTER", "year": "YEAR"}[unit]
    p = following(
        per_period(df, column, unit).select("period", F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("period")).alias("_at")),
        "_at", "period", "next",
    )
    return p.select(
        F.col("period").alias("after"), F.col("next").alias("before"), (F.timestamp_diff(step, F.col("period"), F.col("next")) - 1).alias("empty"),
    ).where("empty > 0")


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """(instant, n) of the instants that occur more than once."""
    return instants(df, column).where("t is not null").groupBy(F.col("t").alias("instant")).agg(F.count("*").alias("n")).where("n > 1")


def cycles(df: DataFrame, column: str, parts: tuple[str, ...] = ("month", "quarter", "weekday", "hour")) -> DataFrame:
    """(part, value, n, share) of months, quarters, weekdays (1: Monday) and hours, in one pass."""
    t = F.col("t")
    rows = instants(df, column).where("t is not null").select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), cycle(t, p).cast("long").alias("value")) for p in parts])).alias("c")).select("c.*")
    got = rows.groupBy("part", "value").agg(F.count("*").alias("n"))
    return got.withColumn("share", share(F.col("n"), F.sum("n").over(Window.partitionBy("part"))))


def bounds(df: DataFrame, column: str, now: str | Column, oldest: str = "1900-01-01") -> DataFrame:
    """One row: instants after `now`, and instants before the plausible limit."""
    t = F.col("t")
    limit = F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now
    return instants(df, column).agg(
        F.count(t).alias("n_valid"), F.count_if(t > limit).alias("future"), F.count_if(t < F.lit(oldest).cast("timestamp_ntz")).alias("too_old"),
    )


def calendar(df: DataFrame, column: str) -> DataFrame:
    """(day, n)."""
    return instants(df, column).where("t is not null").groupBy(F.to_date("t").alias("day")).agg(F.count("*").alias("n"))


def week_grid(df: DataFrame, column: str) -> DataFrame:
    """(weekday, hour, n); weekday 1 is Monday."""
    t = F.col("t")
    return instants(df, column).where("t is not null").groupBy(
        cycle(t, "weekday").cast("long").alias("weekday"), cycle(t, "hour").cast("long").alias("hour"),
    ).agg(F.count("*").alias("n"))


def durations(df: DataFrame, start: str, end: str, name: str = "seconds") -> DataFrame:
    """(name): seconds from one instant to another, ready for the operators of continuous columns."""
    return df.select((F.timestamp_diff("MICROSECOND", col(start).cast("timestamp_ntz"), col(end).cast("timestamp_ntz")) / 1e6).alias(name))


def duration_summary(df: DataFrame, column: str, error: float = 0.0) -> DataFrame:
    """One row of numeric.summary in seconds, with the number of negative durations."""
    from descry.functions.values import number
    from descry.operators import numeric

    negative = df.agg(F.count_if(number(df, column) < 0).alias("n_negative"))
    return numeric.summary(df, column, error).crossJoin(negative)


