"""Textual columns: form, pattern and dirt of the strings, with directed samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.functions import strings
from descry.functions.values import col, share
from descry.operators import numeric


def form(df: DataFrame, column: str) -> DataFrame:
    """One row: least, median, mean and greatest length in characters, and the same of tokens."""
    src = df.select(F.char_length(col(column)).cast("double").alias("c"), strings.tokens(col(column)).cast("double").alias("t"))
    return src.agg(
        F.count("c").alias("n_valid"), F.min("c").alias("min_length"), F.percentile("c", 0.5).alias("median_length"), F.avg("c").alias("mean_length"),
        F.max("c").alias("max_length"), F.min("t").alias("min_tokens"), F.percentile("t", 0.5).alias("median_tokens"), F.max("t").alias("max_tokens"),
    )


def lengths(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Histogram of lengths in characters."""
    return numeric.histogram(df.select(F.char_length(col(column)).alias("length")), "length", bins, whole=True)


def tokens(df: DataFrame, column: str) -> DataFrame:
    """(tokens, n)."""
    return df.where(col(column).isNotNull()).groupBy(strings.tokens(col(column)).cast("long").alias("tokens")).agg(F.count("*").alias("n"))


def extremes(df: DataFrame, column: str, size: int = 10) -> DataFrame:
    """(end, value, length): the shortest and the longest different strings, ties by text."""
    v = df.select(col(column).alias("value")).where("value is not null").distinct().withColumn("length", F.char_length("value").cast("long"))
    short = v.orderBy("length", "value").limit(size).select(F.lit("shortest").alias("end"), "value", "length")
    return short.unionByName(v.orderBy(F.desc("length"), "value").limit(size).select(F.lit("longest").alias("end"), "value", "length"))


def patterns(df: DataFrame, column: str) -> DataFrame:
    """(pattern, n, share): values of each known format."""
    c = strings.strip(col(column))
    got = df.agg(F.count(c).alias("n_valid"), *[F.count_if(c.rlike(rule)).alias(name) for name, rule in strings.PATTERNS.items()])
    names = ", ".join(f"'{p}', `{p}`" for p in strings.PATTERNS)
    return got.select(
        "n_valid", F.expr(f"stack({len(strings.PATTERNS)}, {names}) as (pattern, n)"),
    ).select("pattern", "n", share(F.col("n"), F.col("n_valid")).alias("share"))


def dominant_pattern(df: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent known format (ties: by name), and how many values adhere to it; null where none occurs."""
    return patterns(df, column).agg(F.min_by(F.struct("pattern", "n", "share"), F.struct((-F.col("n")).alias("n"), "pattern")).alias("p")).select(
        F.when(F.col("p.n") > 0, F.col("p.pattern")).alias("pattern"), F.col("p.n").alias("n"), F.col("p.share").alias("share"),
    )


def violations(df: DataFrame, column: str, pattern: str, size: int = 10) -> DataFrame:
    """(value): different values that don't adhere to a format, the first ones by text."""
    return df.select(col(column).alias("value")).where(~strings.strip(F.col("value")).rlike(strings.PATTERNS[pattern])).distinct().orderBy("value").limit(size)


def masks(df: DataFrame, column: str, top_n: int | None = None) -> DataFrame:
    """(mask, n): formats with capitals as A, small letters as a and digits as 9."""
    out = df.where(col(column).isNotNull()).groupBy(strings.mask(col(column)).alias("mask")).agg(F.count("*").alias("n"))
    return out if top_n is None else out.orderBy(F.desc("n"), "mask").limit(top_n)


def cases(df: DataFrame, column: str) -> DataFrame:
    """(style, n, share): lower, upper, title, mixed, none."""
    out = df.where(col(column).isNotNull()).groupBy(strings.letter_case(col(column)).alias("style")).agg(F.count("*").alias("n"))
    from descry.operators.freq import everything

    return out.withColumn("share", share(F.col("n"), F.sum("n").over(everything())))


def disguised(df: DataFrame, column: str) -> DataFrame:
    """One row: values that stand for a missing one, and texts that could be cast to a number."""
    c = col(column)
    return df.agg(
        F.count(c).alias("n_valid"), F.count_if(strings.disguised(c)).alias("disguised"),
        share(F.count_if(strings.disguised(c)), F.count(c)).alias("share"), F.count(strings.strip(c).try_cast("double")).alias("castable"),
    )


def dirt(df: DataFrame, column: str) -> DataFrame:
    """(check_name, n, share): how many values each check of the battery finds, all in one pass."""
    checks = strings.dirt(col(column))
    got = df.agg(F.count(col(column)).alias("n_valid"), *[F.count_if(c).alias(k) for k, c in checks.items()])
    names = ", ".join(f"'{k}', `{k}`" for k in checks)
    return got.select(
        "n_valid", F.expr(f"stack({len(checks)}, {names}) as (check_name, n)"),
    ).select("check_name", "n", share(F.col("n"), F.col("n_valid")).alias("share"))


def offenders(df: DataFrame, column: str, check: str, size: int = 10) -> DataFrame:
    """(value): different values that a check finds, the first ones by text."""
    return df.where(strings.dirt(col(column))[check]).select(col(column).alias("value")).distinct().orderBy("value").limit(size)
