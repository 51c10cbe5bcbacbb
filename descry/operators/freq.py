"""Frequencies of nominal, binary and identifier columns. Windows stand after the group-by: they see levels, never rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from descry.functions.strings import ascii_key, variant_key
from descry.functions.values import level, share

MISSING = "(missing)"


def everything():
    """The window of all rows of a table of levels."""
    return Window.partitionBy()


def counts(df: DataFrame, column: str, top_n: int | None = None) -> DataFrame:
    """(level, n) of the non-null values; with top_n, the most frequent ones, ties by level."""
    out = df.select(level(df, column).alias("level")).where("level is not null").groupBy("level").agg(F.count("*").alias("n"))
    return out if top_n is None else out.orderBy(F.desc("n"), "level").limit(top_n)


def counts_with_missing(df: DataFrame, column: str) -> DataFrame:
    """(level, n) where null is a level of its own."""
    return df.groupBy(level(df, column).alias("level")).agg(F.count("*").alias("n"))


def binary_table(df: DataFrame, column: str) -> DataFrame:
    """(level, n, of_total, of_valid), the missing always as a row, without a share of the valid."""
    seen = counts_with_missing(df, column).where("level is not null")
    missing = df.agg(F.count_if(level(df, column).isNull()).alias("n")).select(F.lit(MISSING).alias("level"), "n")
    rows = seen.unionByName(missing)
    valid = F.sum(F.when(F.col("level") != MISSING, F.col("n")).otherwise(0)).over(everything())
    return rows.select(
        "level", "n", share(F.col("n"), F.sum("n").over(everything())).alias("of_total"),
        F.when(F.col("level") != MISSING, share(F.col("n"), valid)).alias("of_valid"),
    )


def balance(df: DataFrame, column: str) -> DataFrame:
    """One row: the dominant level and how many times more frequent it is than the least frequent one."""
    c = counts(df, column)
    return c.agg(F.min_by("level", F.struct((-F.col("n")).alias("n"), "level")).alias("dominant"), share(F.max("n"), F.min("n")).alias("ratio"))


def table(df: DataFrame, column: str) -> DataFrame:
    """(level, n, share, cumulative, rank) by frequency."""
    by = Window.orderBy(F.desc("n"), "level")
    total = F.sum("n").over(everything())
    return counts(df, column).select(
        "level", "n", share(F.col("n"), total).alias("share"),
        share(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)), total).alias("cumulative"),
        F.row_number().over(by).cast("long").alias("rank"),
    )


def by_frequency(df: DataFrame, column: str) -> DataFrame:
    """(n, levels, least): how many levels occur n times, and the first of them. As many rows as there are different counts, however many levels."""
    return counts(df, column).groupBy("n").agg(F.count("*").alias("levels"), F.min("level").alias("least"))


def shape(df: DataFrame, column: str, rare_pct: float = 1.0) -> DataFrame:
    """One row: k, mode and its share, imbalance, normalised entropy (null for one level), Herfindahl index, number of rare levels."""
    c = by_frequency(df, column).withColumn("p", share(F.col("n"), F.sum(F.col("n") * F.col("levels")).over(everything())))
    k, p, m = F.sum("levels"), F.col("p"), F.col("levels")
    return c.agg(
        F.coalesce(k, F.lit(0)).alias("k"), F.max_by("least", "n").alias("mode"), F.max("p").alias("mode_share"), share(F.max("n"), F.min("n")).alias("imbalance"),
        F.when(k > 1, -F.sum(m * p * F.ln(p)) / F.ln(k.cast("double"))).alias("entropy"), F.sum(m * p * p).alias("herfindahl"), F.coalesce(F.sum(F.when(p * 100 < rare_pct, m)), F.lit(0)).alias("rare_levels"),
    )


def top(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """(position, level, n, levels, share): the top_n levels, and one row "Others" that says how many levels it holds. Only the top_n are sorted."""
    c = counts(df, column)
    head = c.orderBy(F.desc("n"), "level").limit(top_n)
    total = c.agg(F.sum("n").alias("all_n"), F.count("*").alias("all_k"))
    ranked = head.select(
        F.row_number().over(Window.orderBy(F.desc("n"), "level")).cast("long").alias("position"), "level", "n", F.lit(1).cast("long").alias("levels"),
    )
    rest = ranked.agg(F.sum("n").alias("head_n"), F.count("*").alias("head_k")).crossJoin(F.broadcast(total))
    others = rest.where("all_k > head_k").select(
        (F.col("head_k") + 1).alias("position"), F.lit("Others").alias("level"), (F.col("all_n") - F.col("head_n")).alias("n"),
        (F.col("all_k") - F.col("head_k")).alias("levels"),
    )
    return ranked.unionByName(others).withColumn("share", share(F.col("n"), F.sum("n").over(everything())))


def concentration(df: DataFrame, column: str, percents: tuple[int, ...] = (50, 80, 95)) -> DataFrame:
    """(percent, levels): one more than the levels whose cumulative count stays within the percentage, at most k.

    Levels with equal counts are folded into one row first, so that the ordering sees as many rows as there are different counts.
    """
    by_n = by_frequency(df, column)
    below = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    cum = by_n.select(
        "n", "levels", F.coalesce(F.sum(F.col("n") * F.col("levels")).over(below), F.lit(0)).alias("before"),
        F.sum(F.col("n") * F.col("levels")).over(everything()).alias("total"), F.sum("levels").over(everything()).alias("k"),
    )
    out = None
    for p in percents:
        inside = F.greatest(F.lit(0), F.least(F.col("levels"), F.floor((F.lit(p) * F.col("total") - 100 * F.col("before")) / (100 * F.col("n")))))
        row = cum.agg(F.lit(p).cast("long").alias("percent"), F.least(F.sum(inside) + 1, F.max("k")).cast("long").alias("levels"))
        out = row if out is None else out.unionByName(row)
    return out


def singletons(df: DataFrame, column: str) -> DataFrame:
    """One row: levels seen once, and their share of all levels."""
    return counts(df, column).agg(
        F.count_if(F.col("n") == 1).alias("singletons"), F.count("*").alias("k"), share(F.count_if(F.col("n") == 1), F.count("*")).alias("share"),
    )


def variants(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """(key, level, n, members): levels that differ only by case, accents, edges or repeated blanks. Keys are made of distinct levels only.

    exact=False takes the key that stays in the JVM and knows Latin accents only.
    """
    c = counts(df, column)
    keyed = c.withColumn("key", variant_key("level") if exact else ascii_key(F.col("level")))
    return keyed.withColumn("members", F.count("*").over(Window.partitionBy("key"))).where("members > 1").select("key", "level", "n", "members")


def variant_groups(df: DataFrame, column: str, exact: bool = True) -> dict[str, dict[str, int]]:
    """{key: {level: n}} of variants()."""
    out: dict[str, dict[str, int]] = {}
    for key, name, n, _ in variants(df, column, exact).orderBy("key", F.desc("n"), "level").toLocalIterator():
        out.setdefault(key, {})[name] = n
    return out


def identifier(df: DataFrame, column: str) -> DataFrame:
    """One row: n, n_valid, k, collisions (valid rows beyond one for each value), values that repeat."""
    c = counts(df, column)
    seen = c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_valid"), F.count("*").alias("k"), F.count_if(F.col("n") > 1).alias("repeated_values"))
    return df.agg(F.count("*").alias("n")).crossJoin(seen).select(
        "n", "n_valid", "k", (F.col("n_valid") - F.col("k")).alias("collisions"), "repeated_values",
        (F.col("n_valid") == F.col("k")).alias("is_unique"),
    )


def most_common(df: DataFrame, column: str, where: str | None = None) -> DataFrame:
    """Counts by level, most frequent first, of the rows that a condition leaves."""
    return counts(df.where(where) if where else df, column).orderBy(F.desc("n"), "level")
