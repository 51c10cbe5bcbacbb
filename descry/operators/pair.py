"""Two columns at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from descry.functions.dates import period
from descry.functions.values import col, level, number, share
from descry.operators.freq import everything
from descry.operators.numeric import histogram, quantiles, running


#: Levels of a column in a full grid.
MOST_LEVELS = 1000


def few_levels(df: DataFrame) -> None:
    """Refuse pairs whose full grid would grow with the product of many levels; chi_square, which needs the cells that occur only, takes any."""
    a, b = df.agg(F.approx_count_distinct("a"), F.approx_count_distinct("b")).first()
    if max(a, b) > 1.1 * MOST_LEVELS:
        raise ValueError(f"a grid of about {a} by {b} levels: fold rare levels first, at most {MOST_LEVELS} a column")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, of_all, of_row, of_column) over the full grid of levels, zero cells included."""
    src = df.select(level(df, a).alias("a"), level(df, b).alias("b")).where("a is not null and b is not null")
    seen = src.groupBy("a", "b").agg(F.count("*").alias("n"))
    few_levels(src)
    grid = seen.select("a").distinct().crossJoin(F.broadcast(seen.select("b").distinct()))
    full = grid.join(seen, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))
    return full.select(
        "a", "b", "n", share(F.col("n"), F.sum("n").over(everything())).alias("of_all"),
        share(F.col("n"), F.sum("n").over(Window.partitionBy("a"))).alias("of_row"),
        share(F.col("n"), F.sum("n").over(Window.partitionBy("b"))).alias("of_column"),
    )


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2, Cramer's V (null with a single level), n and the numbers of levels.

    Zero cells add their expected counts, so the statistic is n (sum of n_ij^2 / (n_i n_j) - 1) over the cells that occur.
    """
    seen = df.select(level(df, a).alias("a"), level(df, b).alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))
    cells = seen.select("a", "b", "n", F.sum("n").over(Window.partitionBy("a")).alias("row"), F.sum("n").over(Window.partitionBy("b")).alias("column"))
    got = cells.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("row") * F.col("column"))).alias("s"), F.count_distinct("a").alias("r"),
        F.count_distinct("b").alias("c"),
    )
    chi = F.col("n") * (F.col("s") - 1)
    return got.select(
        F.col("n").cast("long").alias("n"), F.col("r").alias("levels_a"), F.col("c").alias("levels_b"), chi.alias("chi2"),
        F.when(F.least("r", "c") > 1, F.sqrt(F.greatest(chi, F.lit(0.0)) / (F.col("n") * (F.least("r", "c") - 1)))).alias("cramers_v"),
    )


def group_stats(df: DataFrame, category: str, value: str, error: float = 0.0) -> DataFrame:
    """(category, n, mean, sd, min, q1, median, q3, max) of the value by category."""
    src = df.select(level(df, category).alias("category"), number(df, value).alias("x")).where("category is not null and x is not null")
    got = src.groupBy("category").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"),
        quantiles(F.col("x"), [0.25, 0.5, 0.75], error).alias("q"), F.max("x").alias("max"),
    )
    return got.select("category", "n", "mean", "sd", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")


def group_boxes(df: DataFrame, category: str, value: str, error: float = 0.0) -> DataFrame:
    """(category, q1, median, q3, low_whisker, high_whisker, outliers)."""
    src = df.select(level(df, category).alias("category"), number(df, value).alias("x")).where("category is not null and x is not null")
    boxes = group_stats(df, category, value, error).select("category", "q1", "median", "q3")
    inside = F.col("x").between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return src.join(boxes, "category").groupBy("category", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("x"))).alias("low_whisker"), F.max(F.when(inside, F.col("x"))).alias("high_whisker"),
        F.count_if(~inside).alias("outliers"),
    )


def group_densities(df: DataFrame, category: str, value: str, bins: int = 50) -> DataFrame:
    """(category, bin, low, high, n, density) on bins that all categories share."""
    edges = histogram(df, value, bins).select("bin", "low", "high")
    first = edges.agg(F.min("low"), F.max("high"), F.count("*")).first()
    src = df.select(level(df, category).alias("category"), number(df, value).alias("x")).where("category is not null and x is not null")
    if first[0] is None:
        return src.select(
            "category", F.lit(0).cast("long").alias("bin"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0).cast("long").alias("n"),
            F.lit(0.0).alias("density"),
        ).limit(0)
    width = (first[1] - first[0]) / first[2]
    at = F.least(F.floor((F.col("x") - first[0]) / width), F.lit(first[2] - 1)).cast("long") if width else F.lit(0).cast("long")
    got = src.groupBy("category", at.alias("bin")).agg(F.count("*").alias("n")).join(F.broadcast(edges), "bin")
    return got.select(
        "category", "bin", "low", "high", "n",
        (F.col("n") / (F.sum("n").over(Window.partitionBy("category")) * (F.lit(width) if width else F.lit(1.0)))).alias("density"),
    )


def _numbers(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(number(df, a).alias("a"), number(df, b).alias("b")).where("a is not null and b is not null")


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and Pearson's coefficient."""
    return _numbers(df, a, b).agg(F.count("*").alias("n"), F.corr("a", "b").alias("pearson"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and Spearman's coefficient over average ranks. Ranks come from running value counts."""
    src = _numbers(df, a, b).groupBy("a", "b").agg(F.count("*").alias("n"))

    def ranks(c: str) -> DataFrame:
        v = running(src.groupBy(c).agg(F.sum("n").alias("m")), c, "m", "upto")
        return v.select(F.col(c), (F.col("upto") - F.col("m") + (F.col("m") + 1) / 2.0).alias(f"r{c}"))

    r = src.join(ranks("a"), "a").join(ranks("b"), "b")
    n = F.sum("n").cast("double")
    mean = (n + 1) / 2
    cov = F.sum(F.col("n") * F.col("ra") * F.col("rb")) - n * mean * mean
    var = lambda c: F.sum(F.col("n") * F.col(c) * F.col(c)) - n * mean * mean
    return r.agg(F.sum("n").alias("n"), (cov / F.nullif(F.sqrt(var("ra") * var("rb")), F.lit(0.0))).alias("spearman"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and Kendall's tau-b from the contingency table, for columns of few levels."""
    few_levels(_numbers(df, a, b))
    t = _numbers(df, a, b).groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))
    x, y = t.alias("x"), t.alias("y")
    sign = F.signum(F.col("x.a") - F.col("y.a")) * F.signum(F.col("x.b") - F.col("y.b"))
    both = x.crossJoin(F.broadcast(y)).agg(F.sum(F.col("x.n") * F.col("y.n") * sign).alias("s"))
    total = t.agg(F.sum("n").alias("n"))
    ties = lambda c: t.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias(f"t{c}"))
    got = both.crossJoin(total).crossJoin(ties("a")).crossJoin(ties("b"))
    n2 = F.col("n") * F.col("n")
    return got.select(F.col("n").cast("long").alias("n"), (F.col("s") / F.nullif(F.sqrt((n2 - F.col("ta")) * (n2 - F.col("tb"))), F.lit(0.0))).alias("tau_b"))


def trend(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: slope and intercept of b on a, and r squared."""
    return _numbers(df, a, b).agg(F.regr_slope("b", "a").alias("slope"), F.regr_intercept("b", "a").alias("intercept"), F.regr_r2("b", "a").alias("r2"))


def grid(df: DataFrame, a: str, b: str, bins: int = 20) -> DataFrame:
    """(bin_a, bin_b, n): points counted in a square grid; the only form in which two continuous columns leave the cluster whole."""
    src = _numbers(df, a, b)
    lo_a, hi_a, lo_b, hi_b = src.agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    if lo_a is None:
        return df.sparkSession.createDataFrame([], "bin_a long, bin_b long, n long")
    at = lambda c, lo, hi: F.least(
        F.floor((F.col(c) - lo) / ((hi - lo) / bins)), F.lit(bins - 1),
    ).cast("long") if hi > lo else F.lit(0).cast("long")
    return src.groupBy(at("a", lo_a, hi_a).alias("bin_a"), at("b", lo_b, hi_b).alias("bin_b")).agg(F.count("*").alias("n"))


def sample(df: DataFrame, columns: list[str], size: int = 1000, seed: int = 7) -> DataFrame:
    """The rows with the smallest hashes: the same rows each time, whatever the partitioning."""
    picked = df.select(*[col(c).alias(c) for c in columns])
    return picked.orderBy(F.xxhash64(F.lit(seed), *[col(c) for c in columns]), *[col(c) for c in columns]).limit(size)


def period_by_category(df: DataFrame, instant: str, category: str, unit: str = "day") -> DataFrame:
    """(period, category, n, of_period)."""
    src = df.select(
        period(col(instant).cast("timestamp_ntz"), unit).alias("period"), level(df, category).alias("category"),
    ).where("period is not null and category is not null")
    got = src.groupBy("period", "category").agg(F.count("*").alias("n"))
    return got.withColumn("of_period", share(F.col("n"), F.sum("n").over(Window.partitionBy("period"))))


def period_metric(df: DataFrame, instant: str, value: str, unit: str = "day", error: float = 0.0) -> DataFrame:
    """(period, n, mean, total, q1, median, q3)."""
    src = df.select(
        period(col(instant).cast("timestamp_ntz"), unit).alias("period"), number(df, value).alias("x"),
    ).where("period is not null and x is not null")
    got = src.groupBy("period").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.sum("x").alias("total"), quantiles(F.col("x"), [0.25, 0.5, 0.75], error).alias("q"),
    )
    return got.select("period", "n", "mean", "total", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
