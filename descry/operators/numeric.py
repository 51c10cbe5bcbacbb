"""Discrete and continuous columns. NaN counts as missing everywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descry.functions.values import clean, field, number, share
from descry.operators.freq import everything


def values(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of the non-null values; whole-number columns keep their type."""
    return df.select(clean(df, column).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def quantiles(x: Column, qs: list[float], error: float = 0.0) -> Column:
    """Linearly interpolated quantiles; with an error, those of a sketch whose ranks are off by at most that share."""
    return F.percentile(x, qs) if not error else F.percentile_approx(x, qs, max(1, math.ceil(1 / error)))


#: Different values that an exact quantile may keep in one task.
MOST_VALUES = 1_000_000


def exact_quantiles(df: DataFrame, column: str, qs: list[float]) -> list[float | None]:
    """Linearly interpolated quantiles by running counts over ranges of values; no task sees all values."""
    v = values(df.select(number(df, column).alias("x")), "x")
    total = v.agg(F.sum("n")).first()[0]
    if not total:
        return [None] * len(qs)
    at = [(total - 1) * q for q in qs]
    upto = running(v, "value", "n", "_upto")
    place = lambda k: F.min(F.when(F.col("_upto") > k, F.col("value")))
    got = upto.agg(*[place(f(p)).alias(f"{i} {f.__name__}") for i, p in enumerate(at) for f in (math.floor, math.ceil)]).first()
    between = lambda p, low, high: low if p == math.floor(p) else (math.ceil(p) - p) * low + (p - math.floor(p)) * high
    return [between(p, got[f"{i} floor"], got[f"{i} ceil"]) for i, p in enumerate(at)]


def quantile_column(df: DataFrame, column: str, x: Column, qs: list[float], error: float, most: int | None = None) -> Column:
    """quantiles() as an aggregate of `x`; exact ones of a column of many values are found beforehand, and stand there as literals."""
    many = not error and (df.agg(F.approx_count_distinct(number(df, column))).first()[0] or 0) > (MOST_VALUES if most is None else most)
    if not many:
        return quantiles(x, qs, error)
    return F.array(*[F.lit(q).cast("double") for q in exact_quantiles(df, column, qs)])


def moments(x: Column) -> dict[str, Column]:
    """Sample standard deviation, skewness and excess kurtosis, adjusted for the sample size as data frames in Python usually are."""
    n = F.count(x).cast("double")
    g1, g2 = F.skewness(x), F.kurtosis(x)
    varied = F.coalesce(F.stddev_pop(x), F.lit(0.0)) > 0
    return {
        "sd": F.stddev_samp(x),
        "skewness": F.when((n > 2) & varied, g1 * F.sqrt(n * (n - 1)) / (n - 2)),
        "kurtosis": F.when((n > 3) & varied, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)),
    }


QUANTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p1": 0.01, "p5": 0.05, "p95": 0.95, "p99": 0.99}


def summary_parts(x: Column, q: Column) -> dict[str, Column]:
    """The aggregates of a summary; `q` holds the QUANTILES."""
    return {
        "n": F.count("*"), "n_valid": F.count(x), "min": F.min(x), "max": F.max(x), "mean": F.avg(x), "q": q,
        "zeros": share(F.count_if(x == 0), F.count(x)), "negatives": share(F.count_if(x < 0), F.count(x)),
    } | moments(x)


def summary(df: DataFrame, column: str, error: float = 0.0) -> DataFrame:
    """One row of everything that one pass gives: counts, five numbers, mean, moments, tails, shares of zeros and negatives, quantile_error.

    Exact quantiles (no error) of a column with more than MOST_VALUES different values come from running counts.
    """
    x = F.col("x")
    q = quantile_column(df, column, x, list(QUANTILES.values()), error)
    got = df.select(number(df, column).alias("x")).agg(*[c.alias(k) for k, c in summary_parts(x, q).items()])
    got = got.select(
        "n", "n_valid", (F.col("n") - F.col("n_valid")).alias("n_missing"), "min", "max", "mean",
        *[F.col("q")[i].alias(name) for i, name in enumerate(QUANTILES)], "sd", "skewness", "kurtosis", "zeros", "negatives",
    )
    return got.select(
        "*", (F.col("q3") - F.col("q1")).alias("iqr"), (F.col("sd") / F.nullif(F.col("mean"), F.lit(0.0))).alias("cv"),
        F.lit(float(error)).alias("quantile_error"),
    )


def summaries(df: DataFrame, columns: list[str], error: float = 0.0) -> dict[str, dict]:
    """The summary of each column, with outlier counts and whiskers: two scans, however many columns."""
    if not columns:
        return {}
    parts = {c: summary_parts(number(df, c), quantile_column(df, c, number(df, c), list(QUANTILES.values()), error)) for c in columns}
    first = df.agg(*[x.alias(f"{i} {k}") for i, c in enumerate(columns) for k, x in parts[c].items()]).first()
    out = {}
    for i, c in enumerate(columns):
        s = {k: first[f"{i} {k}"] for k in parts[c]}
        q = s.pop("q") or [None] * len(QUANTILES)
        s |= dict(zip(QUANTILES, q, strict=True)) | {"n_missing": s["n"] - s["n_valid"], "quantile_error": float(error)}
        s["iqr"] = None if s["q1"] is None else s["q3"] - s["q1"]
        s["cv"] = s["sd"] / s["mean"] if s["sd"] is not None and s["mean"] else None
        out[c] = s
    known = [(i, c) for i, c in enumerate(columns) if out[c]["iqr"] is not None]
    if known:
        cols = []
        for i, c in known:
            x, s = number(df, c), out[c]
            inside = x.between(s["q1"] - 1.5 * s["iqr"], s["q3"] + 1.5 * s["iqr"])
            cols += [F.count_if(~inside).alias(f"{i} n"), F.min(F.when(inside, x)).alias(f"{i} low"), F.max(F.when(inside, x)).alias(f"{i} high")]
        second = df.agg(*cols).first()
        for i, c in known:
            out[c] |= {
                "outliers": second[f"{i} n"], "outlier_share": second[f"{i} n"] / out[c]["n_valid"], "low_whisker": second[f"{i} low"],
                "high_whisker": second[f"{i} high"],
            }
    return out


def five_numbers(df: DataFrame, column: str, error: float = 0.0) -> DataFrame:
    return summary(df, column, error).select("min", "q1", "median", "mean", "q3", "max")


def outliers(df: DataFrame, column: str, error: float = 0.0) -> DataFrame:
    """One row: fences at 1.5 IQR beyond the quartiles, values outside and their share, whiskers at the outermost values inside."""
    src = df.select(number(df, column).alias("x")).where("x is not null")
    q = src.agg(quantile_column(df, column, F.col("x"), [0.25, 0.75], error).alias("q")).select(
        (F.col("q")[0] - 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("low_fence"),
        (F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("high_fence"),
    )
    inside = F.col("x").between(F.col("low_fence"), F.col("high_fence"))
    got = src.crossJoin(F.broadcast(q)).groupBy("low_fence", "high_fence").agg(
        F.count_if(~inside).alias("outliers"), share(F.count_if(~inside), F.count("*")).alias("share"),
        F.min(F.when(inside, F.col("x"))).alias("low_whisker"), F.max(F.when(inside, F.col("x"))).alias("high_whisker"),
    )
    return got


def boxplot(df: DataFrame, column: str, error: float = 0.0) -> DataFrame:
    """One row: quartiles, whiskers and the number of outliers."""
    five = summary(df, column, error).select("q1", "median", "q3")
    return five.crossJoin(outliers(df, column, error).select("low_whisker", "high_whisker", "outliers"))


def value_extremes(df: DataFrame, column: str, levels: int = 5) -> DataFrame:
    """(end, position, value, n): the smallest and the largest different values."""
    v = values(df, column)
    out = None
    for end, order in (("smallest", F.asc("value")), ("largest", F.desc("value"))):
        part = v.orderBy(order).limit(levels).select(
            F.lit(end).alias("end"), F.row_number().over(Window.orderBy(order)).cast("long").alias("position"),
            F.col("value").cast("double").alias("value"), "n",
        )
        out = part if out is None else out.unionByName(part)
    return out


def frequency_extremes(df: DataFrame, column: str, levels: int = 5, middle: bool = False) -> DataFrame:
    """(end, position, value, n): most frequent values (ties: smaller first), least frequent ones (ties: most extreme first, then the positive one), and on request those in the middle."""
    v = values(df, column).select(F.col("value").cast("double").alias("value"), "n")
    ends = [("most", [F.desc("n"), F.asc("value")]), ("least", [F.asc("n"), F.desc(F.abs("value")), F.desc("value")])]
    out = None
    for end, order in ends:
        part = v.orderBy(*order).limit(levels).select(
            F.lit(end).alias("end"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("position"), "value", "n",
        )
        out = part if out is None else out.unionByName(part)
    if middle:
        ranked = v.select("value", "n", F.row_number().over(Window.orderBy(*ends[0][1])).cast("long").alias("r"), F.count("*").over(everything()).alias("k"))
        start = F.floor((F.col("k") - levels) / 2)
        mid = ranked.where((F.col("r") > start) & (F.col("r") <= start + levels))
        out = out.unionByName(mid.select(F.lit("middle").alias("end"), F.row_number().over(Window.orderBy("r")).cast("long").alias("position"), "value", "n"))
    return out


def table(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share, cumulative) by value, and the missing as a last row without a cumulative share."""
    v = df.groupBy(clean(df, column).alias("value")).agg(F.count("*").alias("n"))
    missing = df.agg(F.count_if(clean(df, column).isNull()).alias("n")).select(F.lit(None).cast("double").alias("value"), "n")
    rows = v.where("value is not null").select(F.col("value").cast("double").alias("value"), "n").unionByName(missing)
    by = Window.orderBy(F.asc_nulls_last("value")).rowsBetween(Window.unboundedPreceding, 0)
    valid = F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).over(everything())
    return rows.select(
        "value", "n", share(F.col("n"), F.sum("n").over(everything())).alias("share"),
        F.when(F.col("value").isNotNull(), share(F.sum("n").over(by), valid)).alias("cumulative"),
    )


def following(df: DataFrame, key: str, value: str, into: str, zones: int = 200) -> DataFrame:
    """`df` with the `value` of the row with the next larger key; keys are numbers, each once.

    Rows meet within ranges between quantiles; the first row of each range, at most `zones` of them, is handed to the range before.
    """
    zoned = zones_of(df, key, zones)
    firsts = zoned.groupBy("_zone").agg(F.min_by(value, key).alias("_first"))
    after = firsts.select("_zone", F.lead("_first").over(Window.orderBy("_zone")).alias("_after"))
    inside = F.lead(value).over(Window.partitionBy("_zone").orderBy(key))
    return zoned.withColumn(into, inside).join(F.broadcast(after), "_zone").withColumn(into, F.coalesce(into, "_after")).drop("_zone", "_after")


def zones_of(df: DataFrame, key: str, zones: int) -> DataFrame:
    """`df` with `_zone`, the number of the range between quantiles that a row's key is in."""
    bounds = df.agg(F.percentile_approx(key, [i / zones for i in range(1, zones)], 10 * zones)).first()[0] or []
    edges = F.array(*[F.lit(float(b)) for b in sorted(set(bounds))]).cast("array<double>")
    return df.withColumn("_zone", F.size(F.filter(edges, lambda b: b <= F.col(key))))


def hole_ranges(df: DataFrame, column: str) -> DataFrame:
    """(low, high, n): ranges of whole numbers between the least and the greatest value that don't occur; one row for each, however wide it is."""
    v = values(df, column).select(F.col("value").cast("long").alias("value")).distinct()
    gap = following(v, "value", "value", "after").where("after > value + 1")
    return gap.select((F.col("value") + 1).alias("low"), (F.col("after") - 1).alias("high"), (F.col("after") - F.col("value") - 1).alias("n"))


def holes(df: DataFrame, column: str) -> DataFrame:
    """(value): the numbers of hole_ranges one by one; for columns whose ranges are known to be narrow. A wide range is cut where a task's rows end."""
    part = 100_000
    pieces = hole_ranges(df, column).select(
        "low", "high", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("n") - 1, F.lit(part)))).alias("_k"),
    )
    return pieces.select(
        F.explode(F.sequence(F.col("low") + F.col("_k") * part, F.least(F.col("high"), F.col("low") + F.col("_k") * part + part - 1))).alias("value")
    )


def bins_for(n: int, most: int = 50) -> int:
    """Sturges' number of bins."""
    return max(1, min(most, math.ceil(math.log2(max(n, 1))) + 1))


def bin_plan(lo: float, hi: float, n: int, bins: int | None, whole: bool, most: int = 50) -> tuple[float, int]:
    """(width, number) of the bins; whole: widths are whole numbers."""
    count = bins or bins_for(n, most)
    if whole:
        width = float(max(1, math.ceil((hi - lo + 1) / count)))
        return width, math.ceil((hi - lo + 1) / width)
    return (hi - lo) / count, count


def bin_of(x: Column, lo: float, width: float, count: int) -> Column:
    return (F.least(F.floor((x - lo) / width), F.lit(count - 1)) if width else F.lit(0)).cast("long")


def histogram(df: DataFrame, column: str, bins: int | None = None, whole: bool = False, most: int = 50) -> DataFrame:
    """(bin, low, high, n): bins of equal width, the empty ones too; the greatest value falls into the last. whole: widths are whole numbers."""
    src = df.select(number(df, column).alias("x")).where("x is not null")
    lo, hi, n = src.agg(F.min("x"), F.max("x"), F.count("*")).first()
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin long, low double, high double, n long")
    width, count = bin_plan(lo, hi, n, bins, whole, most)
    got = src.groupBy(bin_of(F.col("x"), lo, width, count).alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(count).select(F.col("id").alias("bin")).join(F.broadcast(got), "bin", "left").select(
        "bin", (lo + F.col("bin") * width).alias("low"), (lo + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"),
    )


def histograms(df: DataFrame, ranges: dict[str, dict], whole: set[str], most: int = 50) -> dict[str, list[dict]]:
    """The histogram of each column whose summary is known, all counted in one scan."""
    plans = {c: (s["min"], *bin_plan(s["min"], s["max"], s["n_valid"], None, c in whole, most)) for c, s in ranges.items() if s["n_valid"]}
    if not plans:
        return {}
    names = list(plans)
    cells = F.array(
        *[F.struct(F.lit(i).alias("i"), F.when(number(df, c).isNotNull(), bin_of(number(df, c), *plans[c])).alias("bin")) for i, c in enumerate(names)]
    )
    got = df.select(F.explode(cells).alias("c")).where("c.bin is not null").groupBy("c.i", "c.bin").agg(F.count("*").alias("n")).collect()
    seen = {(names[r["i"]], r["bin"]): r["n"] for r in got}
    return {c: [{"bin": k, "low": lo + k * width, "high": lo + (k + 1) * width, "n": seen.get((c, k), 0)} for k in range(count)] for c, (lo, width, count) in plans.items()}


def running(df: DataFrame, key: str, n: str, into: str, zones: int = 200) -> DataFrame:
    """`df` with the sum of `n` over all rows whose key is at most the row's; keys are numbers, each once.

    Rows are summed within ranges between quantiles, and the ranges' totals, at most `zones` of them, are added up apart; no task sees all rows.
    """
    zoned = zones_of(df, key, zones)
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_zone").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = zoned.groupBy("_zone").agg(F.sum(n).alias("_sum")).select("_zone", before.alias("_before"))
    inside = F.sum(n).over(Window.partitionBy("_zone").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return zoned.join(F.broadcast(starts), "_zone").withColumn(into, F.col("_before") + inside).drop("_zone", "_before")


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """(value, n, at_most): share of valid rows with that value or less."""
    v = values(df, column).select(F.col("value").cast("double").alias("value"), "n")
    total = v.agg(F.sum("n").alias("_total"))
    return running(v, "value", "n", "_upto").crossJoin(F.broadcast(total)).select("value", "n", share(F.col("_upto"), F.col("_total")).alias("at_most"))


def density(df: DataFrame, column: str, points: int = 100, bins: int = 200) -> DataFrame:
    """(x, density): a Gaussian kernel density over histogram bins, by Silverman's rule; only bins are paired with points."""
    s = summary(df, column).first()
    if not s["n_valid"] or not s["sd"]:
        return df.sparkSession.createDataFrame([], "x double, density double")
    spread = min(s["sd"], (s["iqr"] or 0) / 1.34 or s["sd"])
    h = 0.9 * spread * s["n_valid"] ** -0.2
    grid = df.sparkSession.range(points).select((s["min"] - 3 * h + F.col("id") * ((s["max"] - s["min"] + 6 * h) / (points - 1))).alias("x"))
    b = histogram(df, column, bins).where("n > 0").select(((F.col("low") + F.col("high")) / 2).alias("m"), "n")
    z = (F.col("x") - F.col("m")) / h
    return grid.crossJoin(F.broadcast(b)).groupBy("x").agg(
        (F.sum(F.col("n") * F.exp(-z * z / 2)) / (s["n_valid"] * h * math.sqrt(2 * math.pi))).alias("density")
    )


def density_of(s: dict, bins: list[dict], points: int = 100) -> list[dict]:
    """(x, density) from a summary and its histogram, by the same rule as `density`; nothing is read again."""
    if not s["n_valid"] or not s["sd"] or not bins:
        return []
    h = 0.9 * min(s["sd"], (s["iqr"] or 0) / 1.34 or s["sd"]) * s["n_valid"] ** -0.2
    out = []
    for i in range(points):
        x = s["min"] - 3 * h + i * (s["max"] - s["min"] + 6 * h) / (points - 1)
        total = sum(b["n"] * math.exp(-(((x - (b["low"] + b["high"]) / 2) / h) ** 2) / 2) for b in bins if b["n"])
        out.append({"x": x, "density": total / (s["n_valid"] * h * math.sqrt(2 * math.pi))})
    return out


def normal_quantiles(s: dict) -> list[dict]:
    """(p, theoretical, observed) of the summary's quantiles beside a normal distribution with the same mean and deviation."""
    from statistics import NormalDist

    return [{"p": p, "theoretical": s["mean"] + (s["sd"] or 0.0) * NormalDist().inv_cdf(p), "observed": float(s[name])} for name, p in sorted(QUANTILES.items(), key=lambda x: x[1])]


def qq(df: DataFrame, column: str, points: int = 99, error: float = 0.0) -> DataFrame:
    """(p, theoretical, observed): quantiles beside those of a normal distribution with the same mean and deviation."""
    from statistics import NormalDist

    ps = [(i + 1) / (points + 1) for i in range(points)]
    got = df.select(number(df, column).alias("x")).agg(quantiles(F.col("x"), ps, error), F.avg("x"), F.stddev_samp("x")).first()
    rows = [] if got[0] is None else [(p, got[1] + (got[2] or 0.0) * NormalDist().inv_cdf(p), float(o)) for p, o in zip(ps, got[0], strict=True)]
    return df.sparkSession.createDataFrame(rows, "p double, theoretical double, observed double")


def whole(df: DataFrame, column: str) -> bool:
    """Whether the column's type holds whole numbers only."""
    return field(df, column).typeName() in ("byte", "short", "integer", "long", "tinyint", "smallint", "int", "bigint")
