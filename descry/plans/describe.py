"""A whole profile: metadata and routes first, then the aggregates that each kind of column asks for; only aggregates are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descry.config import Config
from descry.functions.dates import parse, smart_unit
from descry.functions.values import batch_only, col
from descry.kinds import CardinalityRegime as R
from descry.kinds import VariableClass as C
from descry.kinds import VariableSubtype as S
from descry.kinds import VariableType
from descry.narrative import narrate, rephrased
from descry.operators import freq, numeric, ordinal, temporal, text
from descry.plans.meta import collect_metadata
from descry.plans.route import infer_schema
from descry.profiles import ColumnProfile, DatasetProfile, VizSuggestion


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def one(df: DataFrame) -> dict:
    got = df.first()
    return got.asDict(True) if got else {}


def schema_of(df: DataFrame, config: Config | None = None, overrides: dict[str, VariableType] | None = None) -> tuple[dict[str, dict], dict[str, VariableType]]:
    """(metadata, kinds). Text columns of few levels whose labels all begin with different numbers are ordinal."""
    config = config or Config()
    batch_only(df)
    meta = collect_metadata(df, config)
    few = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and 2 < (meta[f.name]["n_distinct"] or 0) <= config.max_categorical_levels]
    orders = {c: o for c in few if (o := ordinal.order_by_number(df, c))}
    return meta, infer_schema(meta, overrides, config, orders)


def describe(
    df: DataFrame, overrides: dict[str, VariableType] | None = None, config: Config | None = None, columns: list[str] | None = None,
    rephrase: Callable[[str], str] | None = None, now: str | None = None,
) -> DatasetProfile:
    """Profile every column of a batch DataFrame (or the named ones). `now` (default: the session's clock) tells which instants lie in the future.

    Moments, quantiles, outliers and histograms of all numeric columns come from three scans; the others take a scan for each table of levels.
    """
    config = config or Config()
    batch_only(df)
    if columns:
        df = df.select(*[col(c).alias(c) for c in columns])
    _, kinds = schema_of(df, config, overrides)
    counted = one(df.agg(F.count("*").alias("n"), *[F.count_if(col(c).isNull() | (F.isnan(col(c)) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else F.lit(False))).alias(f"m{i}") for i, c in enumerate(df.columns)]))
    known = [c for i, c in enumerate(df.columns) if counted["n"] > counted[f"m{i}"]]
    numbers = [c for c in known if kinds[c].subtype in (S.DISCRETE, S.CONTINUOUS, S.DURATION)]
    stats = numeric.summaries(df, numbers, config.quantile_error)
    whole = {c for c in numbers if kinds[c].subtype is S.DISCRETE}
    bins = numeric.histograms(df, {c: stats[c] for c in numbers if kinds[c].regime is not R.TABLE}, whole, config.max_bins)
    out = {}
    for i, name in enumerate(df.columns):
        kind = kinds[name]
        n, missing = counted["n"], counted[f"m{i}"]
        p = ColumnProfile(name, kind, {"n": n, "n_missing": missing, "pct_missing": 100 * missing / n if n else None})
        if name in known:
            _fill(df, name, kind, p, config, stats.get(name, {}), bins.get(name, []), now)
        p.narrative = rephrased(narrate(p, config.language, config.narrative_tone), rephrase or config.narrative_llm)
        out[name] = p
    return DatasetProfile(counted["n"], out)


def curve(bins: list[dict]) -> list[dict]:
    """(value, at_most) of a distribution at the upper edges of its histogram."""
    total, below, out = sum(b["n"] for b in bins), 0, []
    for b in bins:
        below += b["n"]
        out.append({"value": b["high"], "at_most": below / total if total else None})
    return out


def timeline(df: DataFrame, c: str, unit: str, most: int = 5000) -> tuple[list[dict], str]:
    """(period, n) of all instants by `unit`, or by the next coarser one with at most so many periods."""
    units = ["day", "week", "month", "quarter", "year"]
    for now in units[units.index(unit) : -1]:
        got = rows(temporal.per_period(df, c, now).orderBy("period").limit(most + 1))
        if len(got) <= most:
            return got, now
    return rows(temporal.per_period(df, c, "year").orderBy("period")), "year"


def _fill(df: DataFrame, c: str, kind: VariableType, p: ColumnProfile, config: Config, s: dict, bins: list[dict], now: str | None) -> None:
    essential, complete = {}, {}
    chart = lambda name, data, reason: p.viz_suggestions.append(VizSuggestion(name, {"rows": data}, reason))
    if kind.var_class is C.IDENTIFIER:
        essential = one(freq.identifier(df, c))
    elif kind.subtype is S.BINARY:
        essential = {"levels": rows(freq.binary_table(df, c).orderBy(F.desc("n"), "level"))}
        complete = one(freq.balance(df, c))
        chart("proportion bar", essential["levels"], "two levels")
    elif kind.subtype is S.ORDINAL:
        essential = {"levels": rows(ordinal.table(df, c, kind.ordered_levels).orderBy("position"))} | one(ordinal.quartiles(df, c, kind.ordered_levels))
        chart("bars in natural order", essential["levels"], "ordered levels")
        chart("cumulative curve", essential["levels"], "cumulative shares follow the order")
        chart("diverging bars", essential["levels"], "levels on either side of the middle one")
    elif kind.subtype is S.NOMINAL and kind.regime is R.CATEGORICAL:
        essential = {"levels": rows(freq.table(df, c).orderBy("rank"))}
        complete = one(freq.shape(df, c, config.rare_level_pct))
        chart("ordered bars" if len(essential["levels"]) <= 15 else "lollipop", essential["levels"], f"{len(essential['levels'])} levels")
        if len(essential["levels"]) <= 4:
            chart("pie", essential["levels"], "at most 4 levels")
        if 2 < len(essential["levels"]) <= 10:
            p.notes.append("possible ordinal: declare the order of its levels if they have one")
    elif kind.subtype is S.NOMINAL and kind.regime is R.LONG_TAIL:
        shape = one(freq.shape(df, c, config.rare_level_pct))
        essential = {
            "k": shape["k"], "levels": rows(freq.top(df, c, config.long_tail_top_n).orderBy("position")),
            "concentration": rows(freq.concentration(df, c)), "singletons": one(freq.singletons(df, c)),
        }
        complete = shape | {"variants": rows(freq.variants(df, c).orderBy("key", F.desc("n")).limit(config.sample_size))}
        chart("Pareto", essential["levels"], "many levels with repetition")
        chart("bars with Others", essential["levels"], "the tail is one bar")
        chart("treemap", essential["levels"], "shares of the largest levels and of the rest")
    elif kind.subtype is S.NOMINAL:
        essential = one(text.form(df, c)) | {"samples": rows(text.extremes(df, c, config.sample_size))}
        complete = {
            "patterns": rows(text.patterns(df, c)), "dominant": one(text.dominant_pattern(df, c)),
            "masks": rows(text.masks(df, c, config.sample_size)), "cases": rows(text.cases(df, c)), "disguised": one(text.disguised(df, c)),
            "dirt": rows(text.dirt(df, c)),
        }
        complete["offenders"] = [
            {"check_name": r["check_name"], "value": o["value"]} for r in complete["dirt"] if r["n"] for o in rows(text.offenders(df, c, r["check_name"], config.sample_size))
        ]
        chart("length histogram", rows(text.lengths(df, c)), "nearly every string differs")
        chart("mask bars", complete["masks"], "formats side by side")
        chart("check panel", complete["dirt"], "checks of the strings side by side")
        if complete["disguised"]["castable"]:
            p.notes.append(f"{complete['disguised']['castable']} values could be numbers")
    elif kind.subtype is S.DISCRETE:
        essential = {k: s[k] for k in ("min", "max", "mean", "median", "n_valid")}
        complete = {k: s[k] for k in ("q1", "q3", "sd", "zeros", "negatives", "quantile_error")}
        if kind.regime is R.TABLE:
            essential["values"] = rows(numeric.table(df, c).orderBy(F.asc_nulls_last("value")))
            seen = [r for r in essential["values"] if r["value"] is not None]
            essential["mode"] = min(seen, key=lambda r: (-r["n"], r["value"]))["value"]
            complete["holes"] = rows(numeric.hole_ranges(df, c).orderBy("low").limit(config.sample_size))
            chart("bars by value", essential["values"], "few values")
            chart("cumulative distribution", [{"value": r["value"], "at_most": r["cumulative"]} for r in seen], "share of the rows up to each value")
        else:
            essential["extremes"] = rows(numeric.frequency_extremes(df, c, config.discrete_extremes_levels, config.discrete_extremes_include_middle))
            essential["mode"] = next((r["value"] for r in essential["extremes"] if r["end"] == "most" and r["position"] == 1), None)
            essential["histogram"] = bins
            chart("integer histogram", bins, "many values")
            chart("cumulative distribution", curve(bins), "share of the rows up to each value")
    elif kind.subtype is S.CONTINUOUS:
        essential = {k: s[k] for k in ("min", "q1", "median", "mean", "q3", "max")} | {
            "extremes": rows(numeric.value_extremes(df, c, config.continuous_extremes_levels))
        }
        complete = {
            k: s[k] for k in (
                "p1", "p5", "p95", "p99", "sd", "iqr", "cv", "skewness", "kurtosis", "quantile_error", "outliers", "outlier_share", "low_whisker",
                "high_whisker",
            )
        }
        chart("histogram", bins, "continuous values")
        chart("boxplot", [{k: s[k] for k in ("q1", "median", "q3", "low_whisker", "high_whisker", "outliers")}], "five numbers and fences")
        chart("cumulative distribution", curve(bins), "share of the rows up to each value")
        chart("density", numeric.density_of(s, bins, config.curve_points), "smoothed histogram")
        chart("quantile plot", numeric.normal_quantiles(s), "beside a normal distribution")
        if s["median"] and s["mean"] > config.log_scale_ratio * s["median"] > 0:
            p.notes.append("skewed to the right: consider a logarithmic scale")
    elif kind.subtype is S.INSTANT:
        src = df
        if isinstance(df.schema[c].dataType, T.StringType):
            fmt = temporal.dominant_format(df, c)
            src = df.select(parse(col(c), fmt and fmt["format"]).alias(c))
            p.quality |= {"date_format": fmt and fmt["format"], "date_format_share": fmt and fmt["share"]}
        essential = one(temporal.coverage(src, c)) | one(temporal.granularity(src, c))
        unit = essential["granularity"] if essential["granularity"] in ("year", "quarter", "month", "week", "day") else "day"
        complete = {
            "cycles": rows(temporal.cycles(src, c).orderBy("part", "value")),
            "gaps": rows(temporal.gaps(src, c, unit).orderBy("after").limit(config.sample_size)), "duplicates": temporal.duplicates(src, c).count(),
        }
        odd = one(temporal.bounds(src, c, now or F.current_timestamp().cast("timestamp_ntz"), config.oldest))
        complete |= {"future": odd["future"], "too_old": odd["too_old"]}
        if odd["future"]:
            p.notes.append(f"{odd['future']} instants lie in the future")
        if odd["too_old"]:
            p.notes.append(f"{odd['too_old']} instants lie before {config.oldest}")
        chart("cyclic bars", complete["cycles"], "months, quarters, weekdays and hours")
        chart("gap strip", complete["gaps"], "periods without rows")
        line, unit = timeline(src, c, unit)
        chart("timeline", line, f"records by {unit}")
        chart("hour by weekday heatmap", rows(temporal.week_grid(src, c)), "weekly rhythm")
        days = line if unit == "day" else rows(temporal.calendar(src, c).orderBy("day").limit(5001))
        if len(days) <= 5000:
            chart("calendar heatmap", days, "records by day")
    elif kind.subtype is S.DURATION:
        value, unit = smart_unit(s["median"] or 0.0)
        essential = {k: s[k] for k in ("median", "min", "q1", "mean", "q3", "max")} | {"median_in_unit": value, "unit": unit}
        complete = {k: s[k] for k in ("sd", "iqr", "outliers", "outlier_share", "quantile_error")} | {"n_negative": round(s["negatives"] * s["n_valid"])}
        chart("histogram", bins, "durations in seconds")
        chart("boxplot", [{k: s[k] for k in ("q1", "median", "q3", "low_whisker", "high_whisker", "outliers")}], "five numbers and fences")
    p.summary = {"essential": essential, "complete": complete}


def position(c: str, levels: list[str]) -> Column:
    """Where a level stands in the declared order; null for others."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in levels]), col(c).cast("string")), F.lit(0)).alias(c)


def describe_pair(
    df: DataFrame, a: str, b: str, kinds: dict[str, VariableType] | None = None, unit: str = "day", config: Config | None = None,
) -> dict[str, DataFrame]:
    """The analyses of two columns by their classes, as lazy DataFrames."""
    from descry.operators import pair

    kinds = kinds or schema_of(df.select(col(a).alias(a), col(b).alias(b)), config)[1]
    error = (config or Config()).quantile_error
    rank = {C.QUALITATIVE: 0, C.TEMPORAL: 1, C.QUANTITATIVE: 2}
    if any(kinds[x].var_class not in rank for x in (a, b)):
        raise ValueError("identifiers and unsupported columns have no pair analyses")
    is_duration = lambda x: kinds[x].subtype is S.DURATION
    group = lambda x: C.QUANTITATIVE if is_duration(x) else kinds[x].var_class
    (x, gx), (y, gy) = sorted(((a, group(a)), (b, group(b))), key=lambda t: rank[t[1]])
    if gx is gy is C.QUALITATIVE:
        out = {"contingency": pair.contingency(df, a, b), "chi_square": pair.chi_square(df, a, b)}
        if kinds[a].ordered_levels and kinds[b].ordered_levels:  # both have an order: their positions are ranks
            placed = df.select(position(a, kinds[a].ordered_levels), position(b, kinds[b].ordered_levels))
            out |= {"kendall": pair.kendall(placed, a, b), "spearman": pair.spearman(placed, a, b)}
        return out
    if gx is C.QUALITATIVE and gy is C.QUANTITATIVE:
        return {
            "group_stats": pair.group_stats(df, x, y, error), "group_boxes": pair.group_boxes(df, x, y, error),
            "group_densities": pair.group_densities(df, x, y),
        }
    if gx is C.QUALITATIVE:
        return {"period_by_category": pair.period_by_category(df, y, x, unit)}
    if gx is C.TEMPORAL and gy is C.QUANTITATIVE:
        return {"period_metric": pair.period_metric(df, x, y, unit, error)}
    if gx is C.QUANTITATIVE:
        return {
            "correlation": pair.correlation(df, a, b), "spearman": pair.spearman(df, a, b), "trend": pair.trend(df, a, b),
            "grid": pair.grid(df, a, b), "sample": pair.sample(df, [a, b]),
        }
    raise ValueError("two instants have no pair analysis; profile their difference as a duration")
