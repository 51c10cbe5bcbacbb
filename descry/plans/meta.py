"""Metadata of all columns from one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descry.config import Config
from descry.functions.dates import parse
from descry.functions.values import batch_only, clean, col, instant, numeric

#: Fixed value: the mask of a postal code.
CODE = r"^[0-9]{5}-?[0-9]{3}$"
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def column_metadata(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(column, dtype, n, n_valid, k, all_integer), all columns in one job; k without nulls, exact or by a sketch (2 % error)."""
    batch_only(df)
    columns = columns or df.columns
    rows, aggs = [], [F.count("*").alias("n")]
    for i, name in enumerate(columns):
        kind = df.schema[name].dataType
        if isinstance(kind, NESTED) or kind.typeName() == "variant":
            distinct, integer = F.lit(None).cast("long"), F.lit(None).cast("boolean")
        else:
            c = clean(df, name)
            distinct = F.count_distinct(c) if exact else F.approx_count_distinct(c, 0.02)
            integer = F.bool_and(c == F.floor(c)) if numeric(kind) else F.lit(None).cast("boolean")
        valid = F.count(col(name)) if isinstance(kind, NESTED) else F.count(clean(df, name))
        aggs += [valid.alias(f"v{i}"), distinct.alias(f"k{i}"), integer.alias(f"w{i}")]
        rows.append(f"{_quoted(name)}, {_quoted(kind.simpleString())}, `v{i}`, `k{i}`, `w{i}`")
    wide = df.agg(*aggs)
    tall = wide.selectExpr("n", f"stack({len(rows)}, {', '.join(rows)}) as (column, dtype, n_valid, k, all_integer)")
    return tall.select("column", "dtype", "n", "n_valid", "k", "all_integer")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sampled(df: DataFrame, config: Config) -> DataFrame:
    """The rows that decide the routes: all, or so many by a hash of their values."""
    return df if config.inference_sample_size is None else by_hash(df, config.inference_sample_size)


def by_hash(df: DataFrame, n: int) -> DataFrame:
    """The n rows of the smallest hashes, wherever they stand in the table."""
    flat = [col(f.name) for f in df.schema.fields if not isinstance(f.dataType, NESTED) and f.dataType.typeName() != "variant"]
    return df.orderBy(F.xxhash64(F.lit(17), *flat)).limit(n) if flat else df.limit(n)


def near_a_threshold(m: dict, config: Config) -> bool:
    """Whether a sketched number of distinct values (2 % error; 10 % are allowed for) leaves the route open."""
    k, n = m["n_distinct"], m["n_valid"]
    if k is None or not n:
        return False
    if k <= 1.1 * max(config.max_categorical_levels, config.max_discrete_levels) + 5:
        return True
    if m["dtype"] == "string":
        return abs(k / n - config.textual_unique_ratio) < 0.1 * config.textual_unique_ratio
    return bool(m["all_integer"]) and k > 0.9 * n


def collect_metadata(df: DataFrame, config: Config | None = None) -> dict[str, dict]:
    """{column: {dtype, n, n_valid, n_distinct, all_integer, parse_date_rate, parsed}} for the router.

    Numbers of distinct values are sketched first, and counted exactly among the rows of `sampled` where a route could hang on them.
    """
    config = config or Config()
    part = sampled(df, config)
    out = {
        r["column"]: {
            "dtype": r.dtype, "n": r.n, "n_valid": r.n_valid, "n_distinct": r.k, "all_integer": r.all_integer, "parse_date_rate": None,
        } for r in column_metadata(part, exact=False).collect()
    }
    close = [c for c, m in out.items() if near_a_threshold(m, config)]
    if close:
        exact = part.agg(*[F.count_distinct(clean(df, c)).alias(f"k{i}") for i, c in enumerate(close)]).first()
        for i, c in enumerate(close):
            out[c]["n_distinct"] = exact[f"k{i}"]
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if strings:
        tried = None
        for i, c in enumerate(strings):  # of each column, so many values that aren't null
            some = by_hash(part.where(col(c).isNotNull()), config.date_parse_rows).select(F.lit(i).alias("i"), col(c).alias("v"))
            tried = some if tried is None else tried.unionByName(some)
        seen = {
            r["i"]: r for r in tried.groupBy("i").agg(
                F.count("*").alias("n"), F.count(parse(F.col("v"))).alias("dates"), F.count_if(F.col("v").rlike(CODE)).alias("codes"),
            ).collect()
        }
        for i, c in enumerate(strings):
            n, dates, codes = (seen[i]["n"], seen[i]["dates"], seen[i]["codes"]) if i in seen else (0, 0, 0)
            out[c] |= {"parse_date_rate": dates / n if n else 0.0, "parse_date_n": n, "code_rate": codes / n if n else 0.0}
    numbers = [f.name for f in df.schema.fields if numeric(f.dataType)]
    if numbers:
        ends = part.agg(
            *[e for i, c in enumerate(numbers) for e in (F.min(clean(df, c)).cast("double").alias(f"a{i}"), F.max(clean(df, c)).cast("double").alias(f"b{i}"))]
        ).first()
        for i, c in enumerate(numbers):
            out[c] |= {"min": ends[f"a{i}"], "max": ends[f"b{i}"]}
    for f in df.schema.fields:
        out[f.name]["instant"] = instant(f.dataType)
    return out
