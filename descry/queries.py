"""The profile operators as queries over the driver's tables, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.config import Config
from descry.operators import freq, numeric, ordinal, pair, temporal, text
from descry.plans import meta
from descry.plans.describe import describe, schema_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Routes are decided over all rows.
WHOLE = Config(inference_sample_size=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, source: str, op: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """Register op over a table; {t} in the SQL stands for the table."""
    QUERIES[name] = lambda spark, sf_dir: op(table(spark, sf_dir, source))
    if sql:
        ORACLE_SQL[name] = sql.replace("{t}", source)


def counted(column: str) -> str:
    return f"SELECT CAST({column} AS VARCHAR) AS level, count(*) AS n FROM {{t}} WHERE {column} IS NOT NULL GROUP BY 1"


# metadata and routes
META = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
NUMERIC = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double"}
add("column_metadata", "orders", lambda d: meta.column_metadata(d, META), " UNION ALL ".join(
    f"SELECT '{c}' AS column, '{NUMERIC.get(c, 'timestamp_ntz' if c == 'o_orderdate' else 'string')}' AS dtype, count(*) AS n, count({c}) AS n_valid, count(DISTINCT {c}) AS k, " + (f"bool_and({c} = floor({c}))" if c in NUMERIC else "CAST(NULL AS BOOLEAN)") + " AS all_integer FROM {t}" for c in META))


def route_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name in ("part", "customer"):
        rows += [(name, c, k.route) for c, k in schema_of(table(spark, sf_dir, name), WHOLE)[1].items()]
    return spark.createDataFrame(rows, "tbl string, column string, route string")


def route_sql(tbl: str, column: str, is_number: bool) -> str:
    stats = f"(SELECT count({column}) AS v, count(DISTINCT {column}) AS k, " + (
        f"bool_and({column} = floor({column}))" if is_number else "false"
    ) + f" AS w FROM {tbl})"
    if is_number:
        case = "CASE WHEN k = 2 THEN 'binary' WHEN k = v AND v > 50 AND w THEN 'identifier' WHEN w AND k <= 30 THEN 'discrete[table]' WHEN w THEN 'discrete[histogram]' ELSE 'continuous' END"
    else:
        case = "CASE WHEN k = 2 THEN 'binary' WHEN k > 0.5 * v THEN 'nominal[textual]' WHEN k <= 30 THEN 'nominal[categorical]' ELSE 'nominal[long_tail]' END"
    return f"SELECT '{tbl}' AS tbl, '{column}' AS column, {case} AS route FROM {stats}"


QUERIES["route_columns"] = route_columns
ORACLE_SQL["route_columns"] = " UNION ALL ".join(
    [route_sql("part", c, c in ("p_partkey", "p_size", "p_retailprice")) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")] + [
        route_sql("customer", c, c in ("c_custkey", "c_nationkey", "c_acctbal")) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    ]
)

# binary
BINARY = """WITH c AS (SELECT CAST({c} AS VARCHAR) AS level, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1
  UNION ALL SELECT '(missing)', count(*) FILTER (WHERE {c} IS NULL) FROM {t})
SELECT level, n, n / CAST(sum(n) OVER () AS DOUBLE) AS of_total, CASE WHEN level <> '(missing)' THEN n / CAST(sum(CASE WHEN level <> '(missing)' THEN n ELSE 0 END) OVER () AS DOUBLE) END AS of_valid FROM c"""
add("binary_table", "lineitem", lambda d: freq.binary_table(d, "l_linestatus"), BINARY.replace("{c}", "l_linestatus"))
add("binary_table_labels", "labels", lambda d: freq.binary_table(d, "quality"), BINARY.replace("{c}", "quality"))
add(
    "binary_balance",
    "lineitem",
    lambda d: freq.balance(d, "l_linestatus"),
    f"WITH c AS ({counted('l_linestatus')}) SELECT (SELECT level FROM c ORDER BY n DESC, level LIMIT 1) AS dominant, max(n) / CAST(min(n) AS "
    f"DOUBLE) AS ratio FROM c",
)

# nominal
FREQ = (
    "WITH c AS ({counted}) SELECT level, n, n / CAST(sum(n) OVER () AS DOUBLE) AS share, sum(n) OVER (ORDER BY n DESC, level ROWS UNBOUNDED "
    "PRECEDING) / CAST(sum(n) OVER () AS DOUBLE) AS cumulative, row_number() OVER (ORDER BY n DESC, level) AS rank FROM c"
)
for _name, _t, _c in (("nominal_freq", "customer", "c_mktsegment"), ("nominal_freq_lang", "documents", "lang")):
    add(_name, _t, lambda d, c=_c: freq.table(d, c), FREQ.replace("{counted}", counted(_c)))
SHAPE = """WITH c AS ({counted}), p AS (SELECT level, n, n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM c)
SELECT count(*) AS k, (SELECT level FROM c ORDER BY n DESC, level LIMIT 1) AS mode, max(p) AS mode_share, max(n) / CAST(min(n) AS DOUBLE) AS imbalance,
  CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) END AS entropy, sum(p * p) AS herfindahl, count(*) FILTER (WHERE p * 100 < 1.0) AS rare_levels FROM p"""
add("nominal_shape", "orders", lambda d: freq.shape(d, "o_orderstatus"), SHAPE.replace("{counted}", counted("o_orderstatus")))
add("nominal_shape_brand", "part", lambda d: freq.shape(d, "p_brand"), SHAPE.replace("{counted}", counted("p_brand")))
add("value_counts", "events", lambda d: freq.counts_with_missing(d, "event_type"), "SELECT event_type AS level, count(*) AS n FROM {t} GROUP BY 1")
add("value_counts_top", "events", lambda d: freq.counts(d, "props", 7), f"{counted('props')} ORDER BY n DESC, level LIMIT 7")
add(
    "most_common_where",
    "events",
    lambda d: freq.most_common(d, "event_type", "value > 50"),
    "SELECT event_type AS level, count(*) AS n FROM {t} WHERE value > 50 AND event_type IS NOT NULL GROUP BY 1",
)
TOP = """WITH c AS ({counted}), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, level) AS position FROM c),
 x AS (SELECT position, level, n, CAST(1 AS BIGINT) AS levels FROM r WHERE position <= 10
  UNION ALL SELECT CAST(11 AS BIGINT), 'Others', CAST(sum(n) AS BIGINT), count(*) FROM r WHERE position > 10 HAVING count(*) > 0)
SELECT position, level, n, levels, n / CAST(sum(n) OVER () AS DOUBLE) AS share FROM x"""
CONC = """WITH c AS ({counted}), r AS (SELECT n, sum(n) OVER (ORDER BY n DESC, level ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS total FROM c)
SELECT CAST(p AS BIGINT) AS percent, least(count(*) FILTER (WHERE cum * 100 <= p * total) + 1, count(*)) AS levels FROM r, (VALUES (50), (80), (95)) AS q(p) GROUP BY p"""
SINGLE = (
    "WITH c AS ({counted}) SELECT count(*) FILTER (WHERE n = 1) AS singletons, count(*) AS k, count(*) FILTER (WHERE n = 1) / CAST(count(*) AS "
    "DOUBLE) AS share FROM c"
)
for _t, _c in (("part", "p_name"), ("events", "props")):
    add(f"long_tail_top_{_t}", _t, lambda d, c=_c: freq.top(d, c), TOP.replace("{counted}", counted(_c)))
    add(f"long_tail_concentration_{_t}", _t, lambda d, c=_c: freq.concentration(d, c), CONC.replace("{counted}", counted(_c)))
add(
    "singletons",
    "orders",
    lambda d: freq.singletons(d, "o_totalprice"),
    SINGLE.replace("{counted}", "SELECT o_totalprice AS level, count(*) AS n FROM {t} GROUP BY 1"),
)
DIRTY = (
    "CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) WHEN p_partkey % 5 = 1 THEN ' ' || replace(p_name, ' ', '  ') WHEN p_partkey % 5 = 2 THEN "
    "replace(p_name, 'e', 'é') ELSE p_name END"
)
add("spelling_variants", "part", lambda d: freq.variants(d.select(F.expr(DIRTY).alias("name")), "name"),
    f"WITH c AS (SELECT {DIRTY} AS level, count(*) AS n FROM {{t}} GROUP BY 1), k AS (SELECT trim(regexp_replace(strip_accents(lower(level)), '\\s+', ' ', 'g')) AS key, level, n FROM c), m AS (SELECT *, count(*) OVER (PARTITION BY key) AS members FROM k) SELECT key, level, n, members FROM m WHERE members > 1")
add(
    "identifier_check",
    "orders",
    lambda d: freq.identifier(d, "o_orderkey"),
    "WITH c AS (SELECT o_orderkey, count(*) AS n FROM {t} WHERE o_orderkey IS NOT NULL GROUP BY 1) SELECT (SELECT count(*) FROM {t}) AS n, "
    "CAST(sum(n) AS BIGINT) AS n_valid, count(*) AS k, CAST(sum(n) - count(*) AS BIGINT) AS collisions, count(*) FILTER (WHERE n > 1) AS "
    "repeated_values, sum(n) = count(*) AS is_unique FROM c",
)
add(
    "identifier_collisions",
    "lineitem",
    lambda d: freq.identifier(d, "l_orderkey"),
    ORACLE_SQL["identifier_check"].replace("o_orderkey", "l_orderkey").replace("FROM orders", "FROM lineitem"),
)
add(
    "distinct_ratio",
    "events",
    lambda d: d.agg(
        F.count("user_id").alias("n_valid"), F.count_distinct("user_id").alias("k"),
        F.round(F.count_distinct("user_id") / F.count("user_id"), 4).alias("ratio"),
    ),
    "SELECT count(user_id) AS n_valid, count(DISTINCT user_id) AS k, round(count(DISTINCT user_id) / CAST(count(user_id) AS DOUBLE), 4) AS ratio "
    "FROM {t}",
)

# ordinal
ORD = (
    "WITH c AS (SELECT o_orderpriority AS level, count(*) AS n FROM {t} GROUP BY 1), o AS (SELECT level, n, row_number() OVER (ORDER BY "
    "CAST(regexp_extract(level, '^\\s*([0-9]+)', 1) AS BIGINT), level) AS position FROM c), x AS (SELECT *, sum(n) OVER (ORDER BY position ROWS "
    "UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS total FROM o) "
)
add(
    "ordinal_table",
    "orders",
    lambda d: ordinal.table(d, "o_orderpriority"),
    ORD + "SELECT position, level, n, n / CAST(total AS DOUBLE) AS share, cum / CAST(total AS DOUBLE) AS cumulative FROM x",
)
add(
    "ordinal_quartiles",
    "orders",
    lambda d: ordinal.quartiles(d, "o_orderpriority"),
    ORD
    + (
        "SELECT min_by(level, position) FILTER (WHERE cum * 100 >= total * 25) AS q1, min_by(level, position) FILTER (WHERE cum * 100 >= total * 50) "
        "AS median, min_by(level, position) FILTER (WHERE cum * 100 >= total * 75) AS q3, (SELECT level FROM o ORDER BY n DESC, position LIMIT 1) AS "
        "mode FROM x"
    ),
)
SEGMENTS = ["MACHINERY", "FURNITURE", "HOUSEHOLD", "BUILDING", "AUTOMOBILE", "NONE"]
add(
    "ordinal_declared",
    "customer",
    lambda d: ordinal.table(d, "c_mktsegment", SEGMENTS),
    "WITH d AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{s}', {i})" for i, s in enumerate(SEGMENTS))
    + (
        ") AS v(level, p)), c AS (SELECT c_mktsegment AS level, count(*) AS n FROM {t} GROUP BY 1), o AS (SELECT coalesce(c.level, d.level) AS "
        "level, coalesce(n, 0) AS n, row_number() OVER (ORDER BY p NULLS LAST, coalesce(c.level, d.level)) AS position FROM d FULL JOIN c ON c.level "
        "= d.level) SELECT position, level, n, n / CAST(sum(n) OVER () AS DOUBLE) AS share, sum(n) OVER (ORDER BY position ROWS UNBOUNDED PRECEDING) "
        "/ CAST(sum(n) OVER () AS DOUBLE) AS cumulative FROM o"
    ),
)

# discrete and continuous
DTABLE = (
    "WITH c AS (SELECT CAST({c} AS DOUBLE) AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 UNION ALL SELECT NULL, count(*) "
    "FILTER (WHERE {c} IS NULL) FROM {t}) SELECT value, n, n / CAST(sum(n) OVER () AS DOUBLE) AS share, CASE WHEN value IS NOT NULL THEN sum(n) "
    "OVER (ORDER BY value NULLS LAST ROWS UNBOUNDED PRECEDING) / CAST(sum(CASE WHEN value IS NOT NULL THEN n END) OVER () AS DOUBLE) END AS "
    "cumulative FROM c"
)
add("discrete_table", "lineitem", lambda d: numeric.table(d, "l_linenumber"), DTABLE.replace("{c}", "l_linenumber"))
add("discrete_table_label", "embeddings", lambda d: numeric.table(d, "label"), DTABLE.replace("{c}", "label"))
add(
    "discrete_holes",
    "part",
    lambda d: numeric.holes(d.where("p_size % 7 <> 3"), "p_size"),
    "WITH v AS (SELECT DISTINCT p_size FROM {t} WHERE p_size % 7 <> 3) SELECT CAST(g AS BIGINT) AS value FROM range((SELECT min(p_size) FROM v), "
    "(SELECT max(p_size) + 1 FROM v)) AS r(g) WHERE g NOT IN (SELECT p_size FROM v)",
)
SUMMARY = """WITH s AS (SELECT count(*) AS n, count(x) AS n_valid, min(x) AS min, max(x) AS max, avg(x) AS mean, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3,
 quantile_cont(x, 0.01) AS p1, quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99, stddev_samp(x) AS sd, skewness(x) AS skewness, kurtosis(x) AS kurtosis,
 count(*) FILTER (WHERE x = 0) / CAST(count(x) AS DOUBLE) AS zeros, count(*) FILTER (WHERE x < 0) / CAST(count(x) AS DOUBLE) AS negatives FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {t}))
SELECT n, n_valid, n - n_valid AS n_missing, min, max, mean, q1, median, q3, p1, p5, p95, p99, sd, skewness, kurtosis, zeros, negatives, q3 - q1 AS iqr, sd / nullif(mean, 0) AS cv, CAST(0 AS DOUBLE) AS quantile_error FROM s"""
for _name, _t, _c in (
    ("discrete_summary", "lineitem", "l_quantity"), ("discrete_summary_size", "part", "p_size"), ("discrete_summary_chars", "documents", "n_chars"),
    ("continuous_summary_price", "orders", "o_totalprice"), ("continuous_summary_balance", "customer", "c_acctbal"),
    ("continuous_summary_value", "events", "value"),
):
    add(_name, _t, lambda d, c=_c: numeric.summary(d, c), SUMMARY.replace("{c}", _c))
add(
    "continuous_five",
    "orders",
    lambda d: numeric.five_numbers(d, "o_totalprice"),
    "SELECT min(o_totalprice) AS min, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, avg(o_totalprice) AS "
    "mean, quantile_cont(o_totalprice, 0.75) AS q3, max(o_totalprice) AS max FROM {t}",
)
FEXT = (
    "WITH v AS (SELECT CAST({c} AS DOUBLE) AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1), m AS (SELECT 'most' AS end_, value, "
    "n, row_number() OVER (ORDER BY n DESC, value) AS position FROM v UNION ALL SELECT 'least', value, n, row_number() OVER (ORDER BY n, "
    "abs(value) DESC, value DESC) FROM v) SELECT end_ AS \"end\", position, value, n FROM m WHERE position <= 5"
)
add("discrete_extremes", "lineitem", lambda d: numeric.frequency_extremes(d, "l_quantity"), FEXT.replace("{c}", "l_quantity"))
add("discrete_extremes_chars", "documents", lambda d: numeric.frequency_extremes(d, "n_chars"), FEXT.replace("{c}", "n_chars"))
VEXT = (
    "WITH v AS (SELECT CAST({c} AS DOUBLE) AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1), m AS (SELECT 'smallest' AS end_, "
    "value, n, row_number() OVER (ORDER BY value) AS position FROM v UNION ALL SELECT 'largest', value, n, row_number() OVER (ORDER BY value DESC) "
    "FROM v) SELECT end_ AS \"end\", position, value, n FROM m WHERE position <= 5"
)
add("continuous_extremes", "events", lambda d: numeric.value_extremes(d, "value"), VEXT.replace("{c}", "value"))
HIST = (
    "WITH s AS (SELECT CAST({c} AS DOUBLE) AS x FROM {t} WHERE {c} IS NOT NULL), b AS (SELECT min(x) AS lo, max(x) AS hi FROM s), w AS (SELECT lo, "
    "{width} AS width, {bins} AS bins FROM b), g AS (SELECT least(floor((x - lo) / width), bins - 1) AS bin, count(*) AS n FROM s, w GROUP BY 1) "
    "SELECT CAST(i AS BIGINT) AS bin, lo + i * width AS low, lo + (i + 1) * width AS high, coalesce(n, 0) AS n FROM w, LATERAL (SELECT "
    "unnest(generate_series(0, CAST(bins - 1 AS BIGINT))) AS i) LEFT JOIN g ON g.bin = i"
)
add(
    "histogram",
    "lineitem",
    lambda d: numeric.histogram(d, "l_extendedprice", 20),
    HIST.replace("{c}", "l_extendedprice").replace("{width}", "(hi - lo) / 20").replace("{bins}", "20"),
)
add(
    "discrete_hist",
    "documents",
    lambda d: numeric.histogram(d, "n_chars", 12, whole=True),
    HIST.replace("{c}", "n_chars").replace("{width}", "greatest(1, ceil((hi - lo + 1) / 12))").replace(
        "{bins}", "ceil((hi - lo + 1) / greatest(1, ceil((hi - lo + 1) / 12)))",
    ),
)
add(
    "ecdf",
    "part",
    lambda d: numeric.ecdf(d, "p_size"),
    "WITH v AS (SELECT CAST(p_size AS DOUBLE) AS value, count(*) AS n FROM {t} GROUP BY 1) SELECT value, n, sum(n) OVER (ORDER BY value ROWS "
    "UNBOUNDED PRECEDING) / CAST(sum(n) OVER () AS DOUBLE) AS at_most FROM v",
)
FENCE = (
    "WITH q AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3 FROM {t}), f AS (SELECT "
    "*, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q) "
)
add(
    "outliers_iqr",
    "lineitem",
    lambda d: numeric.outliers(d, "l_extendedprice"),
    FENCE.replace("{c}", "l_extendedprice")
    + (
        "SELECT lo AS low_fence, hi AS high_fence, count(*) FILTER (WHERE l_extendedprice < lo OR l_extendedprice > hi) AS outliers, count(*) FILTER "
        "(WHERE l_extendedprice < lo OR l_extendedprice > hi) / CAST(count(*) AS DOUBLE) AS share, min(l_extendedprice) FILTER (WHERE "
        "l_extendedprice >= lo AND l_extendedprice <= hi) AS low_whisker, max(l_extendedprice) FILTER (WHERE l_extendedprice >= lo AND "
        "l_extendedprice <= hi) AS high_whisker FROM {t}, f GROUP BY lo, hi"
    ),
)
add(
    "boxplot",
    "events",
    lambda d: numeric.boxplot(d, "value"),
    FENCE.replace("{c}", "value")
    + (
        "SELECT q1, median, q3, min(value) FILTER (WHERE value >= lo AND value <= hi) AS low_whisker, max(value) FILTER (WHERE value >= lo AND value "
        "<= hi) AS high_whisker, count(*) FILTER (WHERE value < lo OR value > hi) AS outliers FROM {t}, f GROUP BY q1, median, q3"
    ),
)
DENSITY = """
    WITH s AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM {t}),
    h AS (SELECT *, 0.9 * least(sd, CASE WHEN iqr = 0 THEN sd ELSE iqr / 1.34 END) * pow(n, -0.2) AS h FROM s),
    b AS (SELECT least(floor((value - lo) / ((hi - lo) / 200)), 199) AS bin, count(*) AS k FROM {t}, s WHERE value IS NOT NULL GROUP BY 1),
    m AS (SELECT lo + (bin + 0.5) * ((hi - lo) / 200) AS m, k FROM b, s),
    g AS (SELECT lo - 3 * h + i * ((hi - lo + 6 * h) / 99) AS x FROM h, range(100) AS r(i))
    SELECT x, sum(k * exp(-((x - m) / h) * ((x - m) / h) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density FROM g, m, h GROUP BY x
"""
add("density", "events", lambda d: numeric.density(d, "value"), DENSITY)


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


add("quantile_plot", "orders", lambda d: numeric.qq(d, "o_totalprice"), " UNION ALL ".join(
    f"SELECT CAST({i / 100!r} AS DOUBLE) AS p, avg(o_totalprice) + stddev_samp(o_totalprice) * CAST({normal_quantile(i / 100)!r} AS DOUBLE) AS theoretical, quantile_cont(o_totalprice, {i / 100!r}) AS observed FROM {{t}}" for i in range(1, 100)))
add("approximate_summary", "lineitem", lambda d: numeric.summary(d, "l_extendedprice", 0.01))


def approximate_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each quantile of a sketch has a rank within the stated error."""
    lines = table(spark, sf_dir, "lineitem")
    s = numeric.summary(lines, "l_extendedprice", 0.01).first()
    x = F.col("l_extendedprice")
    ends = lines.agg(
        *[
            e for name in numeric.QUANTILES for e in (
                F.avg((x < s[name]).cast("double")).alias(f"{name} below"), F.avg((x <= s[name]).cast("double")).alias(f"{name} upto"),
            )
        ]
    ).first()
    rows = [(name, q, bool(ends[f"{name} below"] <= q + 0.01 and ends[f"{name} upto"] >= q - 0.01)) for name, q in numeric.QUANTILES.items()]
    return spark.createDataFrame(rows, "quantile string, p double, within boolean")


QUERIES["approximate_ranks"] = approximate_ranks
ORACLE_SQL["approximate_ranks"] = " UNION ALL ".join(f"SELECT '{name}' AS quantile, CAST({q} AS DOUBLE) AS p, true AS within" for name, q in numeric.QUANTILES.items())

# instants and durations
add(
    "instant_coverage",
    "events",
    lambda d: temporal.coverage(d, "ts"),
    "SELECT count(*) AS n, count(ts) AS n_valid, count(DISTINCT ts) AS k, CAST(min(ts) AS TIMESTAMP) AS first, CAST(max(ts) AS TIMESTAMP) AS last, "
    "date_diff('microsecond', min(ts), max(ts)) / 86400000000.0 AS days FROM {t}",
)
GRAN = "SELECT CASE " + " ".join(
    f"WHEN bool_and({{c}} = date_trunc('{u}', {{c}})) THEN '{u}'" for u in ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
) + " WHEN count({c}) > 0 THEN 'subsecond' END AS granularity FROM {t}"
add("instant_granularity", "orders", lambda d: temporal.granularity(d, "o_orderdate"), GRAN.replace("{c}", "o_orderdate"))
add("instant_granularity_events", "events", lambda d: temporal.granularity(d, "ts"), GRAN.replace("{c}", "ts"))
add(
    "instant_per_period",
    "events",
    lambda d: temporal.per_period(d, "ts", "hour"),
    "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS period, count(*) AS n FROM {t} GROUP BY 1",
)
add(
    "discrete_hole_ranges",
    "part",
    lambda d: numeric.hole_ranges(d.where("p_size % 7 > 2"), "p_size"),
    "WITH v AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS v FROM {t} WHERE p_size % 7 > 2), g AS (SELECT v, lead(v) OVER (ORDER BY v) AS w FROM v) "
    "SELECT v + 1 AS low, w - 1 AS high, w - v - 1 AS n FROM g WHERE w > v + 1",
)
add(
    "instant_gaps",
    "orders",
    lambda d: temporal.gaps(d.where("month(o_orderdate) <> 3"), "o_orderdate", "day"),
    "WITH p AS (SELECT DISTINCT date_trunc('day', o_orderdate) AS p FROM {t} WHERE month(o_orderdate) <> 3), g AS (SELECT p, lead(p) OVER (ORDER "
    "BY p) AS q FROM p) SELECT CAST(p AS TIMESTAMP) AS after, CAST(q AS TIMESTAMP) AS before, date_diff('day', p, q) - 1 AS empty FROM g WHERE "
    "date_diff('day', p, q) > 1",
)
add(
    "instant_dups",
    "lineitem",
    lambda d: temporal.duplicates(d, "l_shipdate"),
    "SELECT CAST(l_shipdate AS TIMESTAMP) AS instant, count(*) AS n FROM {t} GROUP BY 1 HAVING count(*) > 1",
)
add(
    "instant_cycles",
    "events",
    lambda d: temporal.cycles(d, "ts"),
    "WITH c AS ("
    + " UNION ALL ".join(f"SELECT '{p}' AS part, CAST({e} AS BIGINT) AS value, count(*) AS n FROM {{t}} GROUP BY 2" for p, e in (("month", "month(ts)"), ("quarter", "quarter(ts)"), ("weekday", "isodow(ts)"), ("hour", "hour(ts)")))
    + ") SELECT part, value, n, n / CAST(sum(n) OVER (PARTITION BY part) AS DOUBLE) AS share FROM c",
)
add(
    "instant_bounds",
    "orders",
    lambda d: temporal.bounds(d, "o_orderdate", "1997-06-01", "1993-01-01"),
    "SELECT count(o_orderdate) AS n_valid, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1997-06-01') AS future, count(*) FILTER (WHERE "
    "o_orderdate < TIMESTAMP '1993-01-01') AS too_old FROM {t}",
)
add(
    "instant_calendar",
    "orders",
    lambda d: temporal.calendar(d, "o_orderdate"),
    "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM {t} GROUP BY 1",
)
add(
    "instant_week_grid",
    "events",
    lambda d: temporal.week_grid(d, "ts"),
    "SELECT isodow(ts) AS weekday, hour(ts) AS hour, count(*) AS n FROM {t} GROUP BY 1, 2",
)


def duration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").join(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"),
    )
    return temporal.duration_summary(temporal.durations(both, "o_orderdate", "l_shipdate"), "seconds")


QUERIES["duration_summary"] = duration_summary
_DUR = "(SELECT date_diff('microsecond', o_orderdate, l_shipdate) / 1000000.0 AS seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
ORACLE_SQL["duration_summary"] = SUMMARY.replace("{c}", "seconds").replace("{t}", _DUR).replace(
    "CAST(0 AS DOUBLE) AS quantile_error FROM s",
    f"CAST(0 AS DOUBLE) AS quantile_error, (SELECT count(*) FILTER (WHERE seconds < 0) FROM {_DUR}) AS n_negative FROM s",
)

# text
add(
    "text_form",
    "documents",
    lambda d: text.form(d, "text"),
    "WITH s AS (SELECT CAST(length(text) AS DOUBLE) AS c, CAST(len(regexp_extract_all(text, '\\S+')) AS DOUBLE) AS t FROM {t}) SELECT count(c) AS "
    "n_valid, min(c) AS min_length, quantile_cont(c, 0.5) AS median_length, avg(c) AS mean_length, max(c) AS max_length, min(t) AS min_tokens, "
    "quantile_cont(t, 0.5) AS median_tokens, max(t) AS max_tokens FROM s",
)
add(
    "text_tokens",
    "documents",
    lambda d: text.tokens(d, "text"),
    "SELECT len(regexp_extract_all(text, '\\S+')) AS tokens, count(*) AS n FROM {t} WHERE text IS NOT NULL GROUP BY 1",
)
add(
    "text_lengths",
    "conversations",
    lambda d: text.lengths(d, "text", 10),
    HIST.replace("{c}", "length(text)").replace("{width}", "greatest(1, ceil((hi - lo + 1) / 10))").replace(
        "{bins}", "ceil((hi - lo + 1) / greatest(1, ceil((hi - lo + 1) / 10)))",
    ),
)
add(
    "text_shortest_longest",
    "documents",
    lambda d: text.extremes(d, "text"),
    "WITH v AS (SELECT DISTINCT text AS value, length(text) AS length FROM {t}), r AS (SELECT *, row_number() OVER (ORDER BY length, value) AS a, "
    "row_number() OVER (ORDER BY length DESC, value) AS b FROM v) SELECT 'shortest' AS \"end\", value, length FROM r WHERE a <= 10 UNION ALL "
    "SELECT 'longest', value, length FROM r WHERE b <= 10",
)


def sql_rule(rule: str) -> str:
    return rule.replace("(?s)", "").replace("'", "''")


from descry.functions import strings  # noqa: E402

add(
    "text_pattern",
    "pages",
    lambda d: text.patterns(d, "url"),
    " UNION ALL ".join(f"SELECT '{p}' AS pattern, count(*) FILTER (WHERE regexp_matches(trim(url), '{sql_rule(r)}')) AS n, count(*) FILTER (WHERE regexp_matches(trim(url), '{sql_rule(r)}')) / CAST(count(url) AS DOUBLE) AS share FROM {{t}}" for p, r in strings.PATTERNS.items()),
)
add(
    "text_dominant_pattern",
    "pages",
    lambda d: text.dominant_pattern(d, "url"),
    f"WITH p AS ({ORACLE_SQL['text_pattern']}) SELECT pattern, n, share FROM p ORDER BY n DESC, pattern LIMIT 1",
)
add(
    "text_violations",
    "part",
    lambda d: text.violations(d.select(F.expr("CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'https://x.org/' || p_partkey END").alias("v")), "v", "url"),
    "SELECT DISTINCT p_name AS value FROM {t} WHERE p_partkey % 3 = 0 ORDER BY value LIMIT 10",
)
add(
    "text_mask",
    "customer",
    lambda d: text.masks(d, "c_name"),
    "SELECT regexp_replace(regexp_replace(regexp_replace(c_name, '\\p{Lu}', 'A', 'g'), '\\p{Ll}', 'a', 'g'), '\\p{Nd}', '9', 'g') AS mask, "
    "count(*) AS n FROM {t} GROUP BY 1",
)
add(
    "text_case",
    "part",
    lambda d: text.cases(
        d.select(F.expr("CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN initcap(p_name) WHEN 2 THEN '12 ' ELSE p_name END").alias("v")),
        "v",
    ),
    "WITH c AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'upper' WHEN p_partkey % 4 = 1 THEN 'title' WHEN p_partkey % 4 = 2 THEN 'none' ELSE "
    "'lower' END AS style, count(*) AS n FROM {t} GROUP BY 1) SELECT style, n, n / CAST(sum(n) OVER () AS DOUBLE) AS share FROM c",
)
HIDE = (
    "CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN ' N/A ' WHEN 2 THEN 'null' WHEN 3 THEN '-' WHEN 4 THEN '12.5' WHEN 5 THEN 'Sem Informação' WHEN "
    "6 THEN chr(9) || 'N/A' || chr(12288) ELSE p_name END"
)
EDGES = "regexp_replace(regexp_replace(v, '^[\\s\\x{00A0}\\x{3000}]+', ''), '[\\s\\x{00A0}\\x{3000}]+$', '')"
add(
    "text_disguised",
    "part",
    lambda d: text.disguised(d.select(F.expr(HIDE.replace('chr(12288)', "'\u3000'")).alias("v")), "v"),
    f"WITH s AS (SELECT {HIDE} AS v FROM {{t}}) SELECT count(v) AS n_valid, count(*) FILTER (WHERE lower({EDGES}) IN ('', 'n/a', 'null', '-', 'sem "
    f"informação')) AS disguised, count(*) FILTER (WHERE lower({EDGES}) IN ('', 'n/a', 'null', '-', 'sem informação')) / CAST(count(v) AS DOUBLE) "
    f"AS share, count(try_cast({EDGES} AS DOUBLE)) AS castable FROM s",
)
SPOIL = (
    "CASE doc_id % 8 WHEN 0 THEN ' ' || text WHEN 1 THEN text || '  x' WHEN 2 THEN text || chr(8203) WHEN 3 THEN text || 'Ã©' WHEN 4 THEN text || "
    "'б' WHEN 5 THEN text || '<br>' WHEN 6 THEN text || 'zzzz' ELSE text END"
)
_ALPHABET = [chr(c) for c in (*range(32, 127), *range(0xA1, 0x250)) if chr(c) != "'"] + ["\\n", "\\t"]
_LETTERS = "|".join((f"[{c}]" if c not in "[]^\\-\\n\\t" else ("\\" + c if len(c) == 1 else c)) + "{4}" for c in _ALPHABET)
_RULES = {k: f"regexp_matches(v, '{_LETTERS if k == 'repeated' else sql_rule(r)}')" for k, r in strings.DIRT.items()} | {
    "control_no_space": "regexp_matches(v, '[\\x00-\\x08\\x0e-\\x1f\\x7f]')",
    "mixed_alphabets": "regexp_matches(v, '\\p{Latin}') AND regexp_matches(v, '[\\p{Cyrillic}\\p{Greek}]')",
}
add(
    "text_dirt",
    "documents",
    lambda d: text.dirt(d.select(F.expr(SPOIL.replace("chr(8203)", "'​'")).alias("v")), "v"),
    f"WITH s AS (SELECT {SPOIL} AS v FROM {{t}}) "
    + " UNION ALL ".join(f"SELECT '{k}' AS check_name, count(*) FILTER (WHERE {r}) AS n, count(*) FILTER (WHERE {r}) / CAST(count(v) AS DOUBLE) AS share FROM s" for k, r in _RULES.items()),
)
add(
    "text_offenders",
    "documents",
    lambda d: text.offenders(d, "text", "digits", 10),
    "SELECT DISTINCT text AS value FROM {t} WHERE regexp_matches(text, '[0-9]') ORDER BY value LIMIT 10",
)

# pairs
CONT = (
    "WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {t} GROUP BY 1, 2), g AS (SELECT x.a, y.b, coalesce(c.n, 0) AS n FROM (SELECT "
    "DISTINCT a FROM c) x CROSS JOIN (SELECT DISTINCT b FROM c) y LEFT JOIN c ON c.a = x.a AND c.b = y.b) "
)
_AB = CONT.replace("{a}", "l_returnflag").replace("{b}", "l_linestatus")
add(
    "pair_contingency",
    "lineitem",
    lambda d: pair.contingency(d, "l_returnflag", "l_linestatus"),
    _AB
    + (
        "SELECT a, b, n, n / CAST(sum(n) OVER () AS DOUBLE) AS of_all, n / CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE) AS of_row, n / CAST(sum(n) "
        "OVER (PARTITION BY b) AS DOUBLE) AS of_column FROM g"
    ),
)
add(
    "pair_chi2",
    "lineitem",
    lambda d: pair.chi_square(d, "l_returnflag", "l_linestatus"),
    _AB
    + (
        ", e AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a) * CAST(sum(n) OVER (PARTITION BY b) AS DOUBLE) / sum(n) OVER () AS e FROM g) SELECT "
        "CAST(sum(n) AS BIGINT) AS n, count(DISTINCT a) AS levels_a, count(DISTINCT b) AS levels_b, sum((n - e) * (n - e) / e) AS chi2, sqrt(sum((n "
        "- e) * (n - e) / e) / (sum(n) * (least(count(DISTINCT a), count(DISTINCT b)) - 1))) AS cramers_v FROM e"
    ),
)
add(
    "pair_group_stats",
    "events",
    lambda d: pair.group_stats(d, "event_type", "value"),
    "SELECT event_type AS category, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, quantile_cont(value, 0.25) AS "
    "q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS max FROM {t} WHERE event_type IS NOT NULL AND value "
    "IS NOT NULL GROUP BY 1",
)
add(
    "pair_group_boxes",
    "events",
    lambda d: pair.group_boxes(d, "event_type", "value"),
    "WITH q AS (SELECT event_type AS category, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) "
    "AS q3 FROM {t} GROUP BY 1), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q) SELECT category, q1, median, q3, "
    "min(value) FILTER (WHERE value >= lo AND value <= hi) AS low_whisker, max(value) FILTER (WHERE value >= lo AND value <= hi) AS high_whisker, "
    "count(*) FILTER (WHERE value < lo OR value > hi) AS outliers FROM {t} JOIN f ON f.category = event_type GROUP BY 1, 2, 3, 4",
)
add("pair_densities", "events", lambda d: pair.group_densities(d, "event_type", "value", 10), """
    WITH s AS (SELECT min(value) AS lo, (max(value) - min(value)) / 10 AS w FROM {t}),
    c AS (SELECT event_type AS category, CAST(least(floor((value - lo) / w), 9) AS BIGINT) AS bin, count(*) AS n FROM {t}, s WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2)
    SELECT category, bin, lo + bin * w AS low, lo + (bin + 1) * w AS high, n, n / (sum(n) OVER (PARTITION BY category) * w) AS density FROM c, s
""")
add(
    "pair_corr",
    "lineitem",
    lambda d: pair.correlation(d, "l_quantity", "l_extendedprice"),
    "SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS pearson FROM {t}",
)
RANKS = (
    "WITH r AS (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, rank() OVER (ORDER BY {b}) + (count(*) "
    "OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM {t})"
)
add(
    "pair_spearman",
    "lineitem",
    lambda d: pair.spearman(d, "l_quantity", "l_discount"),
    RANKS.replace("{a}", "l_quantity").replace("{b}", "l_discount") + " SELECT count(*) AS n, corr(ra, rb) AS spearman FROM r",
)
add(
    "pair_kendall",
    "lineitem",
    lambda d: pair.kendall(d, "l_linenumber", "l_discount"),
    "WITH t AS (SELECT l_linenumber AS a, l_discount AS b, CAST(count(*) AS DOUBLE) AS n FROM {t} GROUP BY 1, 2), s AS (SELECT sum(x.n * y.n * "
    "sign(x.a - y.a) * sign(x.b - y.b)) AS s FROM t x, t y), m AS (SELECT sum(n) AS n FROM t), ta AS (SELECT sum(m * m) AS v FROM (SELECT sum(n) "
    "AS m FROM t GROUP BY a)), tb AS (SELECT sum(m * m) AS v FROM (SELECT sum(n) AS m FROM t GROUP BY b)) SELECT CAST(n AS BIGINT) AS n, s / "
    "sqrt((n * n - ta.v) * (n * n - tb.v)) AS tau_b FROM s, m, ta, tb",
)
add(
    "pair_trend",
    "lineitem",
    lambda d: pair.trend(d, "l_quantity", "l_extendedprice"),
    "SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, "
    "l_quantity) AS r2 FROM {t}",
)
add(
    "pair_grid",
    "lineitem",
    lambda d: pair.grid(d, "l_quantity", "l_extendedprice", 10),
    "WITH b AS (SELECT min(l_quantity) AS la, max(l_quantity) AS ha, min(l_extendedprice) AS lb, max(l_extendedprice) AS hb FROM {t}) SELECT "
    "CAST(least(floor((l_quantity - la) / ((ha - la) / 10)), 9) AS BIGINT) AS bin_a, CAST(least(floor((l_extendedprice - lb) / ((hb - lb) / 10)), "
    "9) AS BIGINT) AS bin_b, count(*) AS n FROM {t}, b GROUP BY 1, 2",
)
add("pair_sample", "lineitem", lambda d: pair.sample(d, ["l_quantity", "l_extendedprice"], 500))
add(
    "period_by_category",
    "events",
    lambda d: pair.period_by_category(d, "ts", "event_type", "day"),
    "WITH c AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, event_type AS category, count(*) AS n FROM {t} GROUP BY 1, 2) SELECT "
    "period, category, n, n / CAST(sum(n) OVER (PARTITION BY period) AS DOUBLE) AS of_period FROM c",
)
add(
    "period_metric",
    "events",
    lambda d: pair.period_metric(d, "ts", "value", "day"),
    "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, count(*) AS n, avg(value) AS mean, sum(value) AS total, quantile_cont(value, 0.25) "
    "AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM {t} GROUP BY 1",
)

# whole profiles
QUERIES["describe_orders"] = lambda spark, sf_dir: describe(table(spark, sf_dir, "orders"), config=WHOLE).to_df(spark)
QUERIES["describe_events"] = lambda spark, sf_dir: describe(table(spark, sf_dir, "events"), config=WHOLE).to_df(spark)
QUERIES["narratives"] = lambda spark, sf_dir: spark.createDataFrame(
    [(n, c.narrative) for n, c in describe(table(spark, sf_dir, "part"), config=WHOLE).columns.items()], "column string, narrative string",
)
