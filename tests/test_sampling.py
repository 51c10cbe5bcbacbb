"""Routes beyond the first rows of a table, and timelines of many periods."""

from pyspark.sql import functions as F

from descry import queries
from descry.config import Config
from descry.plans.describe import schema_of, timeline


def test_routes_of_a_table_longer_than_the_sample(spark, tmp_path):
    df = spark.range(0, 120_000, 1, 1).select(
        F.when(F.col("id") < 101_000, F.col("id")).otherwise(7).alias("key"), F.when(F.col("id") < 101_000, F.floor(F.col("id") / 9).cast("double")).otherwise(F.col("id") + 0.5).alias("amount"), F.least("id", F.lit(60_000)).cast("string").alias("label"))
    routes = {c: k.route for c, k in schema_of(df, queries.WHOLE)[1].items()}
    for name in ("part", "customer"):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.tbl, r.column): r.route for r in queries.QUERIES["route_columns"](spark, str(tmp_path)).collect()}
    assert all(got[t, c] == routes[c] for t, c in got) and "continuous" in routes["amount"] and "identifier" not in routes["key"]
    # a sample by hash sees late rows too
    assert "continuous" in schema_of(df, Config(inference_sample_size=1000))[1]["amount"].route


def test_timeline_goes_coarser(spark):
    days = spark.range(9000).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    got, unit = timeline(days, "d", "day")
    assert unit == "week" and len(got) <= 5000 and sum(r["n"] for r in got) == 9000
    assert timeline(days.limit(10), "d", "day")[1] == "day" and len(timeline(days, "d", "day", 2)[0]) == 25
