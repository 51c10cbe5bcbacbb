import datetime as dt
import math
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from descry.functions import dates, strings
from descry.operators import freq, numeric, ordinal, pair, temporal, text


def repeated(spark, pairs, name="x"):
    """A frame with each value so many times."""
    frame = spark.createDataFrame([(v, n) for v, n in pairs], f"{name} {'string' if isinstance(pairs[0][0], str) else 'double'}, n int")
    return frame.select(name, F.explode(F.expr("sequence(1, n)")).alias("_")).drop("_")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_binary_table_and_balance(spark):
    d = repeated(spark, [("No", 5174), ("Yes", 1869)], "churn")
    got = {r.level: r for r in freq.binary_table(d, "churn").collect()}
    assert round(100 * got["No"].of_total, 1) == 73.5 and round(100 * got["Yes"].of_valid, 1) == 26.5
    assert got["(missing)"].n == 0 and got["(missing)"].of_valid is None
    b = freq.balance(d, "churn").first()
    assert b.dominant == "No" and round(b.ratio, 1) == 2.8


def test_discrete_golden(spark):
    d = repeated(spark, [(0.0, 608), (1.0, 209), (2.0, 28), (3.0, 16), (4.0, 18), (5.0, 5), (8.0, 7)])
    s = numeric.summary(d, "x").first()
    assert (s.n, s.min, s.max, s.median, round(s["mean"], 2), round(s.sd, 2), round(100 * s.zeros, 1)) == (891, 0, 8, 0, 0.52, 1.10, 68.2)
    assert [r.value for r in numeric.holes(d, "x").orderBy("value").collect()] == [6, 7]
    t = numeric.table(d, "x").orderBy(F.asc_nulls_last("value")).collect()
    assert t[0].n == 608 and t[-1].value is None and t[-1].n == 0 and t[-2].cumulative == 1.0


def test_frequency_extremes(spark):
    d = repeated(spark, [(1.0, 9), (2.0, 8), (12.0, 7), (6.0, 6), (4.0, 5), (80995.0, 1), (-80995.0, 1), (74215.0, 1), (-74215.0, 1), (12540.0, 1), (3.0, 1)])
    got = rows(numeric.frequency_extremes(d, "x", middle=True), "end", "position")
    assert [r[2] for r in got if r[0] == "least"] == [80995, -80995, 74215, -74215, 12540]
    assert [r[2] for r in got if r[0] == "most"] == [1, 2, 12, 6, 4]
    assert len([r for r in got if r[0] == "middle"]) == 5


def test_ordinal(spark):
    d = repeated(spark, [("3", 10), ("4", 53), ("5", 681), ("6", 638), ("7", 199), ("8", 18)], "q")
    q = ordinal.quartiles(d, "q").first()
    assert (q["mode"], q.median) == ("5", "6")
    cum = {r.level: round(100 * r.cumulative, 1) for r in ordinal.table(d, "q").collect()}
    assert cum["5"] == 46.5 and cum["6"] == 86.4
    ages = ["75+ years", "5-14 years", "15-24 years", "25-34 years", "35-54 years", "55-74 years"]
    order = ordinal.order_by_number(repeated(spark, [(a, 1) for a in ages], "age"), "age")
    assert order == ["5-14 years", "15-24 years", "25-34 years", "35-54 years", "55-74 years", "75+ years"]
    assert ordinal.order_by_number(repeated(spark, [("5-9", 1), ("5+", 2)], "a"), "a") is None


def test_long_tail(spark):
    d = repeated(spark, [("a", 50), ("b", 30), ("c", 15), ("d", 4), ("e", 1)], "s")
    got = rows(freq.top(d, "s", 2), "position")
    assert got[-1][1:4] == ("Others", 20, 3) and math.isclose(got[-1][4], 0.2)
    assert {r.percent: r.levels for r in freq.concentration(d, "s").collect()} == {50: 2, 80: 3, 95: 4}  # exact hits count one more
    assert freq.singletons(d, "s").first().singletons == 1


def test_variants(spark):
    d = repeated(spark, [("UBER DO BRASIL LTDA.", 7), ("Uber Do Brasil  Ltda.", 2), ("São Paulo", 3), ("SAO PAULO ", 1), ("other", 1)], "s")
    got = freq.variant_groups(d, "s")
    assert got == {"uber do brasil ltda.": {"UBER DO BRASIL LTDA.": 7, "Uber Do Brasil  Ltda.": 2}, "sao paulo": {"São Paulo": 3, "SAO PAULO ": 1}}
    assert freq.variants(d, "s", exact=False).count() == 4


def test_value_extremes_and_outliers(spark):
    d = repeated(spark, [(0.0, 11), (10.0, 17), (11.0, 1), (12.0, 1), (13.0, 1), (9999.0, 3), (10000.0, 3)])
    got = rows(numeric.value_extremes(d, "x", 2), "end", "position")
    assert got == [("largest", 1, 10000.0, 3), ("largest", 2, 9999.0, 3), ("smallest", 1, 0.0, 11), ("smallest", 2, 10.0, 17)]
    assert numeric.outliers(d, "x").first().outliers == 6


def test_nan_null_and_negative_zero(spark):
    d = spark.createDataFrame([(float("nan"),), (None,), (0.0,), (-0.0,), (5.0,)], "x double")
    s = numeric.summary(d, "x").first()
    assert (s.n, s.n_valid, s.n_missing, s.max) == (5, 3, 2, 5.0)
    assert rows(freq.counts(d, "x"), "level") == [("0.0", 2), ("5.0", 1)]


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "x double, s string, t timestamp_ntz")
    assert numeric.summary(none, "x").first().n == 0
    assert numeric.histogram(none, "x").count() == 0
    assert freq.top(none, "s").count() == 0
    assert temporal.granularity(none, "t").first().granularity is None
    assert pair.grid(none, "x", "x").count() == 0
    one = repeated(spark, [("a", 3)], "s")
    assert freq.shape(one, "s").first().entropy is None


def test_odd_names(spark):
    d = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "`a.b c` double, `native.country` string")
    assert numeric.summary(d, "a.b c").first().n == 2
    assert freq.counts(d, "native.country").count() == 2


def test_histogram_last_bin_and_whole(spark):
    d = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    assert [r.n for r in numeric.histogram(d, "x", 5).orderBy("bin").collect()] == [2, 2, 2, 2, 3]
    got = numeric.histogram(d, "x", 4, whole=True).orderBy("bin").collect()
    assert [(r.low, r.n) for r in got] == [(0.0, 3), (3.0, 3), (6.0, 3), (9.0, 2)]
    assert abs(sum(r.density for r in numeric.density(d, "x", 200).collect()) * (10 + 6 * 1.7) / 200 - 1) < 0.3


def test_moments_are_adjusted(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    s = numeric.summary(d, "x").first()
    assert round(s.skewness, 4) == 1.4693 and round(s.kurtosis, 4) == 2.0308


def test_text(spark):
    d = spark.createDataFrame([(" a",), ("b  c",), ("x y",), ("tttt",), ("Ã©",), ("aб",), ("n\n",), ("<br>",), ("N/A",), (None,)], "s string")
    got = {r.check_name: r.n for r in text.dirt(d, "s").collect()}
    assert (
        got["edge_space"], got["double_space"], got["invisible"], got["repeated"], got["mojibake"], got["mixed_alphabets"], got["html"],
        got["control"], got["control_no_space"],
    ) == (2, 1, 1, 1, 1, 1, 1, 1, 0)
    assert text.disguised(d, "s").first().disguised == 1
    assert [r.value for r in text.offenders(d, "s", "html").collect()] == ["<br>"]
    mails = spark.createDataFrame([("a@b.co",), ("c@d.org",), ("nope",)], "s string")
    assert text.dominant_pattern(mails, "s").first().pattern == "email"
    assert [r.value for r in text.violations(mails, "s", "email").collect()] == ["nope"]
    assert rows(text.masks(spark.createDataFrame([("Rua X, 123",)], "s string"), "s")) == [("Aaa A, 999", 1)]
    assert strings.normal_key(" ﬁm  Ação ") == "fim acao"


def test_dates(spark):
    d = spark.createDataFrame([("September 25, 2021",), ("2021-09-25",), ("25/09/2021",), ("x",)], "s string")
    assert [r.p for r in d.select(dates.parse(F.col("s")).alias("p")).collect()] == [dt.datetime(2021, 9, 25)] * 3 + [None]
    assert dates.smart_unit(7200) == (2.0, "h")


def test_temporal(spark):
    days = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 5)]
    d = spark.createDataFrame([(x,) for x in days], "t timestamp_ntz")
    assert temporal.granularity(d, "t").first().granularity == "day"
    assert rows(temporal.gaps(d, "t")) == [(dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 5), 2)]
    assert rows(temporal.duplicates(d, "t")) == [(dt.datetime(2024, 1, 2), 2)]
    assert {(r.part, r.value): r.n for r in temporal.cycles(d, "t").collect()}["weekday", 1] == 1
    b = temporal.bounds(d, "t", "2024-01-03").first()
    assert (b.future, b.too_old) == (1, 0)
    two = spark.createDataFrame([(days[1], days[0]), (days[0], days[3])], "a timestamp_ntz, b timestamp_ntz")
    s = temporal.duration_summary(temporal.durations(two, "a", "b"), "seconds").first()
    assert (s.min, s.max, s.n_negative) == (-86400.0, 4 * 86400.0, 1)
    interval = two.select((F.col("b") - F.col("a")).alias("i"))
    assert numeric.summary(interval, "i").first().max == 4 * 86400.0


def test_pairs(spark):
    d = spark.createDataFrame(
        [("a", "x", 1.0, 2.0), ("a", "x", 2.0, 4.5), ("b", "y", 3.0, 6.0), ("b", "x", 4.0, 9.0)], "p string, q string, u double, v double",
    )
    cells = {(r.a, r.b): r.n for r in pair.contingency(d, "p", "q").collect()}
    assert cells == {("a", "x"): 2, ("a", "y"): 0, ("b", "x"): 1, ("b", "y"): 1}
    assert math.isclose(pair.chi_square(d, "p", "q").first().chi2, 4 / 3)
    assert math.isclose(pair.spearman(d, "u", "v").first().spearman, 1.0)
    assert math.isclose(pair.kendall(d, "u", "v").first().tau_b, 1.0)
    assert math.isclose(pair.trend(d, "u", "v").first().slope, 2.25)
    assert pair.sample(d, ["u", "v"], 2).collect() == pair.sample(d.repartition(3), ["u", "v"], 2).collect()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=60))
def test_frequency_properties(spark, values):
    d = spark.createDataFrame([(v,) for v in values], "s string")
    t = freq.table(d, "s").orderBy("rank").collect()
    assert math.isclose(sum(r.share for r in t), 1.0) and math.isclose(t[-1].cumulative, 1.0)
    assert sum(r.n for r in freq.top(d, "s", 3).collect()) == len(values)
    s = freq.shape(d, "s").first()
    assert s.k * s.herfindahl >= 1 - 1e-9


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=2, max_size=40))
def test_numeric_properties(spark, values):
    d = spark.createDataFrame([(v,) for v in values], "x double")
    s = numeric.summary(d, "x").first()
    assert math.isclose(s.median, statistics.median(values), rel_tol=1e-9, abs_tol=1e-9)
    assert sum(r.n for r in numeric.histogram(d, "x").collect()) == len(values)


def test_unknown_column(spark):
    with pytest.raises(ValueError):
        numeric.summary(spark.range(3), "nope")


def test_exact_quantiles_by_ranges(spark, monkeypatch):
    d = spark.range(5000).select(F.when(F.col("id") % 9 == 0, None).otherwise((F.col("id") * 7919 % 5003) / 3.0).alias("x"))
    one, out = numeric.summary(d, "x").first(), numeric.outliers(d, "x").first()
    monkeypatch.setattr(numeric, "MOST_VALUES", 10)
    again = numeric.summary(d, "x").first()
    assert all(again[k] == pytest.approx(one[k]) for k in one.asDict()) and numeric.outliers(d, "x").first() == out
    assert numeric.summaries(d, ["x"])["x"]["median"] == pytest.approx(one.median)
    assert numeric.exact_quantiles(d.where("x is null"), "x", [0.5]) == [None]
