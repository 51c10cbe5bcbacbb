import json
import warnings

import pytest
from pyspark.sql import functions as F

import descry
from descry import Config, VariableClass, VariableSubtype, VariableType
from descry.narrative import narrate, numbers_kept, rephrased
from descry.plans.describe import schema_of
from descry.profiles import ColumnProfile
from descry.sources import files
from descry.streaming import per_period

DATA = "/root/testdata/sf0.01"
# The routes of the driver's tables at this scale.
ROUTES = {
    "customer": {
        "c_custkey": "identifier", "c_name": "nominal[textual]", "c_nationkey": "discrete[table]", "c_acctbal": "continuous",
        "c_mktsegment": "nominal[categorical]",
    },
    "orders": {
        "o_orderkey": "identifier", "o_custkey": "discrete[histogram]", "o_orderstatus": "nominal[categorical]", "o_totalprice": "continuous",
        "o_orderdate": "instant", "o_orderpriority": "ordinal",
    },
    "part": {
        "p_partkey": "identifier", "p_name": "nominal[long_tail]", "p_brand": "nominal[categorical]", "p_type": "nominal[categorical]",
        "p_size": "discrete[histogram]", "p_retailprice": "continuous",
    },
    "supplier": {"s_suppkey": "identifier", "s_name": "nominal[textual]", "s_nationkey": "discrete[table]", "s_acctbal": "continuous"},
    "embeddings": {"vec_id": "identifier", "embedding": "unsupported", "label": "discrete[table]"},
    "labels": {"doc_id": "identifier", "quality": "binary", "toxic": "binary"},
}


@pytest.mark.parametrize("name", sorted(ROUTES))
def test_routes_of_tables(spark, name):
    got = schema_of(spark.read.parquet(f"{DATA}/{name}.parquet"))[1]
    assert {c: k.route for c, k in got.items()} == ROUTES[name]


def test_describe_everything(spark):
    d = spark.range(400).select(
        F.col("id").alias("order_id"), F.concat(F.lit("Name "), F.col("id")).alias("name"), (F.col("id") % 2 == 0).alias("flag"), (F.col("id") % 5).alias("items"), (F.col("id") * 1.37).alias("price"),
        F.when(F.col("id") % 10 == 0, None).otherwise(F.element_at(F.array(*[F.lit(f"{i} stars") for i in range(1, 4)]), (F.col("id") % 3 + 1).cast("int"))).alias("stars"),
        F.timestamp_add(
            "DAY", (F.col("id") % 90).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"),
        ).alias("day"), F.expr("make_dt_interval(0, cast(id % 7 as int))").alias("took"), F.array(F.col("id")).alias("nested"), F.lit(None).cast("string").alias("void"),
    )
    p = descry.describe(d, overrides={"items": VariableType(VariableClass.QUANTITATIVE, VariableSubtype.CONTINUOUS)}, config=Config(language="en"))
    routes = {c: t.route for c, t in p.schema.items()}
    assert routes == {
        "order_id": "identifier", "name": "nominal[textual]", "flag": "binary", "items": "continuous", "price": "continuous", "stars": "ordinal",
        "day": "instant", "took": "duration", "nested": "unsupported", "void": "unsupported",
    }
    assert p.n_rows == 400 and p["stars"].quality["n_missing"] == 40
    assert p["stars"].summary["essential"]["median"] == "2 stars"
    assert p["day"].summary["essential"]["granularity"] == "day"
    assert "400" in p["price"].narrative and "ordinal" in p["stars"].narrative
    assert json.loads(p.to_json())["columns"]["price"]["route"] == "continuous"
    assert "<table>" in p.report("html") and p.to_df(spark).count() > 50
    with pytest.raises(ValueError):
        p.report("pdf")


def test_refuses_streams_and_others(spark):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError):
        descry.describe(stream)
    with pytest.raises(TypeError):
        descry.describe([1, 2])
    assert per_period(spark.sql("select timestamp'2024-01-01 10:20:00' as t"), "t").first().n == 1


def test_pairs_by_class(spark):
    d = spark.read.parquet(f"{DATA}/events.parquet")
    assert set(descry.describe_pair(d, "event_type", "value")) == {"group_stats", "group_boxes", "group_densities"}
    assert set(descry.describe_pair(d, "value", "ts")) == {"period_metric"}
    assert set(descry.describe_pair(d, "ts", "event_type")) == {"period_by_category"}


def test_narrative_and_number_lock():
    kind = VariableType(VariableClass.QUALITATIVE, VariableSubtype.BINARY)
    levels = [
        {"level": "No", "n": 5174, "of_total": 5174 / 7043}, {"level": "Yes", "n": 1869, "of_total": 1869 / 7043},
        {"level": "(missing)", "n": 0, "of_total": 0.0},
    ]
    p = ColumnProfile("Churn", kind, {"n": 7043, "n_missing": 0}, {"essential": {"levels": levels}})
    pt, en = narrate(p), narrate(p, "en")
    assert "7.043 registros" in pt and "5.174" in pt and "73,5%" in pt and "26,5%" in pt
    assert "7,043 records" in en and "73.5%" in en
    assert numbers_kept(pt, "Em " + pt) and not numbers_kept(pt, pt.replace("5.174", "5.175"))
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert rephrased(pt, lambda t: t.replace("73,5", "74")) == pt and seen
    assert rephrased(pt, lambda t: "Segue: " + t).startswith("Segue")


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_bytes("nome;valor\nJoão;1,5\nZé;2\n".encode("latin-1"))
    (tmp_path / "in/b.csv").write_text("x,y\n1,2\n3,4\n5,6\n" * 20)
    d = files.csv_any(spark, str(tmp_path / "in/a.csv"))
    assert d.columns == ["nome", "valor"] and d.first().nome == "João"
    assert files.csv(spark, str(tmp_path / "in/b.csv"), rows=5).count() == 5
    assert files.largest_csv(spark, str(tmp_path)).endswith("b.csv")
    files.write_csv(d, str(tmp_path / "out"))
    files.write_csv(d, str(tmp_path / "out"))
    files.write_csv(d, str(tmp_path / "out"), "ignore")
    assert files.csv(spark, str(tmp_path / "out")).count() == 4
    (tmp_path / "n.json").write_text('[{"a": {"b": 1, "c": {"d": "x"}}}]')
    assert files.flatten(files.nested_json(spark, str(tmp_path / "n.json"))).columns == ["a.b", "a.c.d"]
    p = descry.describe(spark.range(60))
    files.write_profile(spark, p, str(tmp_path / "p"), "html")
    assert spark.read.text(str(tmp_path / "p")).count() >= 1
    spark.range(3).createOrReplaceTempView("three")
    assert files.table(spark, "three").count() == 3


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_curves_modes_and_bounds(spark):
    d = spark.range(500).select(
        (F.col("id") % 7 + F.when(F.col("id") % 7 == 6, 10).otherwise(0)).alias("few"), (F.col("id") % 101 % 90).alias("many"), (F.sqrt(F.col("id") + 1.0) * 3.7).alias("x"), F.element_at(
            F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int"),
        ).alias("kind"),
        F.when(F.col("id") == 3, F.lit("2999-01-01")).when(F.col("id") == 4, F.lit("1700-01-01")).otherwise("2024-01-01").cast("timestamp_ntz").alias("day"), F.date_format(
            F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("2023-01-01").cast("timestamp_ntz")), "MM/dd/yyyy",
        ).alias("text_day"), F.expr("make_dt_interval(0, cast(id % 7 - 1 as int))").alias("took"),
    )
    p = descry.describe(d, config=Config(language="en", narrative_tone="direto", max_bins=6, narrative_llm=lambda t: t + " Done."), now="2025-01-01")
    assert p["few"].summary["essential"]["mode"] == 0 and p["few"].summary["complete"]["holes"] == [{"low": 6, "high": 15, "n": 10}]
    assert p["many"].summary["essential"]["mode"] == 0 and len(p["many"].summary["essential"]["histogram"]) <= 6
    charts = {n: [v.chart for v in c.viz_suggestions] for n, c in p.columns.items()}
    assert {
        "cumulative distribution", "density", "quantile plot", "boxplot",
    } <= set(charts["x"]) and "cumulative distribution" in charts["few"] and "cumulative distribution" in charts["many"]
    curve = next(v for v in p["x"].viz_suggestions if v.chart == "cumulative distribution").data["rows"]
    assert curve[-1]["at_most"] == 1.0 and all(a["at_most"] <= b["at_most"] for a, b in zip(curve, curve[1:], strict=False))
    assert p["day"].summary["complete"]["future"] == 1 and p["day"].summary["complete"]["too_old"] == 1 and len(p["day"].notes) == 2
    assert p["text_day"].quality["date_format"] == "MM/dd/yyyy" and str(p["text_day"].summary["essential"]["last"])[:10] == "2024-05-14"
    assert p["text_day"].summary["essential"]["granularity"] == "day" and any("possible ordinal" in n for n in p["kind"].notes)
    assert p["took"].summary["complete"]["n_negative"] == 72 and "negative" in p["took"].narrative
    assert p["x"].narrative.startswith("x: 500 records") and p["x"].narrative.endswith("Done.") and "#0A0E1A" in p.report()
    with pytest.raises(ValueError):
        narrate(p["x"], "en", "loud")


def test_summaries_equal_the_single_ones(spark):
    from descry.operators import numeric

    d = spark.range(300).select(
        (F.col("id") * F.col("id") / 7.0).alias("a"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 11).alias("b"),
        F.lit(None).cast("double").alias("c"), F.lit(4.0).alias("d"),
    )
    got = numeric.summaries(d, d.columns)
    for c in d.columns:
        one, out = numeric.summary(d, c).first().asDict(), numeric.outliers(d, c).first()
        assert all(got[c][k] == pytest.approx(v, nan_ok=True) if isinstance(v, float) else got[c][k] == v for k, v in one.items()), c
        assert c == "c" or (got[c]["outliers"], got[c]["low_whisker"], got[c]["high_whisker"]) == (out.outliers, out.low_whisker, out.high_whisker)
    bins = numeric.histograms(d, {c: got[c] for c in d.columns}, {"b"})
    for c, whole in (("a", False), ("b", True), ("d", False)):
        assert bins[c] == [r.asDict() for r in numeric.histogram(d, c, whole=whole).orderBy("bin").collect()], c


def test_pairs_of_ordered_levels(spark):
    d = spark.range(60).select(
        F.element_at(F.array(F.lit("low"), F.lit("mid"), F.lit("top")), (F.col("id") % 3 + 1).cast("int")).alias("a"),
        F.element_at(F.array(F.lit("1 x"), F.lit("2 y"), F.lit("3 z")), ((F.col("id") + F.floor(F.col("id") / 50)) % 3 + 1).cast("int")).alias("b"),
    )
    got = descry.describe_pair(d, "a", "b", config=Config(ordinal_levels={"a": ["low", "mid", "top"]}))
    assert 0.3 < got["kendall"].first().tau_b < 1 and 0.3 < got["spearman"].first().spearman < 1
    from descry.operators import pair

    with pytest.raises(ValueError):
        pair.contingency(spark.range(5000).selectExpr("id as a", "id as b"), "a", "b")


def test_text_edges_as_unicode_has_them(spark):
    from descry.functions import strings
    from descry.operators import text

    d = spark.createDataFrame([("\tN/A",), (" null　",), ("x  y",), ("plain",), ("a ",), ("12 ",)], "v string")
    assert text.disguised(d, "v").first().disguised == 2 and text.disguised(d, "v").first().castable == 1
    found = {r.check_name: r.n for r in text.dirt(d, "v").collect()}
    assert found["edge_space"] == 4 and found["double_space"] == 1
    assert [r[0] for r in d.select(strings.strip(F.col("v"))).collect()] == ["N/A", "null", "x  y", "plain", "a", "12"]


def test_sparse_dates_late_accents_and_arrays(spark, tmp_path):
    late = spark.range(30_000).select(F.when(F.col("id") % 1000 == 999, F.lit("2024-02-03")).alias("d"))
    assert schema_of(late)[1]["d"].route == "instant"
    (tmp_path / "late.csv").write_bytes(("nome;valor\n" + "Joao;1\n" * 200 + "José;2\n").encode("latin-1"))
    assert files.csv_any(spark, str(tmp_path / "late.csv")).where("nome = 'José'").count() == 1
    (tmp_path / "n.json").write_text('[{"a": [{"b": 1}, {"b": 2}], "c": "x"}, {"a": [], "c": "y"}]')
    got = files.flatten(files.nested_json(spark, str(tmp_path / "n.json")), explode=True)
    assert sorted((r[0] or 0, r[1]) for r in got.collect()) == [(0, "y"), (1, "x"), (2, "x")] and got.columns == ["a.b", "c"]


def test_wide_holes(spark):
    from descry.operators import numeric

    d = spark.createDataFrame([(1,), (10**12,), (3,)], "x long")
    assert [tuple(r) for r in numeric.hole_ranges(d, "x").orderBy("low").collect()] == [(2, 2, 1), (4, 10**12 - 1, 10**12 - 4)]
