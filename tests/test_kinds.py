import pytest

from descry import CardinalityRegime, Config, VariableClass, VariableSubtype, VariableType
from descry.plans.route import infer_schema, route


def meta(dtype="bigint", n=1000, k=10, integer=True, **more):
    return {"dtype": dtype, "n": n, "n_valid": n, "n_distinct": k, "all_integer": integer, "parse_date_rate": None} | more


FITS = {
    "nominal": "qualitative", "ordinal": "qualitative", "binary": "qualitative", "discrete": "quantitative", "continuous": "quantitative",
    "instant": "temporal", "duration": "temporal",
}


@pytest.mark.parametrize("kind", VariableClass)
@pytest.mark.parametrize("subtype", [None, *VariableSubtype])
@pytest.mark.parametrize("regime", [None, *CardinalityRegime])
def test_what_fits_together(kind, subtype, regime):
    ok = subtype is None or FITS[subtype.value] == kind.value
    ok &= regime is None or subtype is not None and regime.value in {
        "nominal": ("categorical", "long_tail", "textual"), "discrete": ("table", "histogram"),
    }.get(subtype.value, ())
    if not ok:
        with pytest.raises(ValueError):
            VariableType(kind, subtype, regime)
        return
    got = VariableType(kind, subtype, regime)
    assert bool(got.warnings) == (subtype is VariableSubtype.ORDINAL)
    assert not VariableType(kind, subtype, regime, ordered_levels=["a", "b"]).warnings


def test_codes_only_warn():
    years = meta(k=40) | {"min": 1950.0, "max": 2020.0}
    assert route(years, name="built").warnings and route(years, name="built").route == "discrete[histogram]"
    assert not route(years | {"max": 9000.0}, name="built").warnings
    assert route(meta("string", k=500) | {"code_rate": 0.95}, name="where").warnings


@pytest.mark.parametrize(
    ("m", "want"),
    [
        (meta(k=2), "binary"),
        (meta(k=1000), "identifier"),
        (meta(n=50, k=50), "discrete[histogram]"),
        (meta(k=30), "discrete[table]"),
        (meta(k=31), "discrete[histogram]"),
        (meta("double", k=1000, integer=False), "continuous"),
        (meta("string", k=1000), "nominal[textual]"),
        (meta("string", k=500), "nominal[long_tail]"),
        (meta("string", k=30), "nominal[categorical]"),
        (meta("string", k=900, parse_date_rate=0.95, parse_date_n=100), "instant"),
        (meta("string", k=900, parse_date_rate=0.95, parse_date_n=10), "nominal[textual]"),
        (meta("timestamp_ntz", k=9), "instant"),
        (meta("interval day to second", k=9), "duration"),
        (meta("boolean", k=2), "binary"),
        (meta("array<int>", k=None), "unsupported"),
        (meta("string", n=0, k=0), "unsupported"),
    ],
)
def test_routes(m, want):
    assert route(m).route == want


def test_overrides_orders_and_codes():
    metadata = {"size": meta("string", k=3), "zip_code": meta(k=400), "rank": meta(k=1000)}
    got = infer_schema(
        metadata, {"rank": VariableType(VariableClass.QUANTITATIVE, VariableSubtype.DISCRETE, CardinalityRegime.HISTOGRAM)},
        Config(ordinal_levels={"size": ["S", "M", "L"]}),
    )
    assert got["size"].ordered_levels == ["S", "M", "L"]
    assert got["zip_code"].warnings and got["zip_code"].route == "discrete[histogram]"
    assert got["rank"].route == "discrete[histogram]"
    with pytest.raises(ValueError):
        infer_schema(metadata, {"nope": got["rank"]})
