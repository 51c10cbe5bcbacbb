"""Which kind of variable a column is. Pure functions of the metadata; every decision can be overridden."""

from __future__ import annotations

import re

from descry.config import Config
from descry.kinds import CardinalityRegime as R
from descry.kinds import VariableClass as C
from descry.kinds import VariableSubtype as S
from descry.kinds import VariableType

NUMBERS = re.compile(r"(tinyint|smallint|int|bigint|float|double|decimal.*)$")
CODES = re.compile(r"(^|_)(zip|zipcode|cep|code|codigo|cod|postal|ncm|cnpj|cpf|year|ano)($|_)", re.I)
YEARS = (1900, 2100)
RANKS = re.compile(r"(^|[._ ])(rank|position|posicao|place)($|[._ ])", re.I)


def code_like(meta: dict, name: str) -> bool:
    """By the name, by whole numbers that could all be years, or by texts that nearly all are postal codes. It only warns."""
    if not NUMBERS.match(meta["dtype"]):
        return (meta.get("code_rate") or 0) >= 0.9
    low, high = meta.get("min"), meta.get("max")
    years = meta["all_integer"] and low is not None and YEARS[0] <= low and high <= YEARS[1] and (meta["n_distinct"] or 0) > 2
    return bool(CODES.search(name) or years)


def route(meta: dict, config: Config | None = None, name: str = "", levels: list[str] | None = None) -> VariableType:
    """The kind of one column from its metadata. `levels`: declared or detected order of its labels."""
    config = config or Config()
    dtype, n, k = meta["dtype"], meta["n_valid"], meta["n_distinct"]
    warnings = ["looks like a code: check whether it is a quantity"] if code_like(meta, name) else []
    if k is None:
        return VariableType(C.UNSUPPORTED, confidence=1.0, warnings=["nested or binary values"])
    if not n:
        return VariableType(C.UNSUPPORTED, confidence=0.5, warnings=["no valid values"])
    if dtype == "boolean":
        return VariableType(C.QUALITATIVE, S.BINARY, confidence=0.95)
    if dtype in ("date", "timestamp", "timestamp_ntz"):
        return VariableType(C.TEMPORAL, S.INSTANT, confidence=0.95)
    if dtype.startswith("interval day") or dtype.startswith("interval hour"):
        return VariableType(C.TEMPORAL, S.DURATION, confidence=0.95)
    if levels:
        return VariableType(C.QUALITATIVE, S.ORDINAL, confidence=0.9, ordered_levels=list(levels), warnings=warnings)
    if NUMBERS.match(dtype):
        if k == 2:
            return VariableType(C.QUALITATIVE, S.BINARY, confidence=0.8, warnings=warnings)
        if k == n and n > config.identifier_min_rows and meta["all_integer"]:
            rank = ["could be a rank: identifiers and ranks look alike"] if RANKS.search(name) else []
            return VariableType(C.IDENTIFIER, confidence=0.8, warnings=warnings + rank)
        if meta["all_integer"]:
            return VariableType(C.QUANTITATIVE, S.DISCRETE, R.TABLE if k <= config.max_discrete_levels else R.HISTOGRAM, 0.8, warnings=warnings)
        return VariableType(C.QUANTITATIVE, S.CONTINUOUS, confidence=0.9, warnings=warnings)
    if (meta.get("parse_date_n") or 0) >= config.date_parse_min and (meta["parse_date_rate"] or 0) >= config.date_parse_rate:
        return VariableType(C.TEMPORAL, S.INSTANT, confidence=0.8, warnings=["dates in text"])
    if k == 2:
        return VariableType(C.QUALITATIVE, S.BINARY, confidence=0.8)
    if k / n > config.textual_unique_ratio:
        return VariableType(C.QUALITATIVE, S.NOMINAL, R.TEXTUAL, 0.8, warnings=warnings)
    return VariableType(C.QUALITATIVE, S.NOMINAL, R.CATEGORICAL if k <= config.max_categorical_levels else R.LONG_TAIL, 0.8, warnings=warnings)


def infer_schema(
    metadata: dict[str, dict], overrides: dict[str, VariableType] | None = None, config: Config | None = None,
    orders: dict[str, list[str]] | None = None,
) -> dict[str, VariableType]:
    """{column: kind}; the user's overrides win, then declared orders, then orders found in labels."""
    config, overrides = config or Config(), overrides or {}
    if unknown := set(overrides) - set(metadata):
        raise ValueError(f"overrides for unknown columns: {sorted(unknown)}")
    declared = (orders or {}) | config.ordinal_levels
    return {c: overrides.get(c) or route(m, config, c, declared.get(c)) for c, m in metadata.items()}
