"""Parameters of a profile, with their defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    max_categorical_levels: int = 30  # nominal: up to so many levels all are tabulated
    textual_unique_ratio: float = 0.5  # nominal: above this share of distinct values the string itself is profiled
    max_discrete_levels: int = 30  # discrete: up to so many values all are tabulated
    discrete_extremes_levels: int = 5
    discrete_extremes_include_middle: bool = False
    continuous_extremes_levels: int = 5
    long_tail_top_n: int = 10
    ordinal_levels: dict[str, list[str]] = field(default_factory=dict)  # declared order, by column
    inference_sample_size: int | None = 100_000  # rows that decide the route; None: all
    sample_size: int = 10  # rows of a directed sample
    quantile_error: float = 0.01  # of approximate quantiles; 0.0: exact
    rare_level_pct: float = 1.0  # a level below this percentage is rare
    identifier_min_rows: int = 50
    date_parse_rate: float = 0.9
    date_parse_min: int = 20
    date_parse_rows: int = 1000
    log_scale_ratio: float = 2.0  # mean over median from which a logarithmic scale is suggested
    max_bins: int = 50  # of a histogram
    language: str = "pt-BR"
    narrative_tone: str = "academico"  # or "direto": the same figures in shorter sentences
    narrative_llm: Callable[[str], str] | None = None  # rephrases each narrative; its numbers are checked
    oldest: str = "1900-01-01"  # instants before are implausible
    curve_points: int = 100  # of densities and distribution curves
