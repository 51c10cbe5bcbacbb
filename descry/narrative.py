"""Prose from templates, in Portuguese and English; each number in it comes from the profile."""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Callable

from descry.kinds import VariableSubtype as S
from descry.profiles import ColumnProfile

PT, EN = "pt-BR", "en"
# Names of the kinds.
KINDS = {
    PT: {
        "binary": "qualitativa binária", "nominal": "qualitativa nominal", "ordinal": "qualitativa ordinal", "discrete": "quantitativa discreta",
        "continuous": "quantitativa contínua", "instant": "temporal (instante)", "duration": "temporal (duração)",
    },
    EN: {
        "binary": "a binary qualitative variable", "nominal": "a nominal qualitative variable", "ordinal": "an ordinal qualitative variable",
        "discrete": "a discrete quantitative variable", "continuous": "a continuous quantitative variable",
        "instant": "a temporal variable (instant)", "duration": "a temporal variable (duration)",
    },
}


def figure(x: float | int, lang: str, digits: int | None = None) -> str:
    """A number as the language writes it."""
    if x is None:
        return "—"
    text = f"{x:,.{digits}f}" if digits is not None else (
        f"{x:,}" if isinstance(x, int) or float(x).is_integer() and abs(x) < 1e15 and not isinstance(x, float) else f"{x:,.2f}"
    )
    return text.translate(str.maketrans(",.", ".,")) if lang == PT else text


def percent(x: float, lang: str) -> str:
    return figure(100 * x, lang, 1) + "%"


#: academico: a full sentence on what the variable is; direto: name and counts only. The other sentences are the same.
TONES = ("academico", "direto")


def narrate(profile: ColumnProfile, lang: str = PT, tone: str = TONES[0]) -> str:
    """One paragraph for a column; empty for identifiers and unsupported columns."""
    if tone not in TONES:
        raise ValueError(f"no templates in the tone {tone!r}; there are {TONES}")
    kind = profile.inferred_type.subtype
    if lang not in KINDS:
        raise ValueError(f"no templates for {lang!r}; there are {sorted(KINDS)}")
    if kind is None:
        return ""
    pt = lang == PT
    n, missing = profile.quality.get("n", 0), profile.quality.get("n_missing", 0)
    name, f, p = profile.name, lambda x, d=None: figure(x, lang, d), lambda x: percent(x, lang)
    gone = ("sem valores ausentes" if pt else "without missing values") if not missing else (
        f"com {f(missing)} valores ausentes" if pt else f"with {f(missing)} missing values"
    )
    out = [
        f"A variável {name} é {KINDS[PT][kind.value]}, observada em {f(n)} registros, {gone}." if pt else f"The variable {name} is {KINDS[EN][kind.value]}, observed in {f(n)} records, {gone}."
    ]
    if tone == "direto":
        out = [f"{name}: {f(n)} registros, {gone}." if pt else f"{name}: {f(n)} records, {gone}."]
    s = profile.summary.get("essential", {}) | profile.summary.get("complete", {})
    if kind in (S.BINARY, S.NOMINAL, S.ORDINAL) and s.get("levels"):
        rows = [r for r in s["levels"] if r["level"] != "(missing)" and r["level"] != "Others"]
        if rows:
            top = max(rows, key=lambda r: (r["n"]))
            share = top.get("of_total", top.get("share"))
            out.append(
                f"O nível predominante é {top['level']}, presente em {f(top['n'])} registros ({p(share)} do total)." if pt else f"The predominant level is {top['level']}, found in {f(top['n'])} records ({p(share)} of the total)."
            )
            if kind is S.BINARY and len(rows) == 2:
                o = next(r for r in rows if r is not top)
                out.append(
                    f"{o['level']} corresponde a {f(o['n'])} registros ({p(o['of_total'])})." if pt else f"{o['level']} accounts for {f(o['n'])} records ({p(o['of_total'])})."
                )
        if kind is S.ORDINAL and s.get("median") is not None:
            out.append(f"A categoria mediana é {s['median']}." if pt else f"The median category is {s['median']}.")
        if s.get("concentration"):
            c = {r["percent"]: r["levels"] for r in s["concentration"]}
            out.append(
                f"São {f(s['k'])} níveis distintos, e {f(c[80])} deles concentram 80% dos registros." if pt else f"There are {f(s['k'])} different levels, and {f(c[80])} of them hold 80% of the records."
            )
    if kind is S.NOMINAL and s.get("median_length") is not None:
        out.append(
            f"Os textos têm de {f(int(s['min_length']))} a {f(int(s['max_length']))} caracteres, com mediana {f(s['median_length'], 1)}." if pt else f"The texts have {f(int(s['min_length']))} to {f(int(s['max_length']))} characters, with median {f(s['median_length'], 1)}."
        )
        if (s.get("dominant") or {}).get("pattern"):
            d = s["dominant"]
            out.append(
                f"O formato {d['pattern']} aparece em {f(d['n'])} deles ({p(d['share'])})." if pt else f"The format {d['pattern']} is found in {f(d['n'])} of them ({p(d['share'])})."
            )
        if (s.get("disguised") or {}).get("disguised"):
            out.append(
                f"{f(s['disguised']['disguised'])} valores representam ausência." if pt else f"{f(s['disguised']['disguised'])} values stand for a missing one."
            )
    if kind is S.DURATION and s.get("unit"):
        out.append(
            f"A duração mediana é {f(s['median_in_unit'], 2)} {s['unit']}." if pt else f"The median duration is {f(s['median_in_unit'], 2)} {s['unit']}."
        )
        if s.get("n_negative"):
            out.append(f"{f(s['n_negative'])} durações são negativas." if pt else f"{f(s['n_negative'])} durations are negative.")
    if kind in (S.DISCRETE, S.CONTINUOUS, S.DURATION) and s.get("mean") is not None:
        mean, median = s["mean"], s["median"]
        out.append(
            f"Varia de {f(s['min'])} a {f(s['max'])}, com média {f(mean, 2)} e mediana {f(median, 2)}." if pt else f"It ranges from {f(s['min'])} to {f(s['max'])}, with mean {f(mean, 2)} and median {f(median, 2)}."
        )
        if mean > median:
            out.append(
                "A média supera a mediana: os valores altos a elevam, e a mediana representa melhor o caso típico." if pt else "The mean exceeds the median: high values raise it, and the median stands better for the typical case."
            )
        elif mean < median:
            out.append("A média fica abaixo da mediana: os valores baixos a reduzem." if pt else "The mean lies below the median: low values reduce it.")
        if s.get("outliers") is not None and kind is not S.DISCRETE:
            out.append(
                f"Pela regra de 1,5×IQR, {f(s['outliers'])} observações ({p(s['outlier_share'] or 0.0)}) são atípicas." if pt else f"By the 1.5×IQR rule, {f(s['outliers'])} observations ({p(s['outlier_share'] or 0.0)}) are atypical."
            )
    if kind is S.INSTANT and s.get("first") is not None:
        out.append(f"Cobre de {s['first']} a {s['last']}." if pt else f"It covers {s['first']} to {s['last']}.")
        if s.get("future"):
            out.append(f"{f(s['future'])} instantes estão no futuro." if pt else f"{f(s['future'])} instants lie in the future.")
    return " ".join(out)


NUMBER = re.compile(r"\d+(?:[.,]\d+)*")


def numbers_kept(template: str, other: str) -> bool:
    """Whether each number of the template stands unchanged, and as often, in the other text."""
    return Counter(NUMBER.findall(template)) == Counter(NUMBER.findall(other))


def rephrased(template: str, rephrase: Callable[[str], str] | None) -> str:
    """The text as a local model rephrases it, or the template with a warning if that changed a number."""
    if rephrase is None:
        return template
    text = rephrase(template)
    if numbers_kept(template, text):
        return text
    warnings.warn("a rephrased text changed numbers; the template is used", stacklevel=2)
    return template
