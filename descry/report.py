"""A page of HTML from a profile; nothing is computed here."""

from __future__ import annotations

from html import escape
from typing import Any

from descry.profiles import DatasetProfile

# The colours and fonts of the visual identity.
COLOURS = {
    "background": "#0A0E1A",
    "panel": "#101828",
    "highlight": "#00E5FF",
    "text": "#E6F7FF",
    "action": "#FF2E88",
    "decision": "#9D4EDD",
    "border": "#3A4A63",
    "secondary": "#8FA3BF",
    "warning": "#FFB03A",
    "success": "#3DF5C6",
    "error": "#FF4757",
}
DISPLAY, BODY, MONO = '"Rajdhani", "Segoe UI", sans-serif', '"Space Grotesk", "Segoe UI", sans-serif', '"JetBrains Mono", Consolas, monospace'
RULES = {
    "body": f"font:15px/1.5 {BODY};margin:2rem auto;max-width:60rem;background:{COLOURS['background']};color:{COLOURS['text']}",
    "h1,h2,h4": f"font-family:{DISPLAY};color:{COLOURS['highlight']}",
    "section": f"background:{COLOURS['panel']};border:1px solid {COLOURS['border']};border-radius:6px;padding:1rem 1.5rem;margin:1rem 0",
    "table": f"border-collapse:collapse;margin:.5rem 0;font-family:{MONO};font-size:13px",
    "td,th": f"border-bottom:1px solid {COLOURS['border']};padding:.15rem .8rem;text-align:left",
    "th,summary,.charts": f"color:{COLOURS['secondary']}",
    ".bar": f"background:{COLOURS['highlight']};height:.7rem;display:inline-block",
    ".route": f"color:{COLOURS['decision']}",
    ".warning": f"color:{COLOURS['warning']}",
}
STYLE = "".join(f"{name}{{{rule}}}" for name, rule in RULES.items())


def cell(x: Any) -> str:
    return "" if x is None else escape(f"{x:,.4g}" if isinstance(x, float) else str(x))


def table(rows: list[dict]) -> str:
    if not rows:
        return ""
    names = list(rows[0])
    top = max((r.get("n") or 0 for r in rows), default=0)
    bar = lambda r: f"<td><span class=bar style='width:{100 * (r.get('n') or 0) / top:.0f}px'></span></td>" if top else ""
    return "<table><tr>" + "".join(f"<th>{escape(n)}</th>" for n in names) + "</tr>" + "".join(
        "<tr>" + "".join(f"<td>{cell(r.get(n))}</td>" for n in names) + bar(r) + "</tr>" for r in rows
    ) + "</table>"


def html(profile: DatasetProfile) -> str:
    parts = [f"<!doctype html><meta charset=utf-8><title>Profile</title><style>{STYLE}</style><h1>{profile.n_rows:,} rows, {len(profile.columns)} columns</h1>"]
    for c in profile.columns.values():
        parts.append(f"<section><h2>{escape(c.name)} <small class=route>{escape(c.inferred_type.route)}</small></h2>")
        if c.narrative:
            parts.append(f"<p>{escape(c.narrative)}</p>")
        for layer, stats in ({"quality": c.quality} | c.summary).items():
            plain = {k: v for k, v in stats.items() if not isinstance(v, list)}
            parts.append(
                f"<details{' open' if layer == 'essential' else ''}><summary>{escape(layer)}</summary>" + table([{"stat": k, "value": v} for k, v in plain.items()])
            )
            parts += [f"<h4>{escape(k)}</h4>{table(v)}" for k, v in stats.items() if isinstance(v, list) and v and isinstance(v[0], dict)]
            parts.append("</details>")
        parts += [f"<p class=warning>{escape(x)}</p>" for x in [*c.notes, *c.inferred_type.warnings]]
        if c.viz_suggestions:
            parts.append("<p class=charts>Charts: " + ", ".join(f"{escape(v.chart)} ({escape(v.reason)})" for v in c.viz_suggestions) + "</p>")
        parts.append("</section>")
    return "".join(parts)
