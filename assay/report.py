"""HTML reports: plain tables and inline charts, with the data embedded as JSON."""

from __future__ import annotations

import html
from collections import defaultdict

from assay.sources.writers import bars_svg, embed, table_html

STYLE = "body{font:14px system-ui,sans-serif;margin:2em;max-width:75em}table{border-collapse:collapse;margin:.5em 0}td,th{border:1px solid #ccc;padding:.2em .5em;text-align:left}h2{margin-top:1.5em}.two{display:flex;gap:2em;flex-wrap:wrap}"
SECTIONS = (
    ("Readiness", "readiness"), ("Leakage", "leakage"), ("Interactions", "interactions"), ("Change over time", "temporal"), ("Columns", "columns"), ("Missing values", "missing"), ("Outliers", "outliers"),
    ("Skewness", "skewness"), ("Strong correlations", "strong_pairs"), ("Covariance", "covariance"), ("Numbers", "univariate_numeric"), ("Categories", "univariate_categorical"), ("Most frequent values", "top_categories"),
    ("Normality", "normality"), ("Principal components", "pca"), ("Variance", "variance"), ("Class balance", "class_balance"), ("Features and target", "feature_target"), ("Independence tests", "chi_square"),
    ("Times", "datetime"), ("Parts of times", "datetime_parts"), ("Texts", "text"), ("Recommendations", "recommendations"),
)


def _page(title: str, body: str, data) -> str:
    return f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>{body}<script type='application/json' id='data'>{embed(data)}</script></body></html>"


def _section(key: str, value) -> str:
    if key == "readiness":
        rows = [{k: v for k, v in r.items() if k != "verdicts"} for r in value["columns"]]
        words = "".join(f"<li><b>{html.escape(r['column'])}</b>: {html.escape(' '.join(r['verdicts'].values()))}</li>" for r in value["columns"])
        return f"<p>{value['score']} ({value['grade']})</p>{table_html(rows)}<ul>{words}</ul>"
    if key == "leakage":
        return f"<p>{value['risk']}</p>{table_html(value['columns'])}{table_html(value['findings'])}"
    if key == "interactions":
        return f"<p>{html.escape(value['summary'])}</p>{table_html(value['pairs'])}<p>{html.escape('; '.join(', '.join(g) for g in value['groups']))}</p>"
    return table_html(value)


def _analysis(a: dict) -> str:
    out = ["<ul>", *[f"<li>{html.escape(t)}</li>" for t in a["narrative"].values()], "</ul>", table_html([a["overview"]])]
    charts = defaultdict(list)
    for r in a.get("histograms", []):
        charts[r["column"]].append((f"{r['lower']:.4g}", float(r["n"])))
    for title, key in SECTIONS:
        if a.get(key):
            out.append(f"<h2>{title}</h2>{_section(key, a[key])}")
    out += [f"<h3>{html.escape(c)}</h3>{bars_svg(v)}" for c, v in charts.items()]
    return "".join(out)


def profile_html(name: str, before: dict, after: dict | None, history: list[dict]) -> str:
    """One analysis, or two side by side, with the steps between them."""
    steps = f"<h2>Steps</h2>{table_html(history)}" if history else ""
    if after is None:
        return _page(f"Profile of {name}", steps + _analysis(before), {"before": before, "history": history})
    both = f"<div class='two'><div><h2>Before</h2>{_analysis(before)}</div><div><h2>After</h2>{_analysis(after)}</div></div>"
    return _page(f"Before and after: {name}", steps + both, {"before": before, "after": after, "history": history})


def drift_html(name: str, found: dict) -> str:
    head = {k: v for k, v in found.items() if not isinstance(v, list)}
    keys = sorted({k for r in found["columns"] for k in r}, key=lambda k: (k not in ("column", "psi", "level"), k))
    body = f"<p>{html.escape(found['verdict'])}</p>{table_html([head])}<h2>Columns</h2>{table_html(found['columns'], keys)}<h2>Missing values</h2>{table_html(found['missing'])}<h2>Schema</h2>{table_html(found['schema'])}"
    return _page(f"Drift of {name}", body, found)
