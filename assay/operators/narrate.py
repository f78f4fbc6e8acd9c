"""Sentences about a profile, one function per section."""

from __future__ import annotations


def _list(names, most: int = 5) -> str:
    names = list(names)
    return ", ".join(names[:most]) + (f" and {len(names) - most} more" if len(names) > most else "")


def overview(a: dict) -> str:
    o = a["overview"]
    size = "small" if o["n_rows"] < 1_000 else "medium" if o["n_rows"] < 50_000 else "large"
    return f"A {size} table of {o['n_rows']:,} rows and {o['n_columns']} columns; {o['missing_pct']:.1f} % of its cells are missing."


def missing(a: dict) -> str:
    m = a["missing"]
    if not m:
        return "No column has missing values."
    high = [r["column"] for r in m if r["severity"] == "high"]
    return f"{len(m)} columns have missing values" + (f"; more than 40 % are missing in {_list(high)}." if high else ", none of them more than 40 %.")


def duplicates(a: dict) -> str:
    n = a["overview"]["duplicate_rows"]
    return f"{n:,} rows are copies of others ({a['overview']['duplicate_pct']:.1f} %)." if n else "No row is a copy of another."


def outliers(a: dict) -> str:
    hit = [r for r in a["outliers"] if r["iqr_pct"] > 5]
    return f"More than 5 % of values lie outside the fences in {_list(r['column'] for r in hit)}." if hit else "No column has more than 5 % of outliers."


def correlations(a: dict) -> str:
    p = a["strong_pairs"]
    return f"{len(p)} pairs are strongly correlated, most of all {p[0]['a']} and {p[0]['b']} (r = {p[0]['r']:.2f})." if p else "No pair of numeric columns is strongly correlated."


def class_imbalance(a: dict) -> str:
    c = a.get("class_balance") or []
    if not c:
        return "There is no target, or it has no values."
    return f"The largest class has {c[0]['imbalance_ratio']:.1f} times the rows of the smallest" + ("; weight or resample." if c[0]["is_imbalanced"] else "; balanced enough.")


def pca(a: dict) -> str:
    p = a.get("pca") or []
    k = next((r["component"] for r in p if r["enough"]), None)
    return f"{k} components carry 95 % of the variance or all that there is." if k else "Principal components need two numeric columns and four complete rows."


def skewness(a: dict) -> str:
    s = [r["column"] for r in a["skewness"] if r["needs_transform"]]
    return f"Strongly skewed: {_list(s)}." if s else "No column is strongly skewed."


def readiness(a: dict) -> str:
    r = a["readiness"]
    return f"Readiness {r['score']:.1f}, grade {r['grade']}." if r["score"] is not None else "There is no column to grade."


def leakage(a: dict) -> str:
    r = a["leakage"]
    return f"Leakage risk is {r['risk']}: look at {_list(c['column'] for c in r['columns'])}." if r["columns"] else "No sign of leakage."


def interactions(a: dict) -> str:
    return a["interactions"]["summary"]


def temporal(a: dict) -> str:
    t = [r for r in a["temporal"] if r["drifted"]]
    return f"Means move over time in {_list(r['column'] for r in t)}." if t else "No mean moves much over time."


def problem(a: dict) -> str:
    p = a["problem_type"]
    return "No target is given." if p["problem_type"] == "unknown" else f"The target poses a {p['problem_type']} problem ({p['confidence']} confidence)."


SECTIONS = (overview, missing, duplicates, outliers, correlations, class_imbalance, pca, skewness, readiness, leakage, interactions, temporal, problem)


def everything(analysis: dict) -> dict[str, str]:
    return {f.__name__: f(analysis) for f in SECTIONS}
