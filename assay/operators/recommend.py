"""Rules that turn a table's statistics into recommended actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.exprs import count_where, ident, missing, skewness
from assay.operators.profile import duplicates, fences
from assay.plans.kinds import kinds, of_kind
from assay.plans.statplan import cardinalities, per_column, per_number

#: What each recommendation offers, its category and severity.
OFFERS = {
    "drop_high_miss": ("Missing Values", "high", ["drop_high_missing", "skip"]),
    "impute_num": ("Missing Values", "medium", ["impute_median", "impute_mean", "impute_knn"]),
    "impute_cat": ("Missing Values", "medium", ["impute_mode", "impute_unknown"]),
    "dups": ("Duplicates", "medium", ["drop_duplicates", "keep_first"]),
    "outliers": ("Outliers", "medium", ["cap_outliers", "remove_outliers", "skip"]),
    "skew": ("Transformation", "low", ["log_transform", "sqrt_transform", "yeo_johnson", "skip"]),
    "scale": ("Scaling", "low", ["scale_standard", "scale_minmax", "scale_robust", "skip"]),
    "enc_low": ("Encoding", "low", ["encode_onehot", "encode_label", "skip"]),
    "enc_high": ("Encoding", "medium", ["encode_frequency", "encode_target", "encode_label", "skip"]),
}


def recommendations(df: DataFrame, target: str | None = None) -> DataFrame:
    """Rows (id, category, severity, affected, actions), in a fixed order.

    The target is never recommended for scaling, skew, outlier handling or encoding.
    """
    found = kinds(df)
    numbers, categories = of_kind(found, "numeric"), of_kind(found, "categorical")
    gone = per_column(df, df.columns, lambda c: {"m": missing(ident(c)), "n": F.count(F.lit(1))}).collect()
    share = {r["column"]: r["m"] / r["n"] if r["n"] else 0.0 for r in gone}
    hit: dict[str, list[str]] = {
        "drop_high_miss": [c for c in df.columns if share[c] > 0.4],
        "impute_num": [c for c in numbers if 0.05 < share[c] <= 0.4],
        "impute_cat": [c for c in categories if 0.05 < share[c] <= 0.4],
    }
    features = [c for c in numbers if c != target]
    if features:
        f, x = fences(df, features, moments=False), F.col("x")
        lo, hi = ({c: f[c][i] if c in f else 0.0 for c in features} for i in (2, 3))
        atoms = {"n": F.count(x), "o": count_where((x < F.col("lo")) | (x > F.col("hi"))), "s": skewness(x), "least": F.min(x)}
        stats = {r["column"]: r for r in per_number(df, features, atoms, {"lo": lo, "hi": hi}, zero=("n", "o")).collect()}
        hit["outliers"] = [c for c in features if c in f and f[c][1] > f[c][0] and stats[c]["n"] >= 4 and stats[c]["o"] / stats[c]["n"] > 0.05]
        hit["skew"] = [c for c in features if stats[c]["n"] > 2 and abs(stats[c]["s"] or 0) > 1.5 and stats[c]["least"] > 0]
        hit["scale"] = features
    encode = [c for c in categories if c != target]
    if encode:
        unique = {r["column"]: r["n_unique"] for r in cardinalities(df, encode).collect()}
        hit["enc_low"] = [c for c in encode if unique.get(c, 0) <= 15]
        hit["enc_high"] = [c for c in encode if unique.get(c, 0) > 15]
    copies = duplicates(df).first()["duplicate_rows"]
    rows = [(k, *OFFERS[k][:2], hit.get(k, []), OFFERS[k][2]) for k in OFFERS if hit.get(k) or (k == "dups" and copies)]
    return df.sparkSession.createDataFrame(rows, "id string, category string, severity string, affected array<string>, actions array<string>")
