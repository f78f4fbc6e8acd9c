"""Readiness grades: seven dimensions of 0 to 100 points per column, weighted into a total and a letter."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.exprs import above, band, count_where, kurtosis, pearson, ratio, real, skewness
from assay.operators.leakage import tokens
from assay.operators.profile import fences, numeric_columns
from assay.plans.kinds import kinds, type_family
from assay.plans.statplan import cardinalities, per_number

#: Weights of the dimensions, grades, points. The weights sum to 9.
WEIGHTS = {"completeness": 2.5, "leakage_risk": 2.0, "outlier_severity": 1.5, "distribution": 1.0, "cardinality": 1.0, "type_fitness": 0.8, "consistency": 0.2}
GRADES = [(90, "A"), (75, "B"), (60, "C"), (45, "D")]
TYPE_POINTS = {"boolean": 100.0, "numeric": 95.0, "categorical": 80.0, "datetime": 68.0, "text": 32.0}
ID_NAMES = re.compile(r"^(id|uuid|key|index|rowid|row_id|record_id|pk|primary_key|seq|sequence)$", re.I)
COLOURS = {"A": "#22c55e", "B": "#84cc16", "C": "#f59e0b", "D": "#f97316", "F": "#ef4444"}
LABELS = {"A": "Production-ready", "B": "Minor prep needed", "C": "Moderate prep needed", "D": "Significant issues", "F": "Critical — fix before training"}
NUMERIC_WEIGHT = 1.5


def grade(total: Column) -> Column:
    return above(total, [(t, g) for t, g in GRADES], "F", strict=False)


def label(letter: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[letter]


def name_risk(column: str, target: str | None) -> float:
    """Points of risk that a column's name alone carries."""
    if not target or column == target:
        return 0.0
    c, t = column.lower(), target.lower()
    risk = 98.0 if c == t else 82.0 if t in c or c in t else 50.0 if tokens(c) & tokens(t) else 0.0
    return max(risk, 72.0) if ID_NAMES.search(column) else risk


def column_scores(df: DataFrame, target: str | None = None, found: dict[str, str] | None = None) -> DataFrame:
    """One row per column that isn't nested: kind, the seven dimensions, total, grade, missing share, distinct values.

    The frequencies of every type's columns, which also tell text from categories, the fences, and one aggregate over the
    numbers' cells. A column of nulls only has no values to be inconsistent or skewed; an empty table scores its columns
    as complete.
    """
    names = [f.name for f in df.schema if type_family(f.dataType) != "nested"]
    counted = {r["column"]: (r["count"], r["n_unique"], r["top_n"], r["n_rows"]) for r in cardinalities(df, names).collect()}  # a row per column
    found = found or kinds(df, counted)
    numbers = sorted(numeric_columns(df))
    limits = fences(df, numbers, moments=False) if numbers else {}
    shapes = {}
    if numbers:
        x, y = F.col("x"), real(target) if target in numbers else None
        lo, hi = ({c: limits[c][i] if c in limits else 0.0 for c in numbers} for i in (2, 3))
        atoms = {"skew": skewness(x), "kurt": kurtosis(x), "r": F.abs(pearson(x, F.col("y"))) if y is not None else F.lit(None).cast("double"), "out": count_where((x < F.col("lo")) | (x > F.col("hi")))}
        shapes = {r["column"]: r for r in per_number(df, numbers, atoms, {"lo": lo, "hi": hi}, y, ("out",)).collect()}

    def row(c: str) -> Column:
        count, unique, top, rows = counted.get(c, (0, 0, 0, 0))
        got, wide = shapes.get(c), c in limits and limits[c][1] > limits[c][0]
        number = lambda k, kind: F.lit(k).cast(kind)
        return F.struct(
            F.lit(c).alias("column"), F.lit(found[c]).alias("kind"), number(rows - count, "long").alias("missing"), number(rows, "long").alias("rows"), *[number(got and got[k], "double").alias(k) for k in ("skew", "kurt")],
            number(got["r"] if got and c != target else None, "double").alias("r"), number(got["out"] if got and wide else -1, "long").alias("out"), F.lit(name_risk(c, target)).alias("risk"), F.lit(c == target).alias("is_target"),
            *[number(v, "long").alias(k) for k, v in (("count", count), ("n_unique", unique), ("top_n", top))],
        )

    s = df.sparkSession.range(1).select(F.inline(F.array(*map(row, names))))
    kind, n = F.col("kind"), F.col("count")
    gone = F.coalesce(ratio(F.col("missing") * 100.0, F.col("rows")), F.lit(0.0))
    numeric = kind == "numeric"
    skew = band(F.abs("skew"), [(0.5, 70.0), (1, 60.0), (2, 42.0), (3, 22.0)], 10.0)
    kurt = band(F.abs(F.coalesce("kurt", F.lit(0.0))), [(1, 30.0), (3, 24.0), (7, 16.0)], 8.0)
    unique = F.col("n_unique")
    by_count = F.when(unique == 1, 20.0).when(unique == 2, 100.0).when(unique <= 10, 95.0).when(unique <= 20, 82.0).when(unique <= 50, 65.0).when(unique <= 100, 45.0)
    by_count = by_count.when(ratio(unique, n) > 0.9, 10.0).otherwise(28.0)
    by_r = F.coalesce(above(F.col("r"), [(0.97, 95.0), (0.9, 78.0), (0.8, 55.0), (0.7, 35.0)], 0.0), F.lit(0.0))
    out = F.when(F.col("out") >= 0, ratio(F.col("out") * 100.0, n))
    top = ratio(F.col("top_n") * 1.0, n)
    points = {
        "completeness": F.when(gone == 0, 100.0).otherwise(band(gone, [(2, 95.0), (5, 88.0), (15, 70.0), (30, 48.0), (50, 22.0)], 5.0)),
        "distribution": F.when(~numeric, 85.0).when(n < 4, 70.0).otherwise(skew + kurt),
        "cardinality": F.when(kind.isin("numeric", "datetime", "boolean"), 95.0).when(kind == "text", 35.0).otherwise(by_count),
        "leakage_risk": F.when(F.col("is_target") | F.lit(target is None), 100.0).otherwise(100.0 - F.greatest("risk", by_r)),
        "outlier_severity": F.when(~numeric, 90.0).when((n < 4) | (F.col("out") < 0), 75.0).when(out == 0, 100.0).otherwise(band(out, [(0.5, 95.0), (1, 88.0), (3, 72.0), (7, 50.0), (15, 28.0)], 10.0)),
        "type_fitness": F.create_map(*[F.lit(x) for kv in TYPE_POINTS.items() for x in kv])[kind],
        "consistency": F.when(n == 0, 50.0).when(top > 0.99, 15.0).when(top > 0.95, 40.0).otherwise(100.0),
    }
    s = s.withColumns(points)
    total = F.round(sum((F.col(d) * w for d, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values()), 1)
    s = s.withColumn("total", total)
    return s.select("column", "kind", *WEIGHTS, "total", grade(F.col("total")).alias("grade"), label(grade(F.col("total"))).alias("label"), gone.alias("missing_pct"), "skew", out.alias("outlier_pct"), "n_unique", "is_target")


def dataset_score(scores: DataFrame) -> DataFrame:
    """One row: weighted score (numeric columns count 1.5 times), grade, mean of every dimension, columns per grade."""
    w = F.when(F.col("kind") == "numeric", NUMERIC_WEIGHT).otherwise(1.0)
    got = scores.agg(
        F.round(ratio(F.sum(F.col("total") * w), F.sum(w)), 1).alias("score"), *[F.round(F.avg(d), 1).alias(d) for d in WEIGHTS], *[count_where(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABCDF"]
    )
    return got.withColumn("grade", grade(F.col("score"))).withColumn("label", label(F.col("grade")))


def extremes(scores: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` worst columns graded D or F and the ``k`` best graded A, the target left out: (list, column, total, grade)."""
    others = scores.where("not is_target")
    worst = others.where("grade in ('D', 'F')").orderBy("total", "column").limit(k).select(F.lit("worst").alias("list"), "column", "total", "grade")
    best = others.where("grade = 'A'").orderBy(F.desc("total"), "column").limit(k).select(F.lit("best").alias("list"), "column", "total", "grade")
    return worst.unionByName(best)


def verdicts(row: dict) -> dict[str, str]:
    """A sentence for each dimension of one column's scores, for readers of a report."""
    m, u, kind = row["missing_pct"], row["n_unique"], row["kind"]
    risk = 100 - row["leakage_risk"]
    return {
        "completeness": "No value is missing." if m == 0 else f"{m:.1f} % of values are missing: " + ("fill them simply." if m < 5 else "fill them by median, mode or neighbours." if m < 15 else "model the gaps or add an indicator." if m < 40 else "consider leaving the column out."),
        "distribution": "Not a number." if kind != "numeric" else "Too few values to tell." if row["skew"] is None else f"Close to symmetric (skewness {row['skew']:.2f})." if abs(row["skew"]) < 0.5 else f"Somewhat skewed ({row['skew']:.2f}); usually fine." if abs(row["skew"]) < 1 else f"Skewed ({row['skew']:.2f}); try a log or power transform." if abs(row["skew"]) < 2 else f"Severely skewed ({row['skew']:.2f}); transform it before fitting linear models.",
        "cardinality": "Free text; needs tokens or embeddings." if kind == "text" else "One value only; carries nothing." if u == 1 else "Two values; ready as it is." if u == 2 else f"{u} values; one-hot encoding is safe." if u <= 10 else f"{u} values; encode by frequency or target." if u <= 50 else f"{u} values; hash or group them." if u <= 200 else f"{u} values; probably an identifier.",
        "leakage_risk": "Tells the target; leave it out." if risk >= 80 else "Much tied to the target; check its origin." if risk >= 55 else "Somewhat tied to the target; watch it." if risk >= 35 else "No sign of leakage.",
        "outlier_severity": "Not a number." if kind != "numeric" else "No spread between the quartiles." if row["outlier_pct"] is None else "No outliers." if row["outlier_pct"] == 0 else f"{row['outlier_pct']:.1f} % outliers; negligible." if row["outlier_pct"] < 1 else f"{row['outlier_pct']:.1f} % outliers; cap them." if row["outlier_pct"] < 5 else f"{row['outlier_pct']:.1f} % outliers; cap, remove or transform.",
        "type_fitness": "Ready for a model." if row["type_fitness"] >= 90 else "Needs a little preparation." if row["type_fitness"] >= 65 else "Needs a transformation first." if row["type_fitness"] >= 45 else "Needs much preparation.",
        "consistency": "Consistent." if row["consistency"] >= 90 else "Nearly constant; tells little." if row["consistency"] >= 50 else "Constant, nearly so or without values.",
    }
