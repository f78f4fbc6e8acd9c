"""The facade: one table, its history of transforms, its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators import codegen, drift, interactions, leakage, narrate, profile, readiness, recommend, temporal, transforms
from assay.plans.kinds import kinds, of_kind, type_family
from assay.report import drift_html, profile_html
from assay.sources.readers import Dataset
from assay.sources.writers import write_csv, write_excel, write_text


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def analyze(df: DataFrame, target: str | None = None) -> dict:
    """Every section of a profile as plain values. The table is kept in memory while it is read several times."""
    df = df.persist()
    try:
        found = kinds(df)
        numbers, strings = of_kind(found, "numeric"), of_kind(found, "categorical", "boolean")
        times, texts = of_kind(found, "datetime"), of_kind(found, "text")
        flat = [f.name for f in df.schema if type_family(f.dataType) != "nested"]
        out = {
            "overview": profile.overview(df).first().asDict(), "kinds": found, "columns": _rows(profile.column_meta(df, target, found)), "missing": _rows(profile.missing_profile(df)),
            "outliers": _rows(profile.iqr_outliers(df, numbers)) if numbers else [], "univariate_numeric": _rows(profile.univariate_numeric(df, numbers)) if numbers else [],
            "histograms": _rows(profile.histogram(df, numbers)) if numbers else [], "univariate_categorical": _rows(profile.univariate_categorical(df, strings)) if strings else [],
            "top_categories": _rows(profile.top_categories(df, strings)) if strings else [], "strong_pairs": _rows(profile.strong_pairs(df, numbers)) if len(numbers) > 1 else [],
            "covariance": _rows(profile.covariance_matrix(df, numbers)) if numbers else [], "normality": _rows(profile.normality(df, numbers)) if numbers else [],
            "skewness": _rows(profile.skew_kurt(df, numbers)) if numbers else [], "variance": _rows(profile.variance_rank(df, numbers)) if numbers else [],
            "datetime": _rows(profile.datetime_ranges(df, times)) if times else [], "datetime_parts": _rows(profile.datetime_parts(df, times)) if times else [],
            "text": _rows(profile.text_lengths(df, texts)) if texts else [], "chi_square": _rows(profile.chi_square(df, [(a, b) for i, a in enumerate(strings[:5]) for b in strings[i + 1 : 5]])) if len(strings) > 1 else [],
            "problem_type": profile.problem_type(df, target).first().asDict(), "recommendations": _rows(recommend.recommendations(df, target)), "temporal": _rows(temporal.temporal_awareness(df, target)),
        }
        try:
            out["pca"] = _rows(profile.pca_ratio(df, numbers))
        except ValueError as e:
            out["pca"], out["pca_error"] = [], str(e)
        if target is not None:
            out["class_balance"] = _rows(profile.class_balance(df, target))
            if target in numbers and len(numbers) > 1:
                out["feature_target"] = _rows(profile.target_correlations(df, numbers, target, 12))
        keyed = df.select(*flat).withColumn("__row", F.xxhash64(*[F.col(f"`{c}`") for c in flat]))
        scores = interactions.pair_scores(keyed, "__row", target, max_cols=20).cache()
        out["interactions"] = {"pairs": _rows(scores.limit(15)), "groups": interactions.redundancy_groups(scores), "summary": interactions.summary(scores)}
        scores.unpersist()
        graded = readiness.column_scores(df, target, found).cache()
        out["readiness"] = {**readiness.dataset_score(graded).first().asDict(), "columns": [{**r, "verdicts": readiness.verdicts(r)} for r in _rows(graded)], "extremes": _rows(readiness.extremes(graded))}
        graded.unpersist()
        out["leakage"] = leakage.report(df, target)
        out["narrative"] = narrate.everything(out)
        return out
    finally:
        df.unpersist()


class Session:
    """Profile, grade, compare and transform one table.

    >>> s = Session(spark, "churn.parquet", target="churn")
    >>> s.apply("drop_duplicates").apply("impute_median").apply("cap_outliers")
    >>> s.compare("report.html")
    """

    def __init__(self, spark: SparkSession, data, name: str | None = None, target: str | None = None, **options):
        self.spark, self.dataset = spark, Dataset.load(spark, data, name, target, **options)
        self.target, self._current = target, self.dataset.df
        self._history: list[dict] = []
        self._before: dict | None = None
        self._after: dict | None = None

    def __repr__(self) -> str:
        return f"Session({self.dataset.name!r}, {len(self._current.columns)} columns, target={self.target!r}, {len(self._history)} steps)"

    def analyze(self) -> dict:
        self._after = analyze(self._current, self.target)
        self._before = self._before or self._after
        return self._after

    def profile(self, output: str = "profile.html") -> str:
        self._before = analyze(self._current, self.target)
        return write_text(output, profile_html(self.dataset.name, self._before, None, self._history))

    def compare(self, output: str = "compare.html") -> str:
        """The table as it was loaded beside the table as it is now."""
        before, after = analyze(self.dataset.df, self.target), analyze(self._current, self.target)
        return write_text(output, profile_html(self.dataset.name, before, after, self._history))

    def recommend(self) -> list[dict]:
        return _rows(recommend.recommendations(self._current, self.target))

    def apply(self, action: str, columns: list[str] | None = None, **options) -> Session:
        """Apply an action, lazily. Without columns those of the last recommendation that offers it are used, if an
        analysis of the table as it is now exists; a new analysis is needed after each step."""
        if columns is None and self._after:
            for r in self._after["recommendations"]:
                if action in r["actions"] and r["affected"]:
                    columns = [c for c in r["affected"] if c in self._current.columns]
        before = self._current.columns
        self._current = transforms.apply(self._current, action, columns, self.target, **options)
        after = self._current.columns
        self._history.append({"step": len(self._history) + 1, "action": action, "columns": columns, "added": [c for c in after if c not in before], "removed": [c for c in before if c not in after]})
        self._after = None
        return self

    def pipeline_summary(self, count: bool = False) -> list[dict]:
        """The steps so far; ``count`` adds the row counts of the table as loaded and as it is now, a job each."""
        if not count:
            return list(self._history)
        return [*self._history, {"rows_loaded": self.dataset.df.count(), "rows_now": self._current.count()}]

    def reset(self) -> Session:
        self._current, self._history, self._before, self._after = self.dataset.df, [], None, None
        return self

    def drift(self, other, output: str | None = None, buckets: int = 10) -> dict:
        new = Dataset.load(self.spark, other).df
        found = drift.report(self._current, new, self.target, buckets)
        if output:
            write_text(output, drift_html(self.dataset.name, found))
        return found

    def readiness_score(self) -> dict:
        scores = readiness.column_scores(self._current, self.target)
        return {**readiness.dataset_score(scores).first().asDict(), "columns": _rows(scores), "extremes": _rows(readiness.extremes(scores))}

    def leakage_report(self, **options) -> dict:
        return leakage.report(self._current, self.target, **options)

    def generate_pipeline_code(self, problem_type: str | None = None) -> str:
        return codegen.generate(self._after or self.analyze(), self.target, problem_type, self.dataset.source or "data.parquet")

    def export_pipeline_code(self, path: str = "pipeline.py", problem_type: str | None = None) -> str:
        return write_text(path, self.generate_pipeline_code(problem_type))

    def get_dataframe(self) -> DataFrame:
        return self._current

    def export_csv(self, path: str = "cleaned.csv", single: bool = True) -> str:
        return write_csv(self._current, path, single)

    def export_excel(self, path: str = "cleaned.xlsx") -> str:
        return write_excel(self._current, path)
