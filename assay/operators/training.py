"""Models over a prepared table: regressors, classifiers, clusterings, their metrics, importances and tuning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.exprs import ident, ratio
from assay.operators.profile import problem_type
from assay.plans.kinds import kinds, of_kind

REGRESSORS = {
    "linear": lambda: R.LinearRegression(),
    "ridge": lambda: R.LinearRegression(regParam=1.0, elasticNetParam=0.0),
    "lasso": lambda: R.LinearRegression(regParam=0.1, elasticNetParam=1.0),
    "elastic_net": lambda: R.LinearRegression(regParam=0.1, elasticNetParam=0.5),
    "decision_tree": lambda: R.DecisionTreeRegressor(seed=42),
    "random_forest": lambda: R.RandomForestRegressor(seed=42),
    "gradient_boosting": lambda: R.GBTRegressor(seed=42),
}
CLASSIFIERS = {
    "logistic": lambda: C.LogisticRegression(),
    "decision_tree": lambda: C.DecisionTreeClassifier(seed=42),
    "random_forest": lambda: C.RandomForestClassifier(seed=42),
    "gradient_boosting": lambda: C.GBTClassifier(seed=42),
    "linear_svm": lambda: C.LinearSVC(),
    "naive_bayes": lambda: C.NaiveBayes(modelType="gaussian"),
}
CLUSTERINGS = {"kmeans": lambda k: K.KMeans(k=k, seed=42), "bisecting": lambda k: K.BisectingKMeans(k=k, seed=42), "gaussian_mixture": lambda k: K.GaussianMixture(k=k, seed=42)}
GRIDS = {"regParam": [0.0, 0.1], "maxDepth": [3, 6]}


@dataclass
class Trained:
    model: PipelineModel
    task: str
    metrics: dict
    importances: list[tuple[str, float]]


def prepare(df: DataFrame, target: str | None, onehot: bool = True) -> tuple[list, list[str]]:
    """Pipeline stages to a ``features`` vector: medians, scaled numbers, indexed and encoded categories."""
    found = kinds(df)
    numbers = [c for c in of_kind(found, "numeric") if c != target]
    categories = [c for c in of_kind(found, "categorical") if c != target]
    stages, parts = [], []
    if numbers:
        full = [f"{c}__full" for c in numbers]
        stages += [Imputer(strategy="median", inputCols=numbers, outputCols=full), VectorAssembler(inputCols=full, outputCol="__numbers", handleInvalid="keep"), StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True)]
        parts.append("__scaled")
    if categories:
        index = [f"{c}__index" for c in categories]
        stages.append(StringIndexer(inputCols=categories, outputCols=index, handleInvalid="keep"))
        if onehot:
            stages.append(OneHotEncoder(inputCols=index, outputCols=[f"{c}__onehot" for c in categories], handleInvalid="keep"))
        parts += [f"{c}__onehot" for c in categories] if onehot else index
    if not parts:
        raise ValueError("no numeric or categorical feature")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")], numbers + categories


def _ready(df: DataFrame, target: str | None) -> DataFrame:
    """Numbers as doubles; for classification the label is the rank of the class."""
    numbers = [c for c in of_kind(kinds(df), "numeric") if c != target]
    return df.withColumns({c: ident(c).cast("double") for c in numbers}) if numbers else df


def confusion(scored: DataFrame) -> DataFrame:
    """Rows (label, prediction, n)."""
    return scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")).orderBy("label", "prediction")


def roc(scored: DataFrame, points: int = 100) -> DataFrame:
    """Rows (threshold, tpr, fpr) of a binary model's scores, at most ``points`` thresholds."""
    p = scored.select(F.round(vector_to_array("probability")[1] * points).alias("b"), "label").groupBy("b").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    from pyspark.sql import Window

    w, everything = Window.orderBy(F.desc("b")), Window.partitionBy()
    return p.select((F.col("b") / points).alias("threshold"), ratio(F.sum("pos").over(w), F.sum("pos").over(everything)).alias("tpr"), ratio(F.sum("neg").over(w), F.sum("neg").over(everything)).alias("fpr"))


def train(df: DataFrame, target: str, algorithm: str = "random_forest", task: str | None = None, folds: int = 0, tune: bool = False, test_share: float = 0.2, seed: int = 42) -> Trained:
    """Fit on a seeded split and measure on the rest; ``folds`` cross-validates, ``tune`` searches a small grid."""
    task = task or ("regression" if problem_type(df, target).first()["problem_type"] == "regression" else "classification")
    known = {"regression": REGRESSORS, "classification": CLASSIFIERS}[task]
    if algorithm not in known:
        raise ValueError(f"no {task} algorithm {algorithm!r}; there are {', '.join(known)}")
    rows = _ready(df.where(ident(target).isNotNull()), target)
    stages, names = prepare(rows, target)
    estimator = known[algorithm]().setFeaturesCol("features").setLabelCol("label")
    if task == "regression":
        rows = rows.withColumn("label", ident(target).cast("double"))
        evaluator = RegressionEvaluator(labelCol="label")
    else:
        rows = rows.withColumn("__class", ident(target).cast("string"))
        stages = [StringIndexer(inputCol="__class", outputCol="label", handleInvalid="skip"), *stages]
        evaluator = MulticlassClassificationEvaluator(labelCol="label", metricName="f1")
    fit, test = rows.randomSplit([1 - test_share, test_share], seed=seed)
    pipeline, metrics = Pipeline(stages=[*stages, estimator]), {}
    if folds or tune:
        grid = ParamGridBuilder()
        for name, values in GRIDS.items():
            if tune and estimator.hasParam(name):
                grid = grid.addGrid(estimator.getParam(name), values)
        search = CrossValidator(estimator=pipeline, estimatorParamMaps=grid.build(), evaluator=evaluator, numFolds=folds or 3, seed=seed, parallelism=2).fit(fit)
        model, metrics["cross_validated"] = search.bestModel, max(search.avgMetrics) if evaluator.isLargerBetter() else min(search.avgMetrics)
    else:
        model = pipeline.fit(fit)
    scored = model.transform(test)
    if task == "regression":
        metrics |= {m: evaluator.setMetricName(m).evaluate(scored) for m in ("rmse", "mae", "r2")}
    else:
        metrics |= {m: evaluator.setMetricName(m).evaluate(scored) for m in ("accuracy", "weightedPrecision", "weightedRecall", "f1")}
        metrics["confusion"] = [r.asDict() for r in confusion(scored).collect()]
        if "rawPrediction" in scored.columns and len(model.stages[0].labels) == 2:
            metrics["auc"] = BinaryClassificationEvaluator(labelCol="label").evaluate(scored)
    return Trained(model, task, metrics, importances(model, scored))


def importances(model: PipelineModel, scored: DataFrame) -> list[tuple[str, float]]:
    """Tree importances, or absolute coefficients, by feature, the largest first."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficients"):
        try:
            values = abs(last.coefficients.toArray())
        except Exception:  # a multinomial model has a matrix
            values = abs(last.coefficientMatrix.toArray()).max(axis=0)
    else:
        return []
    attributes = scored.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a.get("name", str(a["idx"])) for group in attributes.values() for a in group}
    return sorted(((names.get(i, str(i)), float(v)) for i, v in enumerate(values)), key=lambda x: (-x[1], x[0]))


def cluster(df: DataFrame, algorithm: str = "kmeans", k: int = 3) -> tuple[PipelineModel, dict]:
    """Clusters of all rows, with silhouette, Davies-Bouldin index and sizes."""
    rows = _ready(df, None)
    stages, _ = prepare(rows, None)
    model = Pipeline(stages=[*stages, CLUSTERINGS[algorithm](k)]).fit(rows)
    scored = model.transform(rows).select("features", "prediction").persist()
    try:
        sizes = {r["prediction"]: r["count"] for r in scored.groupBy("prediction").count().collect()}
        metrics = {"sizes": sizes, "silhouette": ClusteringEvaluator().evaluate(scored) if len(sizes) > 1 else None, "davies_bouldin": davies_bouldin(scored)}
        return model, metrics
    finally:
        scored.unpersist()


def davies_bouldin(scored: DataFrame) -> float | None:
    """Mean over clusters of the worst ratio of spread to distance, from one aggregate for centres and one for spreads."""
    import numpy as np

    x = scored.select("prediction", F.posexplode(vector_to_array("features")).alias("i", "v"))
    centres: dict[int, dict[int, float]] = {}
    for r in x.groupBy("prediction", "i").agg(F.avg("v").alias("m")).collect():
        centres.setdefault(r["prediction"], {})[r["i"]] = r["m"]
    if len(centres) < 2:
        return None
    names = sorted(centres)
    points = np.array([[centres[n][i] for i in sorted(centres[n])] for n in names])
    table = F.create_map(*[y for n, p in zip(names, points, strict=True) for y in (F.lit(n), F.array(*map(F.lit, p.tolist())))])
    gap = F.sqrt(F.aggregate(F.zip_with(vector_to_array("features"), table[F.col("prediction")], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    spread = {r["prediction"]: r["s"] for r in scored.groupBy("prediction").agg(F.avg(gap).alias("s")).collect()}
    s = np.array([spread[n] for n in names])
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    np.fill_diagonal(d, np.inf)
    return float(((s[:, None] + s[None]) / d).max(axis=1).mean())
