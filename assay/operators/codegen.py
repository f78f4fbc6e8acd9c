"""A ready-to-run ``pyspark.ml`` script for the table that was analysed."""

from __future__ import annotations

import ast

ONE_HOT, ORDINAL = 15, 100


def decide(analysis: dict, target: str | None, problem: str | None = None) -> dict:
    """Which column gets which treatment, from an analysis of ``session.Session.analyze``."""
    problem = problem or analysis["problem_type"]["problem_type"]
    meta = {r["column"]: r for r in analysis["columns"] if r["column"] != target}
    dropped = [c for c, r in meta.items() if r["kind"] in ("text", "datetime", "nested") or r["missing_pct"] > 40]
    numbers = [c for c, r in meta.items() if r["kind"] == "numeric" and c not in dropped]
    categories = [c for c, r in meta.items() if r["kind"] in ("categorical", "boolean") and c not in dropped]
    skewed = [r["column"] for r in analysis["skewness"] if abs(r["skewness"] or 0) > 1.5 and r["column"] in numbers]
    heavy = [r["column"] for r in analysis["outliers"] if r["iqr_pct"] > 5 and r["column"] in numbers]
    gaps = [c for c in numbers if meta[c]["missing_pct"] > 0]
    balance = analysis.get("class_balance") or []
    return {
        "problem": "regression" if problem == "regression" else "classification", "dropped": dropped, "numbers": numbers, "skewed": skewed,
        "onehot": [c for c in categories if meta[c]["n_unique"] <= ONE_HOT], "ordinal": [c for c in categories if ONE_HOT < meta[c]["n_unique"] <= ORDINAL],
        "frequency": [c for c in categories if meta[c]["n_unique"] > ORDINAL], "robust": bool(numbers) and len(heavy) > 0.3 * len(numbers), "knn": 1 <= len(gaps) <= 5,
        "binary": len(balance) == 2, "imbalanced": bool(balance) and balance[0]["is_imbalanced"] and problem != "regression",
    }


def generate(analysis: dict, target: str | None, problem: str | None = None, path: str = "data.parquet") -> str:
    """The script; it is parsed before it is returned, so it is always valid Python."""
    d = decide(analysis, target, problem)
    regression = d["problem"] == "regression"
    target = target or "target"
    model = "RandomForestRegressor" if regression else "RandomForestClassifier"
    others = "GBTRegressor, LinearRegression" if regression else "GBTClassifier, LogisticRegression"
    metric = 'RegressionEvaluator(labelCol="label", metricName="rmse")' if regression else ('BinaryClassificationEvaluator(labelCol="label")' if d["binary"] else 'MulticlassClassificationEvaluator(labelCol="label", metricName="f1")')
    scaler = "RobustScaler" if d["robust"] else "StandardScaler"
    weight = ', weightCol="weight"' if d["imbalanced"] else ""
    blocks = [
        f'"""Training pipeline for target {target!r} ({d["problem"]})."""',
        "from pyspark.ml import Pipeline\n"
        f"from pyspark.ml.{'regression' if regression else 'classification'} import {model}, {others}\n"
        "from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator\n"
        f"from pyspark.ml.feature import Imputer, OneHotEncoder, {scaler}, StringIndexer, VectorAssembler\n"
        "from pyspark.ml.tuning import CrossValidator, ParamGridBuilder\nfrom pyspark.sql import SparkSession, functions as F",
        "\n".join(f"{k.upper()} = {d[k]!r}" for k in ("dropped", "numbers", "skewed", "onehot", "ordinal", "frequency")) + f"\nTARGET = {target!r}",
        f'spark = SparkSession.builder.getOrCreate()\ndf = spark.read.parquet({path!r}).drop(*DROPPED).where(F.col(f"`{{TARGET}}`").isNotNull())',
        "# Skewed numbers on a log scale; all numbers as doubles.\nfor c in NUMBERS:\n    x = F.col(f'`{c}`').cast('double')\n    df = df.withColumn(c, F.log1p(F.greatest(x, F.lit(0.0))) if c in SKEWED else x)",
        "df = df.fillna('missing', [c for c, t in df.dtypes if c in ONEHOT + ORDINAL and t == 'string'])\nfor c, t in df.dtypes:\n    if c in ONEHOT + ORDINAL and t == 'boolean':\n        df = df.withColumn(c, F.coalesce(F.col(c).cast('string'), F.lit('missing')))",
        ("df = df.withColumn('label', F.col(TARGET).cast('double'))" if regression else "labels = StringIndexer(inputCol=TARGET, outputCol='label', handleInvalid='skip').fit(df)\ndf = labels.transform(df)"),
        "# Everything learned from here on is learned from the training rows only.\ntrain, test = df.randomSplit([0.8, 0.2], seed=42)",
        "# Categories of many values by their frequency.\nfor c in FREQUENCY:\n    n = train.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias('n'))\n    total = n.agg(F.sum('n')).first()[0] or 1\n    shares = n.select(c, (F.col('n') / total).alias(f'{c}_frequency'))\n    train, test = (d.join(shares, c, 'left').fillna(0.0, [f'{c}_frequency']) for d in (train, test))",
        ("counts = {r['label']: r['count'] for r in train.groupBy('label').count().collect()}\ntotal = sum(counts.values())\nweights = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, total / (len(counts) * n))])\ntrain = train.withColumn('weight', F.coalesce(weights[F.col('label')], F.lit(1.0)))" if d["imbalanced"] else "# The classes are balanced, or there are none; no row weights."),
        "stages, features = [], [f'{c}_frequency' for c in FREQUENCY]\nif NUMBERS:\n" + ("    # Few columns have gaps: nearest-neighbour imputation before this script may do better than the median.\n" if d["knn"] else "")
        + f"    stages += [Imputer(strategy='median', inputCols=NUMBERS, outputCols=[f'{{c}}_full' for c in NUMBERS]), VectorAssembler(inputCols=[f'{{c}}_full' for c in NUMBERS], outputCol='numbers', handleInvalid='keep'), {scaler}(inputCol='numbers', outputCol='scaled', {'withCentering' if d['robust'] else 'withMean'}=True)]\n    features.append('scaled')",
        "if ONEHOT or ORDINAL:\n    cs = ONEHOT + ORDINAL\n    stages.append(StringIndexer(inputCols=cs, outputCols=[f'{c}_index' for c in cs], handleInvalid='keep'))\n    features += [f'{c}_index' for c in ORDINAL]\nif ONEHOT:\n    stages.append(OneHotEncoder(inputCols=[f'{c}_index' for c in ONEHOT], outputCols=[f'{c}_onehot' for c in ONEHOT], handleInvalid='keep'))\n    features += [f'{c}_onehot' for c in ONEHOT]",
        f"stages.append(VectorAssembler(inputCols=features, outputCol='features', handleInvalid='keep'))\nmodel = {model}(labelCol='label', featuresCol='features', seed=42{weight})\n# Others to try: {others}\npipeline = Pipeline(stages=[*stages, model])",
        f"evaluator = {metric}\ngrid = ParamGridBuilder().addGrid(model.maxDepth, [5, 10]).build()\nsearch = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=evaluator, numFolds=5, seed=42, parallelism=4)\nfitted = search.fit(train)",
        "print('cross-validated:', max(fitted.avgMetrics) if evaluator.isLargerBetter() else min(fitted.avgMetrics))\nprint('held out:', evaluator.evaluate(fitted.transform(test)))\nbest = fitted.bestModel\nprint('importances:', best.stages[-1].featureImportances)\nbest.write().overwrite().save('model')",
    ]
    text = "\n\n".join(blocks) + "\n"
    ast.parse(text)
    return text
