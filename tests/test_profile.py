"""Thresholds and degenerate inputs of the profile, by hand."""

import pytest
from pyspark.sql import functions as F

from assay.functions.exprs import clean
from assay.operators import interactions, leakage, profile, readiness, recommend, temporal, transforms
from assay.plans.kinds import kinds


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, float(i % 5) if i % 4 else float("nan"), "a" if i % 10 else None, 7, None, bool(i % 2), f"2024-01-{1 + i % 28:02d} 00:00:00", [1], "x y" * 30) for i in range(200)]
    df = spark.createDataFrame(rows, "`an id` long, `x.y` double, c string, one int, gone double, b boolean, t string, l array<int>, txt string")
    return clean(df.withColumn("t", F.to_timestamp("t"))).cache()


def by(df, key="column"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_kinds(odd):
    assert kinds(odd) == {"an id": "numeric", "x.y": "numeric", "c": "categorical", "one": "numeric", "gone": "numeric", "b": "boolean", "t": "datetime", "l": "nested", "txt": "text"}


def test_missing_and_overview(odd):
    got = by(profile.missing_profile(odd))
    assert set(got) == {"x.y", "c", "gone"} and got["x.y"]["missing"] == 50 and got["gone"]["severity"] == "high" and got["x.y"]["severity"] == "medium" and got["c"]["missing_pct"] == 10.0 and got["c"]["severity"] == "low"
    o = profile.overview(odd).first()
    assert (o["n_rows"], o["n_columns"], o["missing_cells"], o["duplicate_rows"]) == (200, 9, 270, 0)
    assert profile.overview(odd.limit(0)).first()["missing_pct"] == 0.0
    assert profile.duplicates(odd.select("c", "one")).first()["duplicate_rows"] == 198


def test_constant_and_empty_columns(odd):
    u = by(profile.univariate_numeric(odd, ["x.y", "one", "gone"]))
    assert u["one"]["skewness"] == u["one"]["kurtosis"] == 0.0 and u["one"]["cv"] == 0.0 and u["gone"]["mean"] is None and u["gone"]["skewness"] is None and u["x.y"]["count"] == 150
    spread = odd.repartition(7).select(F.lit(0.1).alias("one"), "`an id`")
    u = by(profile.univariate_numeric(spread, ["one"]))["one"]
    assert u["skewness"] == u["kurtosis"] == 0.0 and profile.pearson_pairs(spread, ["one", "an id"]).first()["r"] is None
    assert by(profile.skew_kurt(odd, ["one", "gone"]))["one"]["direction"] == "symmetric"
    assert profile.pearson_pairs(odd, ["one", "an id", "gone"]).where("r is not null").count() == 0
    assert profile.iqr_outliers(odd, ["one", "gone"]).count() == 0
    assert [r["n"] for r in profile.histogram(odd, ["one", "gone"]).collect()] == [200]
    c = by(profile.univariate_categorical(odd, ["c", "b"]))
    assert c["c"]["missing"] == 20 and c["c"]["top_value"] == "a" and abs(c["c"]["entropy"]) < 1e-6 and c["b"]["n_unique"] == 2
    empty = odd.limit(0)
    assert profile.univariate_numeric(empty, ["one"]).first()["count"] == 0 and readiness.column_scores(empty).count() == 8


def test_strong_labels(spark):
    df = spark.createDataFrame([(float(i), i * 2.0, i + (i % 7) * 9.0, -float(i)) for i in range(100)], "a double, b double, c double, d double")
    got = {(r["a"], r["b"]): r["label"] for r in profile.strong_pairs(df, list("abcd")).collect()}
    assert got["a", "b"] == got["a", "d"] == "very strong" and got["a", "c"] == "strong"


def test_problem_types(spark, odd):
    get = lambda c: tuple(profile.problem_type(odd, c).first())[:2]
    assert get("b") == ("binary classification", "high") and get("x.y") == ("multiclass classification", "medium") and get("an id") == ("regression", "high")
    assert tuple(profile.problem_type(odd, None).first())[:2] == ("unknown", "low")
    assert get("c")[0] == "multiclass classification"


def test_chi_square_needs_two_by_two(odd, spark):
    assert profile.chi_square(odd, [("c", "b")]).count() == 0
    df = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5, "p string, q string")
    r = profile.chi_square(df, [("p", "q")]).first()
    assert r["dof"] == 1 and r["statistic"] == pytest.approx(16.5785, abs=1e-3) and r["dependent"]


def test_normality_of_a_uniform_and_a_constant(odd):
    got = by(profile.normality(odd, ["an id", "one", "gone"]))
    assert set(got) == {"an id", "one"} and not got["an id"]["is_normal"] and got["one"]["shapiro"] is None


def test_pca(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float((i * 37) % 11)) for i in range(50)], "a double, b double, c double")
    got = profile.pca_ratio(df, ["a", "b", "c"]).collect()
    assert got[0]["explained"] > 0.6 and got[2]["cumulative"] == pytest.approx(1.0) and [r["enough"] for r in got].index(True) == 1
    with pytest.raises(ValueError):
        profile.pca_ratio(df.limit(2), ["a", "b"])


def test_samples_are_exact_and_repeat(odd):
    a, b = profile.sample_rows(odd, 30).collect(), profile.sample_rows(odd.repartition(5), 30).collect()
    assert len(a) == 30 and sorted(map(str, a)) == sorted(map(str, b))


def test_samples_of_few_values_keep_their_shares(spark):
    df = spark.range(20_000).select((F.col("id") % 4).cast("double").alias("v"), F.when(F.col("id") % 10 == 0, F.lit(1)).alias("rare"))
    got = {r["v"]: r["count"] for r in profile.sample_rows(df.select("v"), 2_000).groupBy("v").count().collect()}
    assert sum(got.values()) == 2_000 and set(got) == {0.0, 1.0, 2.0, 3.0} and all(400 < n < 600 for n in got.values())
    r = profile.normality(df, ["v"]).first()
    assert r["shapiro"] < 0.9 and r["shapiro_p"] < 1e-6
    assert {x["sample"] for x in profile.qq_points(df, "v").collect()} == {0.0, 1.0, 2.0, 3.0}
    assert 100 < profile.sample_rows(df.select("rare"), 2_000).where("rare = 1").count() < 300


def test_time(odd, spark):
    assert temporal.quartile_shift(spark.createDataFrame([(1, 2.0)] * 5, "i long, v double").withColumn("t", F.lit("2024-01-01").cast("timestamp")), "t", ["v"]).count() == 0
    rows = [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, t string, v double").withColumn("t", F.to_timestamp("t"))
    got = {r["key"]: r["rolling"] for r in temporal.rolling_mean(df, "t", "v", "k", 7).collect()}
    assert got == {i: pytest.approx(sum(range(max(0, i - 6), i + 1)) / len(range(max(0, i - 6), i + 1))) for i in range(300)}
    assert temporal.rolling_mean(df.limit(0), "t", "v", "k", 7).count() == 0
    first = temporal.quartile_shift(df, "t", ["v"]).first()
    assert first["drifted"] and first["q1"] == pytest.approx(37.0) and first["q4"] == pytest.approx(262.0)


def test_interactions(spark):
    df = spark.createDataFrame([(i, float(i), float(i) * 3, "ab"[i % 2], "xy"[i % 2], f"u{i}") for i in range(200)], "k long, a double, b double, c string, d string, u string")
    assert interactions.choose_columns(df, None) == ["k", "a", "b", "c", "d"]
    scores = interactions.pair_scores(df.drop("u"), "k").cache()
    got = {(r["a"], r["b"]): (r["score"], r["strength"]) for r in scores.collect()}
    assert got["a", "b"][0] == pytest.approx(1.0) and got["c", "d"] == (1.0, "Strong") and got["a", "c"][1] == "Negligible"
    assert interactions.redundancy_groups(scores) == [["a", "b"], ["c", "d"]]  # a row key is no column to pair
    assert interactions.matrix(scores).count() == 16 and "strong" in interactions.summary(scores)
    assert interactions.pair_scores(df.limit(3).drop("u"), "k").first()["method"] == "insufficient_data"
    t = {r["column"]: r["score"] for r in interactions.target_scores(df.drop("u"), "d", "k").collect()}
    assert t["c"] == 1.0


def test_leakage(spark):
    rows = [(i, i % 2, float(i % 2) + 0.001 * (i % 3), i * 1.0, 5, "2030-01-01") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, churn int, churn_score double, other double, one int, d string").withColumn("d", F.col("d").cast("date"))
    found = leakage.findings(df, "churn", cutoff="2029-01-01")
    got = {(r["column"], r["detector"]): r["severity"] for r in found.collect()}
    assert got["churn_score", "target_correlation"] == "critical" and got["churn_score", "name_similarity"] == "high" and got["churn_score", "derived_name"] == "high"
    assert got["id", "identifier"] == "high" and got["one", "constant"] == "medium" and got["d", "future_data"] == "high" and got["d", "constant"] == "medium"
    assert by(leakage.consolidated(found))["churn_score"]["severity"] == "critical" and leakage.risk(found) == "CRITICAL"
    report = leakage.report(df, "churn", cutoff="2029-01-01")
    assert report["safe_columns"] == ["other"]
    assert leakage.risk(leakage.findings(df.select("other"), None)) == "CLEAN"
    # of equally severe findings the later detector's is kept
    tie = spark.createDataFrame([("x", "name_similarity", "high", None), ("x", "derived_name", "high", None)], leakage.SCHEMA)
    assert leakage.consolidated(tie).first()["detector"] == "derived_name"


@pytest.mark.parametrize(("total", "grade"), [(90.0, "A"), (89.9, "B"), (75.0, "B"), (60.0, "C"), (45.0, "D"), (44.9, "F")])
def test_grades(spark, total, grade):
    assert spark.range(1).select(readiness.grade(F.lit(total))).first()[0] == grade


def test_readiness_and_verdicts(odd):
    got = by(readiness.column_scores(odd, "b"))
    assert got["gone"]["completeness"] == 5.0 and got["gone"]["consistency"] == 50.0 and got["one"]["consistency"] == 15.0 and got["b"]["leakage_risk"] == 100.0 and got["txt"]["cardinality"] == 35.0 and got["c"]["cardinality"] == 20.0
    for r in got.values():
        assert set(readiness.verdicts(r)) == set(readiness.WEIGHTS)
    assert readiness.name_risk("churn", "CHURN") == 98.0 and readiness.name_risk("id", "t_x") == 72.0 and readiness.name_risk("total_price", "unit_price") == 50.0 and readiness.name_risk("x", "y") == 0.0


def test_readiness_by_hand(spark):
    """Column x: 1 of 10 missing (70 points), skewness 0 (70 + 30), a number (95, 95), no outlier (100), no target named."""
    df = spark.createDataFrame([(float(v) if v else None, "ab"[i % 2]) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, None])], "x double, c string")
    got = by(readiness.column_scores(df))
    x = got["x"]
    assert (x["completeness"], x["leakage_risk"], x["outlier_severity"], x["distribution"], x["cardinality"], x["type_fitness"], x["consistency"]) == (70.0, 100.0, 100.0, 94.0, 95.0, 95.0, 100.0)
    assert x["total"] == round((70 * 2.5 + 100 * 2.0 + 100 * 1.5 + 94 * 1.0 + 95 * 1.0 + 95 * 0.8 + 100 * 0.2) / 9, 1) == 90.0 and x["grade"] == "A" and x["label"] == "Production-ready"
    c = got["c"]  # complete 100, no risk 100, 90 and 85 as it is no number, two values 100, type 80, even 100
    assert c["total"] == round((250 + 200 + 135 + 85 + 100 + 64 + 20) / 9, 1) == 94.9
    assert readiness.dataset_score(readiness.column_scores(df)).first()["score"] == round((90.0 * 1.5 + 94.9) / 2.5, 1)
    assert "symmetric" in readiness.verdicts(x)["distribution"] and "fill them by" in readiness.verdicts(x)["completeness"]


def test_sketches_stand_in_for_exact_statistics(spark):
    df = spark.range(20_000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 3).cast("string").alias("c"), F.when(F.col("id") < 9_000, F.lit(5)).otherwise(F.col("id")).alias("m"))
    exact = by(profile.univariate_numeric(df, ["v", "m"])), by(profile.column_meta(df)), by(readiness.column_scores(df))
    spark.conf.set("spark.assay.statistics", "sketch")
    try:
        plan = profile.univariate_numeric(df, ["v"])._jdf.queryExecution().toString()
        rough = by(profile.univariate_numeric(df, ["v", "m"])), by(profile.column_meta(df)), by(readiness.column_scores(df))
    finally:
        spark.conf.unset("spark.assay.statistics")
    assert "percentile_approx" in plan and " percentile(" not in plan
    assert rough[0]["v"]["median"] == pytest.approx(exact[0]["v"]["median"], abs=4) and rough[0]["m"]["mode"] == exact[0]["m"]["mode"] == 5.0
    assert rough[1]["v"]["n_unique"] == pytest.approx(20_000, rel=0.03) and rough[1]["c"]["n_unique"] == 3 and rough[2]["c"]["total"] == exact[2]["c"]["total"]


def test_label_codes_by_first_appearance(spark):
    df = spark.createDataFrame([("z",), ("a",), (None,), ("z",), ("m",)], "c string").coalesce(1)
    assert sorted((r["c"] for r in transforms.apply(df, "encode_label", ["c"]).collect())) == [-1, 0, 0, 1, 2]
    codes = transforms.apply(df.withColumn("d", F.col("c")), "encode_label", ["c"]).where("d is not null").distinct()
    assert {r["d"]: r["c"] for r in codes.collect()} == {"z": 0, "a": 1, "m": 2}


def test_rolling_mean_by_hand(spark):
    rows = [(i, f"2024-01-01 00:00:{i // 2:02d}", None if i % 7 == 3 else float(i * i % 11)) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, t string, v double").withColumn("t", F.to_timestamp("t"))
    got = {r["key"]: r["rolling"] for r in temporal.rolling_mean(df, "t", "v", "k", 5).collect()}
    for k, _, _ in rows:
        seen = [v for i, _, v in rows[max(0, k - 4) : k + 1] if v is not None]
        assert got[k] == pytest.approx(sum(seen) / len(seen))


def test_recommendations(odd):
    got = by(recommend.recommendations(odd.drop("l"), "x.y"), "id")
    assert got["drop_high_miss"]["affected"] == ["gone"] and got["impute_num"]["affected"] == ["x.y"] and got["impute_cat"]["affected"] == ["c"]
    assert "x.y" not in got["scale"]["affected"] and got["enc_low"]["affected"] == ["c"] and "dups" not in got
