"""Every action on nulls, constants, ties and nothing."""

import math
import random

import pytest
from pyspark.sql import functions as F

from assay.operators import transforms
from assay.operators.transforms import ACTIONS, apply, yeo_johnson_lambdas

ROWS = [(1, 1.0, 10, "a", 5.0), (2, 2.0, None, "b", 5.0), (3, None, 30, None, 5.0), (4, 4.0, 40, "a", 5.0), (5, 100.0, 50, "c", 5.0), (5, 100.0, 50, "c", 5.0)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k long, x double, n int, s string, one double").cache()


def values(df, c):
    return [r[0] for r in df.orderBy("k").select(c).collect()]


def test_every_action_runs_on_all_and_on_nothing(df):
    for action in ACTIONS:
        apply(df, action).collect()
        apply(df.limit(0), action).collect()
        apply(df, action, [], "k").collect()
        apply(df, action, ["absent"]).collect()
    with pytest.raises(ValueError):
        apply(df, "no_such_action")


def test_imputation(df):
    assert values(apply(df, "impute_mean", ["x"]), "x")[2] == pytest.approx(41.4)
    assert values(apply(df, "impute_median", ["x", "n"]), "x")[2] == 4.0 and values(apply(df, "impute_median", ["n"]), "n")[1] == 40.0
    got = apply(df, "impute_mode", ["x", "s", "n"])
    assert values(got, "x")[2] == 100.0 and values(got, "s")[2] == "a" and dict(got.dtypes)["n"] == "int"
    assert values(apply(df, "impute_unknown"), "s")[2] == "Unknown"


def test_nearest_neighbours(spark):
    rows = [(i, float(i), float(i) * 10) for i in range(20)] + [(99, 7.2, None)]
    got = apply(spark.createDataFrame(rows, "k long, a double, b double"), "impute_knn", ["a", "b"])
    assert values(got, "b")[-1] == pytest.approx(sum(x * 10 for x in (5, 6, 7, 8, 9)) / 5)


def test_nearest_neighbours_are_searched_among_all_rows(spark, monkeypatch):
    rows = [(i, float(i), float(i) * 10) for i in range(12_000)] + [(20_000 + i, i * 97 + 0.2, None) for i in range(1, 120)]
    got = apply(spark.createDataFrame(rows, "k long, a double, b double"), "impute_knn", ["a", "b"]).where("k > 20000").collect()
    assert len(got) == 119 and all(r["b"] == pytest.approx((r["k"] - 20_000) * 970) for r in got)
    monkeypatch.setattr(transforms, "KNN_DONORS", 7)
    monkeypatch.setattr(transforms, "KNN_ROWS", 3)
    rng = random.Random(4)
    some = lambda n: None if rng.random() < 0.25 else float(rng.randrange(n))
    rows = [(i, some(6), some(5), some(9)) for i in range(150)]
    got = {r[0]: r[1:] for r in apply(spark.createDataFrame(rows, "k long, a double, b double, `c.d` double"), "impute_knn", ["a", "b", "c.d"]).collect()}
    for k, *x in rows:
        for j in range(3):
            if x[j] is not None:
                assert got[k][j] == x[j]
                continue
            near = []
            for _, *y in rows:
                both = [(p - q) ** 2 for p, q in zip(x, y, strict=True) if p is not None and q is not None]
                if y[j] is not None and both:
                    near.append((sum(both) * 3 / len(both), y[j]))
            want, places = 0.0, min(5, len(near))
            for d in sorted({d for d, _ in near}):
                tied = [v for e, v in near if e == d]
                take = min(len(tied), places)
                want, places = want + sum(tied) / len(tied) * take, places - take
            if near:
                assert got[k][j] == pytest.approx(want / min(5, len(near)))


def test_outliers(df):
    capped = values(apply(df, "cap_outliers", ["n"]), "n")
    assert capped[1] is None and max(c for c in capped if c is not None) <= 80
    assert apply(df, "remove_outliers", ["x"]).count() == 5  # the row with a null goes


def test_scaling(df):
    s = values(apply(df, "scale_standard", ["x", "one"]), "x")
    filled = [0.0 if r[1] is None else r[1] for r in ROWS]
    m = sum(filled) / 6
    sd = math.sqrt(sum((v - m) ** 2 for v in filled) / 6)
    assert s == pytest.approx([(v - m) / sd for v in filled]) and set(values(apply(df, "scale_standard", ["one"]), "one")) == {0.0}
    assert values(apply(df, "scale_minmax", ["x"]), "x")[2] == 0.0 and set(values(apply(df, "scale_minmax", ["one"]), "one")) == {0.0}
    assert set(values(apply(df, "scale_robust", ["one"]), "one")) == {0.0}


def test_powers(df, spark):
    assert values(apply(df, "log_transform", ["x"]), "x")[0] == pytest.approx(math.log(2)) and values(apply(df, "sqrt_transform", ["x"]), "x")[3] == 2.0
    # the exponent that makes a log-normal column normal is near 0
    skewed = spark.range(2000).select(F.exp(F.randn(3)).alias("v"))
    lam = yeo_johnson_lambdas(skewed.cache(), ["v"])["v"]
    assert -1.5 < lam < 0.2
    out = apply(skewed, "yeo_johnson", ["v"]).agg(F.avg("v"), F.stddev_pop("v"), F.skewness("v")).first()
    assert abs(out[0]) < 1e-9 and out[1] == pytest.approx(1.0) and abs(out[2]) < 0.2


def test_encodings(df):
    hot = apply(df, "encode_onehot", ["s"])
    assert hot.columns == ["k", "x", "n", "one", "s_a", "s_b", "s_c"] and values(hot, "s_a") == [True, False, False, True, False, False]
    assert values(apply(df, "encode_label", ["s"], order_by="k"), "s") == [0, 1, -1, 0, 2, 2]
    assert values(apply(df, "encode_frequency", ["s"]), "s") == [0.4, 0.2, None, 0.4, 0.4, 0.4]
    assert values(apply(df, "encode_target", ["s"], "n"), "s")[0] == 25.0 and apply(df, "encode_target", None, "n").columns == df.columns
    assert apply(df, "drop_duplicates").count() == 5 == apply(df, "keep_first").count()


def test_drop_high_missing(spark):
    df = spark.createDataFrame([(i, None if i < 7 else 1.0, None if i < 6 else 1.0) for i in range(10)], "k long, few double, enough double")
    assert apply(df, "drop_high_missing").columns == ["k", "enough"] and apply(df, "drop_high_missing", ["enough"]).columns == ["k", "few"]
