"""Order statistics by bins equal sorting; the queries that use them hold no column's values in one aggregate buffer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.operators import profile, readiness, recommend
from assay.plans import select, statplan


def columns(spark):
    rng = np.random.default_rng(5)
    data = {
        "even": np.arange(3_000.0), "few": rng.integers(0, 7, 3_000).astype(float), "heavy": np.exp(rng.normal(0, 8, 3_000)), "far": np.where(np.arange(3_000) == 7, 1e300, rng.normal(0, 1e-3, 3_000)),
        "tied": np.where(np.arange(3_000) % 3, 5.0, rng.normal(5, 1e-12, 3_000)), "one": np.full(3_000, 2.5), "huge": 1.7e308 * rng.uniform(-1, 1, 3_000), "near": np.nextafter(0, 1) * rng.integers(0, 3, 3_000),
    }
    return data, spark.createDataFrame([tuple(map(float, r)) for r in zip(*data.values(), strict=True)], ", ".join(f"{c} double" for c in data)).cache()


@pytest.mark.parametrize(("cells", "gather"), [(32_768, 50_000), (512, 0)])
def test_order_statistics_equal_sorting(spark, monkeypatch, cells, gather):
    data, df = columns(spark)
    monkeypatch.setattr(select, "CELLS", cells)
    monkeypatch.setattr(select, "GATHER", gather)
    ranks = [0, 1, 749, 750, 1_499, 1_500, 2_998, 2_999]
    found, levels = select.order_statistics(df, [F.col(c) for c in data], [ranks] * len(data), few=16)
    for (c, v), got in zip(data.items(), found, strict=True):
        s = np.sort(v)
        assert got == {r: (s[r], int((v < s[r]).sum()), int((v == s[r]).sum())) for r in ranks}, c
    assert levels[5] == [2.5] and all(not x or x == sorted(set(v)) for x, v in zip(levels, data.values(), strict=True))
    if cells > 1_000:
        assert levels[1] == [float(x) for x in range(7)]


def test_quantiles_equal_percentile(spark):
    data, df = columns(spark)
    df = df.withColumns({c: F.when(F.col("even") % 5 != 0, F.col(c)) for c in data if c != "even"}).withColumn("none", F.lit(None).cast("double"))
    at = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, at))).alias(c) for c in df.columns]).first()
    got = select.quantile_values(df, df.columns, *at)
    assert got["none"] is None and all(got[c] == pytest.approx(want[c], rel=1e-12) for c in data)
    assert select.quantile_values(df.limit(0), ["even"], 0.5) == {"even": None}


def test_counts_keep_types_apart(spark):
    df = spark.sql("SELECT id AS l, double(id % 4) AS d, CASE WHEN id % 2 = 0 THEN 'x' END AS s, timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, int(id % 3)) AS t, id % 2 = 0 AS b, decimal(id % 5) AS m FROM range(60)")
    got = {r["column"]: tuple(r)[1:] for r in statplan.cardinalities(df, df.columns).collect()}
    assert got == {"l": (60, 60, 60, 1), "d": (60, 60, 4, 15), "s": (30, 60, 1, 30), "t": (60, 60, 3, 20), "b": (60, 60, 2, 30), "m": (60, 60, 5, 12)}
    assert statplan.modes(df, ["l", "d"]) == {"l": 0.0, "d": 0.0}


def unfit(monkeypatch):
    """From here on an exact percentile or mode, whose buffer holds all distinct values, is an error."""

    def no(*_):
        raise AssertionError("a column's values in one buffer")

    monkeypatch.setattr(F, "percentile", no)
    monkeypatch.setattr(F, "mode", no)


def test_univariate_statistics_hold_no_column(spark, monkeypatch):
    data, df = columns(spark)
    unfit(monkeypatch)
    got = {r["column"]: r for r in profile.univariate_numeric(df.select("even", "few", F.lit(None).cast("double").alias("none")), ["even", "few", "none"]).collect()}
    assert got["even"]["median"] == 1_499.5 and got["even"]["mode"] == 0.0 and got["few"]["mode"] == float(np.bincount(data["few"].astype(int)).argmax()) and got["none"]["median"] is None and got["none"]["missing"] == 3_000
    assert profile.iqr_outliers(df, ["heavy"]).first()["q1"] == pytest.approx(np.quantile(data["heavy"], 0.25))


def test_readiness_holds_no_column(spark, monkeypatch):
    _, df = columns(spark)
    unfit(monkeypatch)
    monkeypatch.setattr(statplan, "per_column", unfit)
    got = {r["column"]: r for r in readiness.column_scores(df, "even").collect()}
    assert got["heavy"]["outlier_pct"] > 10 and got["one"]["outlier_pct"] is None and got["even"]["outlier_severity"] == 100.0 and got["even"]["n_unique"] == 3_000


def test_recommendations_hold_no_column(spark, monkeypatch):
    _, df = columns(spark)
    unfit(monkeypatch)
    got = {r["id"]: r["affected"] for r in recommend.recommendations(df, "even").collect()}
    assert got["skew"] == ["heavy"] and "heavy" in got["outliers"] and "dups" not in got
