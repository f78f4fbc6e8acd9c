"""Drift of equal, shifted and tiny tables; the stream's windows."""

import pytest
from pyspark.sql import functions as F

from assay.operators import drift
from assay.streaming import drift as stream


@pytest.fixture(scope="module")
def ref(spark):
    return spark.createDataFrame([(float(i % 50), "abc"[i % 3], None if i % 10 else i, 1) for i in range(500)], "v double, c string, g int, t int").cache()


def test_a_table_does_not_drift_from_itself(ref):
    d = drift.dataset_drift(ref, ref, "t").first()
    assert d["avg_psi"] == 0.0 and d["level"] == "Negligible" and d["n_columns"] == 3
    assert drift.category_churn(ref, ref, ["c"]).count() == drift.missing_rate_drift(ref, ref, ref.columns).count() == drift.schema_diff(ref, ref).count() == 0
    assert drift.ks_two_sample(ref, ref, ["v"]).first()["ks"] == 0.0


def test_shift(ref):
    new = ref.select((F.col("v") + 40).alias("v"), F.when(F.col("c") == "a", "z").otherwise(F.col("c")).alias("c"), F.lit(1).alias("g"))
    r = drift.report(ref, new)
    assert r["level"] == "Major" and r["columns"][0]["level"] == "Major"
    v = next(c for c in r["columns"] if c["column"] == "v")
    assert v["ks"] == pytest.approx(0.8) and v["ks_significant"] and v["mean_shift_pct"] == pytest.approx(40 / 24.5 * 100)
    c = next(c for c in r["columns"] if c["column"] == "c")
    assert c["appeared"] == ["z"] and c["disappeared"] == ["a"] and c["chi2_p"] < 1e-6
    assert [m["column"] for m in r["missing"]] == ["g"] and r["missing"][0]["severity"] == "high" and [s["change"] for s in r["schema"]] == ["disappeared"]


def test_shifts_are_absolute(ref):
    r = drift.numeric_drift(ref, ref.select((F.col("v") * 0.5).alias("v")), ["v"]).first()
    assert r["mean_shift_pct"] == pytest.approx(50.0) and r["std_shift_pct"] == pytest.approx(50.0)


def test_too_few_values(ref, spark):
    few = spark.createDataFrame([(1.0,), (None,)], "v double")
    r = drift.numeric_drift(ref, few, ["v"]).first()
    assert r["psi"] is None and r["error"] and drift.dataset_drift(ref.select("v"), few).first()["n_columns"] == 0
    assert drift.psi_numeric(ref, few.where("false"), ["v"]).first()["psi"] == 0.0
    assert drift.psi_categorical(ref, ref.where("false"), ["c"]).first()["psi"] == 0.0


@pytest.mark.parametrize(("psi", "level"), [(0.0999, "Negligible"), (0.10, "Minor"), (0.20, "Moderate"), (0.25, "Major")])
def test_levels(spark, psi, level):
    assert spark.range(1).select(drift.level(F.lit(psi))).first()[0] == level


def test_windows_of_a_stream(spark, ref, tmp_path):
    bins = stream.reference_bins(ref, "v")
    rows = [(float(i % 50), f"2024-01-01 00:{i % 60:02d}:00") for i in range(600)] + [(45.0, f"2024-01-01 01:{i % 60:02d}:00") for i in range(300)] + [(1.0, "2024-01-01 09:00:00")]
    path = f"{tmp_path}/in"
    spark.createDataFrame(rows, "v double, t string").withColumn("t", F.to_timestamp("t")).write.parquet(path)
    got = []
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    q = stream.watch(source, bins, "t", f"{tmp_path}/cp", lambda df, i: got.extend(df.collect()), availableNow=True)
    q.awaitTermination()
    by = {r["start"].hour: r for r in got}
    assert by[0]["level"] == "Negligible" and by[0]["n"] == 600 and by[1]["level"] == "Major" and 9 not in by
    with pytest.raises(ValueError):
        stream.reference_bins(ref, "t")
