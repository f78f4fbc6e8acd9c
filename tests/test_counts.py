"""Power transforms and tests of normality work on distinct values, counted once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.operators import profile, transforms


def no(*_, **__):
    raise AssertionError("another read of the whole table")


def test_powers_read_counted_values(spark, monkeypatch):
    data = np.round(np.random.default_rng(2).normal(3, 4, 600), 1)
    df = spark.createDataFrame([(float(v) if i % 6 else None,) for i, v in enumerate(data)], "v double")
    monkeypatch.setattr(F, "var_pop", no)
    monkeypatch.setattr(F, "percentile", no)
    got = sorted(r["v"] for r in transforms.apply(df, "yeo_johnson", ["v"]).collect())
    some = np.array([v for i, v in enumerate(data) if i % 6])
    x = np.where(np.arange(600) % 6, data, np.median(some))

    def power(lam):
        up = np.log1p(np.maximum(x, 0)) if abs(lam) < 1e-9 else ((1 + np.maximum(x, 0)) ** lam - 1) / lam
        down = -np.log1p(np.maximum(-x, 0)) if abs(lam - 2) < 1e-9 else -((1 + np.maximum(-x, 0)) ** (2 - lam) - 1) / (2 - lam)
        return np.where(x >= 0, up, down)

    a, b = -4.0, 6.0
    for _ in range(5):
        grid = [a + (b - a) * i / 16 for i in range(17)]
        best = max(range(17), key=lambda i: -300 * np.log(power(grid[i]).var()) + (grid[i] - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum())
        a, b = grid[max(0, best - 1)], grid[min(16, best + 1)]
    y = power((a + b) / 2)
    assert got == pytest.approx(sorted((y - y.mean()) / y.std()), abs=1e-9)


def test_normality_counts_the_table_once(spark, monkeypatch):
    df = spark.range(12_000).select((F.col("id") * 7_919 % 5_003).cast("double").alias("a"), (F.col("id") % 4).cast("double").alias("b"), F.lit(None).cast("double").alias("none"))
    want = {c: sorted(r[0] for r in profile.sample_rows(df.select(c), 5_000).collect()) for c in "ab"}
    seen, written = [], []
    monkeypatch.setattr(profile, "sample_rows", no)
    monkeypatch.setattr(profile, "shapiro_wilk", lambda v: (seen.append(sorted(v)), (0.5, 0.5))[1])
    monkeypatch.setattr(profile, "cut", lambda d, what, cut=profile.cut: (written.append(what), cut(d, what))[1])
    got = {r["column"]: r for r in profile.normality(df, ["a", "b", "none"]).collect()}
    assert set(got) == {"a", "b"} and seen == [want["a"], want["b"]] and written == ["values"]


@pytest.mark.parametrize("runs", [1, 3, 16])
def test_draws_fill_their_places(spark, monkeypatch, runs):
    import random

    monkeypatch.setattr(profile, "RUNS", runs)
    df = spark.range(3_000).select((F.col("id") * F.col("id") % 401).alias("v"))
    line = sorted((h, v) for h, v in df.select(F.xxhash64(F.lit(42), "v"), "v").collect())
    want = sorted(line[i][1] for i in random.Random(42).sample(range(3_000), 500))
    assert sorted(r["v"] for r in profile.sample_rows(df, 500).collect()) == want
