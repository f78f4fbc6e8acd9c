"""Bins by their ends equal ntile, whatever ties; no row is ranked for them."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from assay.operators import interactions
from assay.plans import ranks, tiles


@pytest.fixture
def table(spark):
    return spark.range(1_003).select(
        F.col("id").alias("k"), F.md5(F.col("id").cast("string").cast("binary")).alias("s"), (F.col("id") * 37 % 211).cast("double").alias("v"), (F.col("id") % 23).cast("int").alias("tied"), (F.pow(F.col("id") % 5, 2)).alias("few"),
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("hot"), (F.col("id") % 3).cast("string").alias("same"),
    )


@pytest.mark.parametrize(("key", "short", "bins"), [("s", 200_000, 16), ("s", 20, 16), ("k", 20, 100), ("k", 1, 7)])
def test_bins_equal_ntile(table, monkeypatch, key, short, bins):
    monkeypatch.setattr(tiles, "SORTED", short)
    monkeypatch.setattr(interactions, "tiles", None)
    monkeypatch.setattr(ranks, "running", None)
    columns = ["v", "tied", "few", "hot"]
    got = {r["id"]: tuple(r)[1:] for r in interactions.binned(table.withColumn("id", F.col("k")), columns, key, bins).select("id", *columns).collect()}
    want = {r["k"]: tuple(r)[1:] for r in table.select("k", *[(F.dense_rank() if n <= bins else F.ntile(bins)).over(Window.orderBy(c, *[key] * (n > bins))).alias(c) for c, n in zip(columns, (211, 23, 5, 102), strict=True)]).collect()}
    assert got == want


def test_equal_keys_are_split_too(table):
    for key in ("same", "few"):
        got = interactions.binned(table, ["hot", "tied"], key, 16)
        for c in ("hot", "tied"):
            n = [r["count"] for r in got.groupBy(c).count().orderBy(c).collect()]
            assert n == [63] * 11 + [62] * 5  # 1,003 rows in 16 tiles
            ends = [(r["a"], r["b"]) for r in table.join(got.select("k", F.col(c).alias("t")), "k").groupBy("t").agg(F.min(F.struct(c, key)).alias("a"), F.max(F.struct(c, key)).alias("b")).orderBy("t").collect()]
            assert all(x[1] <= y[0] for x, y in zip(ends, ends[1:], strict=False))


def test_nulls_and_wide_numbers_keep_their_ranks(spark):
    df = spark.range(400).select(F.col("id").alias("k"), F.when(F.col("id") % 4 != 0, F.col("id")).alias("gaps"), (F.lit(2**60) + F.col("id")).alias("wide"), F.when(F.col("id") % 2 == 0, 1).alias("two"), F.lit(None).cast("double").alias("none"))
    got = interactions.binned(df, ["gaps", "wide", "two", "none"], "k", 16)
    want = df.select("k", *[F.ntile(16).over(Window.orderBy(c, "k")).cast("string").alias(c) for c in ("gaps", "wide")])
    assert {(r["k"], str(r["gaps"]), str(r["wide"])) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert got.select("two").distinct().count() == 2 and got.select("none").distinct().count() == 1


def test_pairs_of_bins_count_like_pairs_of_texts(table):
    got = interactions.binned(table, ["v", "tied", "few"], "k")
    pairs = [("v", "tied"), ("v", "few"), ("tied", "few")]
    a = {(r["a"], r["b"]): (r["mi"], r["score"]) for r in interactions.mutual_information(got, pairs).collect()}
    b = {(r["a"], r["b"]): (r["mi"], r["score"]) for r in interactions.mutual_information(got.select(*[F.col(c).cast("string") for c in ("v", "tied", "few")]), pairs).collect()}
    assert set(a) == set(pairs) and all(a[p] == pytest.approx(b[p]) for p in pairs)
