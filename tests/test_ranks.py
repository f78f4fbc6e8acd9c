"""Running sums and tiles over ranges equal those of one window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from assay.plans.ranks import running, tiles


def test_running_sums_equal_a_window(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).cast("double").alias("v"), F.col("id").alias("k"), (F.col("id") % 3).alias("g"), F.lit(2).alias("n")).cache()
    w = Window.partitionBy("g").orderBy("v", "k").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r["k"], r["s"]) for r in df.withColumn("s", F.sum("n").over(w)).collect()}
    for parts in (1, 4, 50):
        assert {(r["k"], r["s"]) for r in running(df, ["v", "k"], {"s": "n"}, ["g"], parts).collect()} == want
    assert running(df.limit(0), ["v", "k"], {"s": "n"}).count() == 0


def test_tiles_equal_ntile(spark):
    df = spark.range(103).select((F.col("id") % 7).cast("double").alias("v"), F.col("id").alias("k")).cache()
    for bins in (1, 4, 16, 200):
        want = {(r["k"], str(r["t"])) for r in df.withColumn("t", F.ntile(bins).over(Window.orderBy("v", "k"))).collect()}
        assert {(r["k"], r["t"]) for r in tiles(df, "v", "k", bins, "t").collect()} == want
