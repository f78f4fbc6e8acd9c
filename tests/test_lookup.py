"""Encodings: few values shuffle no row of the table; many values give the same, frequent and null ones apart."""

from pyspark.sql import functions as F

from assay.operators import transforms


def table(spark):
    return spark.range(900).select(F.col("id").alias("k"), F.when(F.col("id") % 9 != 0, F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 101))).alias("c"), (F.col("id") % 7).cast("double").alias("y"))


def coded(df, action):
    return {r["k"]: r["c"] for r in transforms.apply(df, action, ["c"], "y", **({"order_by": "k"} if action == "encode_label" else {})).select("k", "c").collect()}


def test_few_values_move_no_row(spark):
    for action in ("encode_frequency", "encode_target", "encode_label"):
        plan = transforms.apply(table(spark), action, ["c"], "y")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan, action


def test_many_values_give_the_same(spark, monkeypatch):
    df = table(spark)
    for action in ("encode_frequency", "encode_target", "encode_label"):
        want = coded(df, action)
        monkeypatch.setattr(transforms, "SENT", 5)
        assert coded(df, action) == want
        monkeypatch.undo()
    freq, mean, label = (coded(df, a) for a in ("encode_frequency", "encode_target", "encode_label"))
    rows = [tuple(r) for r in df.collect()]
    for k, c, _ in rows:
        same, some = [r for r in rows if r[1] == c], sum(r[1] is not None for r in rows)
        assert (freq[k], mean[k]) == ((len(same) / some, sum(r[2] for r in same) / len(same)) if c else (None, None))
        assert label[k] == (-1 if c is None else sorted({min(r[0] for r in rows if r[1] == v) for v in {r[1] for r in rows} if v}).index(min(r[0] for r in same)))
