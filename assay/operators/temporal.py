"""Concept drift over time within one table: time quartiles and rolling trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.exprs import ident, quantiles, ratio, real
from assay.operators.profile import numeric_columns
from assay.plans.kinds import type_family
from assay.plans.ranks import running


def micros(name: str):
    return F.unix_micros(ident(name).cast("timestamp"))


def quartile_shift(df: DataFrame, time: str, columns: list[str], flag_pct: float = 20.0) -> DataFrame:
    """Mean of each column per quarter of the rows by time, and how far the last quarter's mean is from the first's.

    Quarter limits are interpolated quantiles of the time, right-closed; rows without a time are left out. If two
    limits coincide, quarters can't be told apart and no rows are returned.
    """
    t = df.withColumn("__t", micros(time)).where("__t is not null")
    q = t.agg(quantiles(F.col("__t"), 0.0, 0.25, 0.5, 0.75, 1.0).alias("q")).first()["q"]
    if q is None or len(set(q)) < 5:
        return df.sparkSession.createDataFrame([], "column string, q1 double, q2 double, q3 double, q4 double, drift_pct double, drifted boolean")
    quarter = F.when(F.col("__t") <= q[1], 1).when(F.col("__t") <= q[2], 2).when(F.col("__t") <= q[3], 3).otherwise(4)
    structs = [F.struct(F.lit(c).alias("column"), *[F.avg(F.when(quarter == k, real(c))).alias(f"q{k}") for k in (1, 2, 3, 4)]) for c in columns]
    got = t.agg(F.array(*structs).alias("s")).select(F.inline("s"))
    drift = F.abs(F.col("q4") - F.col("q1")) / F.greatest(F.abs("q1"), F.lit(1e-9)) * 100
    return got.withColumn("drift_pct", drift).withColumn("drifted", F.col("drift_pct") > flag_pct)


def rolling_mean(df: DataFrame, time: str, column: str, key: str, window: int | None = None) -> DataFrame:
    """Rows (key, time, value, rolling): mean over the last ``window`` rows by (time, key); by default max(5, rows/20).

    Running sums and counts over sorted ranges give each row its place and the sum up to it; the mean is the difference
    to the row ``window`` places before, found by an equi-join on places. The work grows with the rows, not with the
    window. Null values don't count; a window without any value has no mean.
    """
    rows = df.select(ident(key).alias("key"), micros(time).alias("t"), real(column).alias("value")).where("t is not null")
    w = window or max(5, rows.count() // 20)
    counted = rows.withColumns({"one": F.lit(1).cast("long"), "some": F.col("value").isNotNull().cast("long"), "v": F.coalesce("value", F.lit(0.0)).cast("decimal(38,10)")})
    at = running(counted, ["t", "key"], {"place": "one", "n": "some", "s": "v"})
    before = at.select((F.col("place") + w).alias("place"), F.col("n").alias("n0"), F.col("s").alias("s0"))
    n = F.col("n") - F.coalesce("n0", F.lit(0))
    mean = (F.col("s") - F.coalesce("s0", F.lit(0).cast("decimal(38,10)"))).cast("double") / F.when(n > 0, n)
    return at.join(before, "place", "left").select("key", F.timestamp_micros("t").alias("time"), "value", mean.alias("rolling"))


def temporal_awareness(df: DataFrame, target: str | None = None, max_times: int = 2, max_numbers: int = 4) -> DataFrame:
    """Quartile shifts of the first numeric columns over the first datetime columns: (time, column, ..., drifted)."""
    times = [f.name for f in df.schema if type_family(f.dataType) == "datetime"][:max_times]
    numbers = [c for c in numeric_columns(df)[:max_numbers] if c != target]
    out = None
    for t in times if numbers else []:
        got = quartile_shift(df, t, numbers).withColumn("time", F.lit(t))
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = df.sparkSession.createDataFrame([], "column string, q1 double, q2 double, q3 double, q4 double, drift_pct double, drifted boolean, time string")
    return out


def time_ranges(df: DataFrame, times: list[str]) -> DataFrame:
    """Rows (time, n_rows, first, last) of each datetime column's non-null rows."""
    cells = F.array(*[F.struct(F.lit(t).alias("time"), micros(t).alias("v")) for t in times])
    got = df.select(F.inline(cells)).groupBy("time").agg(F.count("v").alias("n_rows"), F.min("v").alias("a"), F.max("v").alias("b"))
    return got.select("time", "n_rows", F.timestamp_micros("a").alias("first"), F.timestamp_micros("b").alias("last"), ratio(F.col("b") - F.col("a"), F.lit(86_400_000_000)).alias("days"))
