"""Drift of a stream against a frozen reference: PSI of every closed window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.exprs import ident, ratio, real
from assay.operators.drift import FLOOR, level


def reference_bins(ref: DataFrame, column: str, buckets: int = 10) -> dict:
    """Frozen equal-width bins of the reference and its share in each."""
    x = real(column)
    a, b, n = ref.agg(F.min(x), F.max(x), F.count(x)).first()
    if not n or a == b:
        raise ValueError(f"{column} has no range in the reference")
    at = F.least(F.floor((x - a) * buckets / (b - a)), F.lit(buckets - 1)).cast("int")
    counts = {r["bin"]: r["n"] for r in ref.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"column": column, "low": float(a), "high": float(b), "shares": [counts.get(i, 0) / n for i in range(buckets)]}


def windowed_counts(stream: DataFrame, bins: dict, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows (window, counts array) of a stream with a watermark; values outside the reference go to the end bins."""
    k, x = len(bins["shares"]), real(bins["column"])
    at = F.greatest(F.lit(0), F.least(F.floor((x - bins["low"]) * k / (bins["high"] - bins["low"])), F.lit(k - 1)))
    counts = F.array(*[F.coalesce(F.sum((at == i).cast("long")), F.lit(0)) for i in range(k)])
    t = stream.withColumn("__t", ident(time).cast("timestamp")).withWatermark("__t", late)
    return t.where(x.isNotNull()).groupBy(F.window("__t", window)).agg(counts.alias("counts"))


def score(windows: DataFrame, bins: dict) -> DataFrame:
    """Rows (start, end, n, psi, level) from windowed counts."""
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    out = windows.withColumn("n", total)
    psi = F.lit(0.0)
    for i, p in enumerate(bins["shares"]):
        q = ratio(F.col("counts")[i].cast("double"), F.col("n"))
        q, r = F.when(q == 0, FLOOR).otherwise(q), F.lit(p or FLOOR)
        psi = psi + F.when((F.col("counts")[i] == 0) & F.lit(p == 0), 0.0).otherwise((q - r) * F.log(q / r))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", F.abs(psi).alias("psi")).withColumn("level", level(F.col("psi")))


def watch(stream: DataFrame, bins: dict, time: str, checkpoint: str, sink: Callable[[DataFrame, int], None], window: str = "1 hour", late: str = "10 minutes", **trigger):
    """Start a query that hands each closed window's score to ``sink``; trigger options as in ``writeStream.trigger``."""
    scored = score(windowed_counts(stream, bins, time, window, late), bins)
    writer = scored.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
