"""Running sums and ranks over a global order without a single task.

Rows are cut into ranges by splitters from a bounded sample of the order's values. A range is a hash partition of its
own, so the sort and the running sum are spread over as many tasks; the totals of the ranges before it, one small row
per group and range, are added by a broadcast join. The result doesn't depend on the splitters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.plans.select import search

#: Rows of the order that the driver may look at to choose splitters.
SAMPLE = 10_000
#: Up to so many rows one range is enough: a sort that any task can hold.
ONE_RANGE = 100_000


def ranged(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with __range: the place of the row's range in the order (columns of ``order`` are without nulls)."""
    n = df.count()
    if parts is None:
        parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if n > ONE_RANGE else 1
    if parts == 1 or n <= parts:
        return df.withColumn("__range", F.lit(0))
    keys = df.select(*order)
    seen = sorted(tuple(r) for r in (keys if n <= SAMPLE else keys.sample(SAMPLE / n, seed=1)).collect())
    cuts = sorted({seen[len(seen) * i // parts] for i in range(1, parts)}) if seen else []
    if not cuts:
        return df.withColumn("__range", F.lit(0))
    types = [df.schema[c].dataType for c in order]
    row = lambda values: F.struct(*[v.alias(c) for v, c in zip(values, order, strict=True)])
    mine = row([F.col(c) for c in order])
    after = lambda cut: mine > row([F.lit(v).cast(t) for v, t in zip(cut, types, strict=True)])
    return df.withColumn("__range", search(mine, cuts, [F.lit(i) for i in range(len(cuts) + 1)], after))


def running(df: DataFrame, order: list[str], sums: dict[str, str], group: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with, per entry of ``sums``, the sum of that column over the rows of its group up to and with this one."""
    group = group or []
    b = ranged(df, [*group, *order], parts)
    own = Window.partitionBy(*group, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = b.groupBy(*group, "__range").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "__range", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    out = b.select("*", *[F.sum(c).over(own).alias(n) for n, c in sums.items()]).join(F.broadcast(offsets), [*group, "__range"])
    return out.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__range", *[f"__{n}" for n in sums])


def tiles(df: DataFrame, column: str, key: str, bins: int, out: str) -> DataFrame:
    """``df`` with ``out``: which of ``bins`` equally full ones (from 1) the row falls in by (column, key), as ``ntile``."""
    n = df.count()
    q, more = divmod(n, bins)
    r = running(df.withColumn("__one", F.lit(1).cast("long")), [column, key], {"__rank": "__one"}).withColumn("__rank", F.col("__rank") - 1)
    wide = more * (q + 1)
    tile = F.when(F.col("__rank") < wide, F.floor(F.col("__rank") / (q + 1))).otherwise(more + F.floor((F.col("__rank") - wide) / max(q, 1))) + 1
    return r.withColumn(out, tile.cast("string")).drop("__rank", "__one")
