"""The catalogue of preprocessing actions. Each fits what it needs in one aggregate and returns a lazy DataFrame.

``apply(df, action, columns, target)``. Without columns an action takes all numeric or all string columns but the
target. Columns that don't exist are ignored. Row counts change only where the action says so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.exprs import constant, ident, real
from assay.operators.profile import fences, numeric_columns
from assay.plans.kinds import type_family
from assay.plans.ranks import running
from assay.plans.select import extents, quantile_values
from assay.plans.statplan import per_column, with_totals
from assay.plans.storage import cut

#: Neighbours of nearest-neighbour imputation; distinct donors and distinct incomplete rows in a block of its search.
KNN_K, KNN_DONORS, KNN_ROWS = 5, 5_000, 500
#: Values of a column that a lookup sends to every task, and numbers that deal rows of frequent values evenly.
SENT, SALTS = 20_000, 1_024
#: Levels that one-hot encoding may add as columns.
MAX_LEVELS = 1_000


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if type_family(f.dataType) == "string"]


def _pick(df: DataFrame, columns: list[str] | None, default: list[str], target: str | None) -> list[str]:
    return [c for c in columns if c in df.columns] if columns is not None else [c for c in default if c != target]


def _fit(df: DataFrame, columns: list[str], make) -> dict[str, object]:
    return {r["column"]: r["v"] for r in per_column(df, columns, lambda c: {"v": make(c)}).collect()} if columns else {}


def _medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return {c: q and q[0] for c, q in quantile_values(df, columns, 0.5).items()}


def _put(df: DataFrame, new: dict) -> DataFrame:
    return df.select(*[(new[c].alias(c) if c in new else ident(c)) for c in df.columns])


def drop_high_missing(df, columns=None, target=None):
    """Given columns are dropped; without any, those with fewer than int(0.4 n) non-null values."""
    if columns is not None:
        return df.drop(*[c for c in columns if c in df.columns])
    got = df.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.count(ident(c)) for c in df.columns]).alias("k")).first()
    return df.drop(*[c for c, k in zip(df.columns, got["k"], strict=True) if k < int(0.4 * got["n"])])


def drop_duplicates(df, columns=None, target=None):
    """One of each group of equal rows."""
    return df.dropDuplicates()


def impute_mean(df, columns=None, target=None):
    v = _fit(df, cs := _pick(df, columns, numeric_columns(df), target), lambda c: F.avg(real(c)))
    return _put(df, {c: F.coalesce(real(c), F.lit(v[c]).cast("double")) for c in cs})


def impute_median(df, columns=None, target=None):
    v = _medians(df, cs := _pick(df, columns, numeric_columns(df), target))
    return _put(df, {c: F.coalesce(real(c), F.lit(v[c]).cast("double")) for c in cs})


def impute_mode(df, columns=None, target=None):
    """Any type; of equally frequent values the smallest."""
    cs = _pick(df, columns, [f.name for f in df.schema if type_family(f.dataType) != "nested"], target)
    if not cs:
        return df
    got = df.agg(*[F.mode(ident(c), True).alias(f"m{i}") for i, c in enumerate(cs)])
    both = df.crossJoin(F.broadcast(got))  # one row of modes: keeps every type as it is
    return both.select(*[F.coalesce(ident(c), F.col(f"m{cs.index(c)}")).alias(c) if c in cs else ident(c) for c in df.columns])


def impute_unknown(df, columns=None, target=None):
    return _put(df, {c: F.coalesce(ident(c), F.lit("Unknown")) for c in _pick(df, columns, _strings(df), target)})


def impute_knn(df, columns=None, target=None):
    """The mean of the five nearest donors that have the value, by Euclidean distance over the values both rows have.

    Donors are all rows; where more are equally near than places are left, they share the places, so that no order of
    rows or values decides. Equal rows are counted and searched once: blocks of distinct incomplete rows meet blocks of
    distinct donors, and each meeting leaves at most five distances per gap. Rows without a usable donor get the median.
    """
    cs = _pick(df, columns, numeric_columns(df), target)
    if not cs:
        return df
    med, xs = _medians(df, cs), [f"__x{i}" for i in range(len(cs))]
    plain = _put(df, {c: real(c) for c in cs})
    counted = cut(plain.select(*[ident(c).alias(x) for c, x in zip(cs, xs, strict=True)]).groupBy(*xs).agg(F.count(F.lit(1)).alias("__n")).where(F.coalesce(*xs).isNotNull()), "knn-rows")
    holes = counted.where(F.greatest(*[F.col(x).isNull().cast("int") for x in xs], F.lit(0)) == 1)
    donors, asked = _blocks(counted, [*xs, "__n"], KNN_DONORS, "d"), _blocks(holes, xs, KNN_ROWS, "a")
    near = asked.crossJoin(donors).mapInArrow(lambda batches: _nearest(batches, len(cs)), ", ".join([*[f"{x} double" for x in xs], "gap int", "d double", "v double", "n double"]))
    near = near.groupBy(*xs, "gap", "d").agg((F.sum("v") / F.sum("n")).alias("v"), F.sum("n").alias("n"))
    left = lambda got, x: F.least(x["n"], KNN_K - got["k"])
    used = F.aggregate(
        F.array_sort(F.collect_list(F.struct("d", "v", "n"))),
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("k")),
        lambda got, x: F.struct((got["s"] + x["v"] * left(got, x)).alias("s"), (got["k"] + left(got, x)).alias("k")),
        lambda got: got["s"] / got["k"],
    )
    means = near.groupBy(*xs, "gap").agg(used.alias("m")).groupBy(*xs).agg(*[F.max(F.when(F.col("gap") == i, F.col("m"))).alias(f"__m{i}") for i in range(len(cs))])
    means = cut(means, "knn-means")
    same = [ident(c).eqNullSafe(F.col(x)) for c, x in zip(cs, xs, strict=True)]
    joined = plain.join(means, reduce(and_, same), "left")
    return joined.select(*[F.coalesce(ident(c), F.col(f"__m{cs.index(c)}"), F.lit(med[c]).cast("double")).alias(c) if c in cs else ident(c) for c in df.columns])


def _blocks(df: DataFrame, columns: list[str], rows: int, name: str) -> DataFrame:
    """Rows of arrays, one per column, of about ``rows`` rows of ``df`` each."""
    parts = max(1, -(-df.count() // rows))
    return df.groupBy(F.pmod(F.xxhash64(*columns), F.lit(parts)).alias("__block")).agg(F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).alias(name)).select(name)


def _nearest(batches: Iterator, k: int) -> Iterator:
    """Per pair of blocks and gap of an incomplete row: the least distances of donors that have the value, with these values' sum and number."""
    import numpy as np
    import pyarrow as pa

    def matrix(cell, width: int):
        return cell.values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)

    for batch in batches:
        for asked, given in zip(batch.column("a"), batch.column("d"), strict=True):
            rows, found = matrix(asked, k), []
            known, times = np.split(matrix(given, k + 1), [k], axis=1)
            has, times = ~np.isnan(known), times[:, 0]
            for x in rows:
                both = has & ~np.isnan(x)
                m = both.sum(axis=1)
                d = np.where(m > 0, np.where(both, known - x, 0.0).__pow__(2).sum(axis=1) * k / np.maximum(m, 1), np.inf)
                for j in np.flatnonzero(np.isnan(x)):
                    at = np.flatnonzero(has[:, j] & np.isfinite(d))
                    if len(at) > KNN_K:
                        at = at[d[at] <= np.partition(d[at], KNN_K - 1)[KNN_K - 1]]
                    steps, of = np.unique(d[at], return_inverse=True)
                    sums, ns = np.bincount(of, known[at, j] * times[at]), np.bincount(of, times[at])
                    found += [(*x, j, *z) for z in zip(steps, sums, ns, strict=True)]
            columns = list(zip(*found, strict=True)) or [()] * (k + 4)
            kinds = [pa.float64()] * k + [pa.int32(), *[pa.float64()] * 3]
            names = [*[f"__x{i}" for i in range(k)], "gap", "d", "v", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, t.to_pandas_dtype()), t, from_pandas=True) for c, t in zip(columns, kinds, strict=True)], names)


def cap_outliers(df, columns=None, target=None):
    f = fences(df, cs, moments=False) if (cs := _pick(df, columns, numeric_columns(df), target)) else {}
    return _put(df, {c: F.when(ident(c).isNotNull(), F.least(F.greatest(real(c), F.lit(f[c][2])), F.lit(f[c][3]))) for c in cs if c in f} if f else {})


def remove_outliers(df, columns=None, target=None):
    """Rows within all fences stay; rows with a null in a fenced column go."""
    cs = _pick(df, columns, numeric_columns(df), target)
    f = fences(df, cs, moments=False) if cs else {}
    for c in cs:
        if c in f:
            df = df.where(real(c).between(f[c][2], f[c][3]))
    return df


def log_transform(df, columns=None, target=None):
    return _put(df, {c: F.when(ident(c).isNotNull(), F.log1p(F.greatest(real(c), F.lit(0.0)))) for c in _pick(df, columns, numeric_columns(df), target)})


def sqrt_transform(df, columns=None, target=None):
    return _put(df, {c: F.when(ident(c).isNotNull(), F.sqrt(F.greatest(real(c), F.lit(0.0)))) for c in _pick(df, columns, numeric_columns(df), target)})


def _power(x, lam: float):
    up = F.log1p(F.greatest(x, F.lit(0.0))) if abs(lam) < 1e-9 else (F.pow(1 + F.greatest(x, F.lit(0.0)), F.lit(lam)) - 1) / lam
    down = -F.log1p(F.greatest(-x, F.lit(0.0))) if abs(lam - 2) < 1e-9 else -(F.pow(1 + F.greatest(-x, F.lit(0.0)), F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def _power_cell(x, lam):
    """``_power`` with the exponent in a column."""
    far = F.abs(lam - 2) < 1e-9
    up = F.when(F.abs(lam) < 1e-9, F.log1p(F.greatest(x, F.lit(0.0)))).otherwise((F.pow(1 + F.greatest(x, F.lit(0.0)), lam) - 1) / lam)
    down = F.when(far, -F.log1p(F.greatest(-x, F.lit(0.0)))).otherwise(-(F.pow(1 + F.greatest(-x, F.lit(0.0)), 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, up).otherwise(down)


def _power_value(x: float, lam: float) -> float:
    try:
        if x >= 0:
            return math.log1p(x) if abs(lam) < 1e-9 else ((1 + x) ** lam - 1) / lam
        return -math.log1p(-x) if abs(lam - 2) < 1e-9 else -((1 - x) ** (2 - lam) - 1) / (2 - lam)
    except OverflowError:
        return math.inf


def _distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (i, x, n) of the columns' distinct doubles and how often each occurs, written once for many reads."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), real(c).alias("x")) for i, c in enumerate(columns)])
    return cut(df.select(F.inline(cells)).where("x is not null").groupBy("i", "x").agg(F.count(F.lit(1)).alias("n")), "values")


def _power_moments(counted: DataFrame, middle: list[float], grid: list[list[float]]) -> list[list[tuple[float, float, float]]]:
    """Per column and exponent: rows, mean and population variance of the transformed values.

    Sums are of distances from the transformed median, which is within a deviation of the mean, so that little cancels out.
    """
    points = [(i, j, lam, _power_value(middle[i], lam)) for i, lams in enumerate(grid) for j, lam in enumerate(lams)]
    table = F.array(*[F.array(*[F.struct(F.lit(j).alias("j"), F.lit(lam).alias("lam"), F.lit(c).alias("c")) for k, j, lam, c in points if k == i]) for i in range(len(grid))])
    cells = counted.select("i", "x", "n", F.inline(table[F.col("i")])).withColumn("d", _power_cell(F.col("x"), F.col("lam")) - F.col("c"))
    got = cells.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("d")).alias("a"), F.sum(F.col("n") * F.col("d") * F.col("d")).alias("b")).collect()
    out = [[(0, math.nan, math.nan)] * len(lams) for lams in grid]
    for r in got:
        near = r["a"] / r["n"]
        out[r["i"]][r["j"]] = (r["n"], _power_value(middle[r["i"]], grid[r["i"]][r["j"]]) + near, r["b"] / r["n"] - near * near)
    return out


def yeo_johnson_lambdas(df: DataFrame, columns: list[str], low: float = -4.0, high: float = 6.0, rounds: int = 5, points: int = 17, counted: DataFrame | None = None, middle: dict[str, float] | None = None) -> dict[str, float]:
    """The exponent of greatest likelihood per column: nested grids, each one aggregate for all columns and points over
    the distinct values (``counted``; ``middle`` has the medians)."""
    counted = _distinct_values(df, columns) if counted is None else counted
    middle = {c: q[0] if q else 0.0 for c, q in quantile_values(df, columns, 0.5).items()} if middle is None else middle
    bases = dict(counted.groupBy("i").agg(F.sum(F.col("n") * F.signum("x") * F.log1p(F.abs("x")))).collect())
    span = {c: (low, high) for c in columns}
    for _ in range(rounds):
        grid = {c: [a + (b - a) * i / (points - 1) for i in range(points)] for c, (a, b) in span.items()}
        got = _power_moments(counted, [middle[c] for c in columns], [grid[c] for c in columns])
        for k, c in enumerate(columns):
            values = [-n / 2 * math.log(v) + (lam - 1) * bases[k] if 0 < v < math.inf else -math.inf for (n, _, v), lam in zip(got[k], grid[c], strict=True)]
            i = max(range(points), key=lambda k, values=values: values[k])
            span[c] = (grid[c][max(0, i - 1)], grid[c][min(points - 1, i + 1)])
    return {c: (a + b) / 2 for c, (a, b) in span.items()}


def yeo_johnson(df, columns=None, target=None):
    """Nulls become the median; the likeliest power transform, standardised; columns with one value or none stay."""
    cs = _pick(df, columns, numeric_columns(df), target)
    cs = [c for c, (_, n, a, b) in zip(cs, extents(df, [real(c) for c in cs]), strict=True) if n and a < b] if cs else []
    if not cs:
        return df
    middle = {c: q[0] for c, q in quantile_values(df, cs, 0.5).items()}
    full = _put(df, {c: F.coalesce(real(c), F.lit(middle[c])) for c in cs})
    counted = _distinct_values(full, cs)
    lam = yeo_johnson_lambdas(full, cs, counted=counted, middle=middle)
    moments = dict(zip(cs, _power_moments(counted, [middle[c] for c in cs], [[lam[c]] for c in cs]), strict=True))
    return _put(full, {c: (_power(real(c), lam[c]) - moments[c][0][1]) / (math.sqrt(max(moments[c][0][2], 0.0)) or 1.0) for c in cs})


def scale_standard(df, columns=None, target=None):
    """Nulls become 0, then (x - mean) / population deviation; a constant column becomes 0."""
    cs = _pick(df, columns, numeric_columns(df), target)
    if not cs:
        return df
    x = {c: F.coalesce(real(c), F.lit(0.0)) for c in cs}
    got = {r["column"]: r for r in per_column(df, cs, lambda c: {"m": F.when(constant(x[c]), F.min(x[c])).otherwise(F.avg(x[c])), "s": F.when(~constant(x[c]), F.stddev_pop(x[c]))}).collect()}
    return _put(df, {c: (x[c] - F.lit(got[c]["m"])) / (got[c]["s"] or 1.0) for c in cs})


def scale_minmax(df, columns=None, target=None):
    """Nulls become 0, then to [0, 1]; a constant column becomes 0."""
    cs = _pick(df, columns, numeric_columns(df), target)
    if not cs:
        return df
    x = {c: F.coalesce(real(c), F.lit(0.0)) for c in cs}
    got = {r["column"]: r for r in per_column(df, cs, lambda c: {"a": F.min(x[c]), "b": F.max(x[c])}).collect()}
    return _put(df, {c: (x[c] - F.lit(got[c]["a"])) / (((got[c]["b"] or 0.0) - (got[c]["a"] or 0.0)) or 1.0) for c in cs})


def scale_robust(df, columns=None, target=None):
    """Nulls become the median, then (x - median) / IQR of the filled column; an IQR of zero divides by one."""
    cs = _pick(df, columns, numeric_columns(df), target)
    if not cs:
        return df
    full = impute_median(df, cs)
    f = fences(full, cs, moments=False)
    mid = _medians(full, cs)
    return _put(full, {c: (real(c) - F.lit(mid[c])) / ((f[c][1] - f[c][0]) or 1.0) for c in cs if c in f})


def encode_onehot(df, columns=None, target=None):
    """A boolean column ``column_value`` per value, in order; null is false everywhere; the source goes."""
    cs = _pick(df, columns, _strings(df), target)
    keep, new = [c for c in df.columns if c not in cs], []
    for c in cs:
        levels = [r[0] for r in df.select(ident(c).cast("string").alias("v")).where("v is not null").distinct().orderBy("v").limit(MAX_LEVELS + 1).collect()]
        if len(levels) > MAX_LEVELS:
            raise ValueError(f"{c} has more than {MAX_LEVELS} values; encode it by frequency or target")
        new += [F.coalesce(ident(c).cast("string") == F.lit(v), F.lit(False)).alias(f"{c}_{v}") for v in levels]
    return df.select(*[ident(c) for c in keep], *new)


def _lookup(df: DataFrame, c: str, values: DataFrame, out: str) -> DataFrame:
    """Replace column ``c`` by ``out`` of rows (__v, n, out), n being how many rows have the value.

    Up to ``SENT`` values are sent to every task, and no row of the table moves. Of more, the most frequent ones are; only rows of
    the others, none of which has many rows, are shuffled by value, and rows that have their value by then are dealt evenly.
    """
    values = cut(values.select("__v", "n", F.col(out).alias("__out")), "lookup")
    some = values.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).first()
    own, drop = df.withColumn("__v", ident(c)), [F.col("__out").alias(c) if x == c else ident(x) for x in df.columns]
    if some["k"] <= SENT:
        return own.join(F.broadcast(values.drop("n")), "__v", "left").select(*drop)
    hot = F.col("n") > some["n"] / SENT  # fewer than SENT values can be above that share
    first = own.join(F.broadcast(values.where(hot).select("__v", F.col("__out").alias("__hot"), F.lit(True).alias("__done"))), "__v", "left")
    done = F.coalesce(F.col("__done"), F.col("__v").isNull())
    first = first.withColumn("__salt", F.when(done, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)) + 1).otherwise(F.lit(0).cast("long")))
    rest = values.where(~hot).select("__v", "__out", F.lit(0).cast("long").alias("__salt"))
    # a row that is done has a salt that no value has, so it meets nothing
    return first.join(rest, ["__v", "__salt"], "left").withColumn("__out", F.coalesce("__out", "__hot")).select(*drop)


def encode_label(df, columns=None, target=None, order_by: str | None = None):
    """Codes 0, 1, ... by first appearance in the order of ``order_by``, or of the table's files and rows where none is
    given; null is -1."""
    for c in _pick(df, columns, _strings(df), target):
        first = ident(order_by) if order_by else F.monotonically_increasing_id()
        values = df.select(ident(c).alias("__v"), first.alias("__f")).where("__v is not null").groupBy("__v").agg(F.min("__f").alias("__f"), F.count(F.lit(1)).alias("n"), F.lit(1).cast("long").alias("__one"))
        values = cut(values, "label-values")
        codes = running(values.where("__f is not null"), ["__f", "__v"], {"code": "__one"}).select("__v", "n", (F.col("code") - 1).cast("int").alias("code"))
        df = _lookup(df, c, codes, "code").withColumn(c, F.coalesce(ident(c), F.lit(-1)))
    return df


def encode_frequency(df, columns=None, target=None):
    """Relative frequency among non-null values; null stays null."""
    for c in _pick(df, columns, _strings(df), target):
        n = df.where(ident(c).isNotNull()).groupBy(ident(c).alias("__v")).agg(F.count(F.lit(1)).alias("n"))
        df = _lookup(df, c, with_totals(n, [], total=F.sum("n")).select("__v", "n", (F.col("n") / F.col("total")).alias("f")), "f")
    return df


def encode_target(df, columns=None, target=None):
    """Mean of a numeric target per value, unsmoothed and in sample; null stays null. Nothing without columns; by
    frequency without a target."""
    if columns is None:
        return df
    if target is None or target not in df.columns:
        return encode_frequency(df, columns)
    for c in [c for c in columns if c in df.columns and c != target]:
        values = df.where(ident(c).isNotNull()).groupBy(ident(c).alias("__v")).agg(F.avg(real(target)).alias("m"), F.count(F.lit(1)).alias("n"))
        df = _lookup(df, c, values, "m")
    return df


def skip(df, columns=None, target=None):
    return df


ACTIONS = {
    f.__name__: f
    for f in (
        drop_high_missing, drop_duplicates, impute_mean, impute_median, impute_mode, impute_unknown, impute_knn, cap_outliers, remove_outliers, log_transform, sqrt_transform,
        yeo_johnson, scale_standard, scale_minmax, scale_robust, encode_onehot, encode_label, encode_frequency, encode_target, skip,
    )
} | {"keep_first": drop_duplicates}


def apply(df: DataFrame, action: str, columns: list[str] | None = None, target: str | None = None, **options) -> DataFrame:
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}; there are {', '.join(sorted(ACTIONS))}")
    return ACTIONS[action](df, columns, target, **options)
