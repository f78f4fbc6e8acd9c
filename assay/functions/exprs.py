"""Guarded column expressions: null and NaN alike count as missing, and nothing divides by zero under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ident(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean(df: DataFrame) -> DataFrame:
    """``df`` with NaN turned into null in float columns, the engine's single notion of missing."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(ident(c)), ident(c)) for c in floats}) if floats else df


def real(name: str) -> Column:
    return ident(name).cast("double")


def ratio(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)


def missing(c: Column) -> Column:
    return F.coalesce(F.sum(c.isNull().cast("long")), F.lit(0).cast("long"))


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0).cast("long"))


def constant(c: Column) -> Column:
    """Whether all values are equal. Deviations don't tell: merging partial means leaves traces of rounding."""
    return F.min(c) == F.max(c)


def variance(c: Column) -> Column:
    """Sample variance, exactly 0 for a constant."""
    return F.when((F.count(c) > 1) & constant(c), 0.0).otherwise(F.var_samp(c))


def deviation(c: Column) -> Column:
    return F.sqrt(variance(c))


def skewness(c: Column) -> Column:
    """Bias-adjusted skewness: null below three values, 0 for a constant."""
    n = F.count(c).cast("double")
    adjusted = F.skewness(c) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return F.when(n > 2, F.when(constant(c), 0.0).otherwise(adjusted))


def kurtosis(c: Column) -> Column:
    """Bias-adjusted excess kurtosis: null below four values, 0 for a constant."""
    n = F.count(c).cast("double")
    adjusted = (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(n > 3, F.when(constant(c), 0.0).otherwise(adjusted))


def pearson(a: Column, b: Column) -> Column:
    """Pairwise-complete correlation; null where either side is constant or fewer than two pairs exist."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    scale = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count(x) > 1) & ~constant(x) & ~constant(y), F.covar_pop(x, y) / F.when(scale != 0, scale))


#: Setting of the session: "exact" (default), or "sketch" for tables whose distinct values don't fit one task's memory.
MODE = "spark.assay.statistics"


def sketching(df: DataFrame | None = None) -> bool:
    """Whether quantiles, modes and distinct counts are sketched with bounded memory; read as a plan is made."""
    spark = df.sparkSession if df is not None else SparkSession.getActiveSession()
    mode = spark.conf.get(MODE, "exact") if spark is not None else "exact"
    if mode not in ("exact", "sketch"):
        raise ValueError(f"{MODE} is exact or sketch, not {mode!r}")
    return mode == "sketch"


def quantiles(c: Column, *at: float, exact: bool | None = None) -> Column:
    """Quantiles by linear interpolation; sketched (rank error below 1/10,000) in the sketching mode or on request."""
    points = F.array(*map(F.lit, at))
    return F.percentile(c, points) if (not sketching() if exact is None else exact) else F.percentile_approx(c, points, F.lit(10_000))


def quantile(c: Column, at: float, exact: bool | None = None) -> Column:
    return quantiles(c, at, exact=exact)[0]


def top_count(c: Column) -> Column:
    """How often the most frequent value occurs, from a sketch of 10,000 frequent items."""
    return F.coalesce(F.call_function("approx_top_k", c, F.lit(1), F.lit(10_000))[0]["count"], F.lit(0)).cast("long")


def mode(c: Column) -> Column:
    """The most frequent value, of equally frequent ones the least; from a sketch in the sketching mode."""
    return F.call_function("approx_top_k", c, F.lit(1), F.lit(10_000))[0]["item"] if sketching() else F.mode(c, True)


def band(value: Column, steps: list[tuple[float, object]], last: object, strict: bool = True) -> Column:
    """The label of the first step whose bound lies above ``value`` (or at it, if not strict)."""
    out = None
    for bound, label in steps:
        test = value < bound if strict else value <= bound
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(last))


def above(value: Column, steps: list[tuple[float, object]], last: object, strict: bool = True) -> Column:
    """The label of the first step whose bound lies below ``value``; steps run from the largest bound down."""
    out = None
    for bound, label in steps:
        test = value > bound if strict else value >= bound
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(last))
