"""Sections of a table's profile. Each returns a small tidy DataFrame; see ``plans.statplan`` for how they are fused."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.exprs import above, band, constant, count_where, deviation, ident, kurtosis, missing, mode, pearson, quantiles, ratio, real, sketching, skewness, variance
from assay.functions.special import chi2_tail, k2_test, kolmogorov_tail, shapiro_wilk
from assay.plans.kinds import kinds, of_kind, type_family
from assay.plans.ranks import running
from assay.plans.select import quantile_values
from assay.plans.statplan import cardinalities, frequencies, joint_counts, modes, of_column, per_column, per_number, unpivot, with_totals
from assay.plans.storage import cut


def _plain(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if type_family(f.dataType) != "nested"]


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, cells, missing cells and share, duplicate rows and share, estimated bytes.

    Nested columns are compared as JSON, since maps can't be grouped. An empty table has shares of zero.
    """
    k = len(df.columns)
    cells = [missing(ident(c)) for c in df.columns]
    width = sum((F.coalesce(F.sum(F.length(ident(f.name).cast("string"))), F.lit(0)) if type_family(f.dataType) == "string" else F.count(F.lit(1)) * 8 for f in df.schema if type_family(f.dataType) != "nested"), F.lit(0))
    base = df.agg(F.count(F.lit(1)).alias("n_rows"), sum(cells, F.lit(0)).cast("long").alias("missing_cells"), width.cast("long").alias("estimated_bytes"))
    both = base.crossJoin(F.broadcast(duplicates(df).select("duplicate_rows")))
    total = F.col("n_rows") * k
    return both.select(
        "n_rows", F.lit(k).cast("long").alias("n_columns"), total.alias("cells"), "missing_cells", F.coalesce(ratio(F.col("missing_cells") * 100.0, total), F.lit(0.0)).alias("missing_pct"),
        "duplicate_rows", F.coalesce(ratio(F.col("duplicate_rows") * 100.0, F.col("n_rows")), F.lit(0.0)).alias("duplicate_pct"), "estimated_bytes",
    )


def duplicates(df: DataFrame) -> DataFrame:
    """One row: number and share of rows beyond the first of their copies; nulls compare equal."""
    keys = [F.to_json(F.struct(ident(f.name))).alias(f.name) if type_family(f.dataType) == "nested" else ident(f.name) for f in df.schema]
    groups = df.select(*keys).groupBy(*[ident(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    d = F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long")
    return groups.agg(d.alias("duplicate_rows"), F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("n")).select(
        "duplicate_rows", F.coalesce(ratio(F.col("duplicate_rows") * 100.0, F.col("n")), F.lit(0.0)).alias("duplicate_pct"), (F.col("duplicate_rows") > 0).alias("has_duplicates")
    )


def missing_profile(df: DataFrame) -> DataFrame:
    """Columns with nulls: count, share of rows, severity (above 40 high, above 10 medium), whether likely at random (below 5)."""
    found = per_column(df, df.columns, lambda c: {"missing": missing(ident(c)), "n": F.count(F.lit(1))})
    pct = ratio(F.col("missing") * 100.0, F.col("n"))
    return (
        found.where("missing > 0")
        .select("column", "missing", pct.alias("missing_pct"))
        .withColumn("severity", above(F.col("missing_pct"), [(40, "high"), (10, "medium")], "low"))
        .withColumn("mcar_likely", F.col("missing_pct") < 5)
        .orderBy(F.desc("missing"), "column")
    )


def column_meta(df: DataFrame, target: str | None = None, found: dict[str, str] | None = None) -> DataFrame:
    """One row per column: type, kind, non-null and missing counts, distinct values, their share of all rows."""
    found = found or kinds(df)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    plain = _plain(df)
    counted = cardinalities(df, plain)
    pairs = [(c, types[c], found[c], c == target) for c in plain]
    meta = F.inline(F.array(*[F.struct(F.lit(a).alias("column"), F.lit(b).alias("dtype"), F.lit(k).alias("kind"), F.lit(t).alias("is_target")) for a, b, k, t in pairs]))
    named = df.sparkSession.range(1).select(meta)
    gone = F.col("n_rows") - F.col("count")
    return named.join(counted, "column", "left").select(
        "column", "dtype", "kind", F.coalesce("count", F.lit(0)).cast("long").alias("count"), F.coalesce(gone, F.lit(0)).cast("long").alias("missing"), F.coalesce(ratio(gone * 100.0, F.col("n_rows")), F.lit(0.0)).alias("missing_pct"),
        F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"), F.coalesce(ratio(F.col("n_unique") * 100.0, F.col("n_rows")), F.lit(0.0)).alias("unique_pct"), "is_target",
    )


def fences(df: DataFrame, columns: list[str], moments: bool = True) -> dict[str, tuple[float, float, float, float, float | None, float | None]]:
    """Per column with values: q1, q3, lower fence, upper fence, and with ``moments`` mean and population deviation (else None)."""
    found = quantile_values(df, columns, 0.25, 0.75)
    x, own = F.col("x"), [c for c in columns if found[c] is not None]
    more = {r["column"]: (r["m"], r["s"]) for r in per_number(df, own, {"m": F.avg(x), "s": F.when(~constant(x), F.stddev_pop(x))}).collect()} if moments and own else {}
    return {c: (a, b, a - 1.5 * (b - a), b + 1.5 * (b - a), *more.get(c, (None, None))) for c, (a, b) in ((c, found[c]) for c in own)}


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values outside the fences (1.5 IQR) and beyond three deviations, per column with at least four values.

    Columns without either kind are left out. With a zero IQR every other value counts, as no special case is made.
    """
    f = fences(df, columns)
    cs = [c for c in columns if c in f]
    if not cs:
        return df.sparkSession.createDataFrame([], "column string, count long, q1 double, q3 double, lower double, upper double, iqr_outliers long, z_outliers long, p5 double, p95 double, min double, max double, iqr_pct double")
    ends = quantile_values(df, cs, 0.05, 0.95)
    own = {k: {c: f[c][i] for c in cs} for i, k in enumerate(("q1", "q3", "lower", "upper", "m", "s"))} | {k: {c: ends[c][i] for c in cs} for i, k in enumerate(("p5", "p95"))}
    own["s"] = {c: v or None for c, v in own["s"].items()}
    x, same = F.col("x"), lambda k: F.max(k).cast("double").alias(k)
    got = per_number(df, cs, {
        "count": F.count(x), "q1": same("q1"), "q3": same("q3"), "lower": same("lower"), "upper": same("upper"), "iqr_outliers": count_where((x < F.col("lower")) | (x > F.col("upper"))),
        "z_outliers": count_where(F.abs(x - F.col("m").cast("double")) / F.col("s").cast("double") > 3), "p5": same("p5"), "p95": same("p95"), "min": F.min(x), "max": F.max(x),
    }, own).where("count >= 4 and (iqr_outliers > 0 or z_outliers > 0)")
    return got.withColumn("iqr_pct", ratio(F.col("iqr_outliers") * 100.0, F.col("count")))


def univariate_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments, quantiles, mode, zeros, negatives and coefficient of variation of each numeric column."""

    def moments(x: Column) -> dict[str, Column]:
        return {
            "count": F.count(x), "missing": missing(x), "mean": F.avg(x), "std": deviation(x), "variance": variance(x), "min": F.min(x), "max": F.max(x),
            "skewness": skewness(x), "kurtosis": kurtosis(x), "zeros": count_where(x == 0), "negatives": count_where(x < 0),
        }

    points = {"p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}
    if sketching(df):

        def atoms(c: str) -> dict[str, Column]:
            q = quantiles(real(c), *points.values())
            return moments(real(c)) | {k: q[i] for i, k in enumerate(points)} | {"mode": mode(real(c))}

        got = per_column(df, columns, atoms)
    else:
        at, top = quantile_values(df, columns, *points.values()), modes(df, columns)
        fixed = {k: {c: at[c] and at[c][i] for c in columns} for i, k in enumerate(points)} | {"mode": {c: top.get(c) for c in columns}}
        got = per_number(df, columns, moments(F.col("x")), zero=("count", "missing", "zeros", "negatives"))
        got = got.select("*", *[of_column(v).alias(k) for k, v in fixed.items()])
    order = ["column", "count", "missing", "mean", "median", "mode", "std", "variance", "min", "max", "q1", "q3", "p5", "p95", "skewness", "kurtosis", "zeros", "negatives"]
    return (
        got.select(*order)
        .withColumn("range", F.col("max") - F.col("min"))
        .withColumn("iqr", F.col("q3") - F.col("q1"))
        .withColumn("cv", ratio(F.col("std") * 100, F.col("mean")))
        .withColumn("skew_label", band(F.abs("skewness"), [(0.5, "approximately normal"), (1, "moderate")], "high"))
    )


def histogram(df: DataFrame, columns: list[str], bins: int = 40) -> DataFrame:
    """Rows (column, bin, lower, upper, n) of equal-width bins, empty ones included; a constant column has one bin."""
    ends = {r["column"]: (r["a"], r["b"]) for r in per_column(df, columns, lambda c: {"a": F.min(real(c)), "b": F.max(real(c))}).collect() if r["a"] is not None}
    if not ends:
        return df.sparkSession.createDataFrame([], "column string, bin int, lower double, upper double, n long")
    spark, cs = df.sparkSession, list(ends)
    edges = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for c, (a, b) in ends.items()])))
    last = F.when(F.col("a") == F.col("b"), 0).otherwise(bins - 1)
    spine = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), last)))
    cells = unpivot(df, cs, "double").where("value is not null").join(F.broadcast(edges), "column")
    width = F.col("b") - F.col("a")
    of = F.when(width == 0, 0).otherwise(F.least(F.floor(ratio((F.col("value") - F.col("a")) * bins, width)), F.lit(bins - 1))).cast("int")
    n = cells.groupBy("column", of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    step = (F.col("b") - F.col("a")) / bins
    full = spine.join(n, ["column", "bin"], "left")
    return full.select("column", "bin", (F.col("a") + F.col("bin") * step).alias("lower"), (F.col("a") + (F.col("bin") + 1) * step).alias("upper"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def univariate_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts, distinct values, top value, natural-log entropy of smoothed shares (1e-9 each), whether above 20 values."""
    f = frequencies(df, columns)
    some = f.where("value is not null")
    q = with_totals(some, ["column"], total=F.sum("n"), kinds=F.count(F.lit(1))).withColumn("p", F.col("n") / F.col("total") + 1e-9).withColumn("q", F.col("p") / (1 + F.col("kinds") * 1e-9))
    stats = q.groupBy("column").agg(
        F.sum("n").cast("long").alias("count"), F.count(F.lit(1)).cast("long").alias("n_unique"), (-F.sum(F.col("q") * F.log("q"))).alias("entropy"), F.max("n").cast("long").alias("top_count"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top_value"),
    )
    gone = f.groupBy("column").agg(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("missing"))
    return gone.join(stats, "column", "left").select(
        "column", F.coalesce("count", F.lit(0)).cast("long").alias("count"), "missing", F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"),
        ratio(F.col("n_unique") * 100.0, F.col("count")).alias("unique_pct"), "top_value", "top_count", ratio(F.col("top_count") * 100.0, F.col("count")).alias("top_pct"), "entropy",
        F.coalesce(F.col("n_unique") > 20, F.lit(False)).alias("high_cardinality"),
    )


def top_categories(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """The ``k`` most frequent values per column, ties by value: rank, count, share of non-null rows."""
    some = frequencies(df, columns).where("value is not null")
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))  # each task keeps its first k before the shuffle
    top = some.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(F.broadcast(some.groupBy("column").agg(F.sum("n").alias("total"))), "column").select("column", "rank", "value", "n", ratio(F.col("n") * 100.0, F.col("total")).alias("pct"))


def _pair_stats(df: DataFrame, pairs: list[tuple[str, str]], make) -> DataFrame:
    keyed = {f"{a}\x00{b}": (a, b) for a, b in pairs}
    got = per_column(df, list(keyed), lambda k: {"value": make(real(keyed[k][0]), real(keyed[k][1]))})
    parts = F.split("column", "\x00")
    return got.select(parts[0].alias("a"), parts[1].alias("b"), "value")


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (a, b, r) of every pair of columns, pairwise complete."""
    return _pair_stats(df, list(combinations(columns, 2)), pearson).withColumnRenamed("value", "r")


def strong_pairs(df: DataFrame, columns: list[str], k: int = 20) -> DataFrame:
    """Pairs with |r| above 0.5, strongest first, at most ``k``: above 0.9 very strong, above 0.7 strong."""
    got = pearson_pairs(df, columns).withColumn("strength", F.abs("r")).where("strength > 0.5")
    return got.withColumn("label", above(F.col("strength"), [(0.9, "very strong"), (0.7, "strong")], "moderate")).orderBy(F.desc("strength"), "a", "b").limit(k).drop("strength")


def covariance_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (a, b, covariance) of every pair and of each column with itself; sample covariance, pairwise complete."""
    pairs = [*combinations(columns, 2), *[(c, c) for c in columns]]
    return _pair_stats(df, pairs, F.covar_samp).withColumnRenamed("value", "covariance")


def skew_kurt(df: DataFrame, columns: list[str]) -> DataFrame:
    """Shape of each column with at least three values, and whether it wants a transform (|skewness| above 1)."""
    x = F.col("x")
    got = per_number(df, columns, {"count": F.count(x), "skewness": skewness(x), "kurtosis": kurtosis(x)}, zero=("count",)).where("count >= 3")
    s, k = F.col("skewness"), F.coalesce(F.col("kurtosis"), F.lit(0.0))
    return got.select(
        "column", "skewness", "kurtosis", F.when(s > 0, "right").when(s < 0, "left").otherwise("symmetric").alias("direction"),
        above(F.abs(s), [(2, "severe"), (1, "high"), (0.5, "moderate")], "normal").alias("severity"), F.when(k > 1, "leptokurtic").when(k < -1, "platykurtic").otherwise("mesokurtic").alias("tails"), (F.abs(s) > 1).alias("needs_transform"),
    )


def variance_rank(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance, deviation and coefficient of variation (of |mean|), lowest variance first; below 0.01 counts as low."""
    got = per_column(df, columns, lambda c: {"count": F.count(real(c)), "variance": variance(real(c)), "std": deviation(real(c)), "mean": F.avg(real(c))}).where("count >= 2")
    return got.select("column", "variance", "std", ratio(F.col("std") * 100, F.abs("mean")).alias("cv"), (F.col("variance") < 0.01).alias("low_variance")).orderBy("variance", "column")


def datetime_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """First and last moment and whole days between, per datetime column."""
    t = {c: ident(c).cast("timestamp") for c in columns}
    got = per_column(df, columns, lambda c: {"count": F.count(t[c]), "first": F.min(t[c]), "last": F.max(t[c])})
    days = F.floor((F.unix_micros("last") - F.unix_micros("first")) / 86_400_000_000)
    return got.select("column", "count", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), days.cast("long").alias("range_days"))


def datetime_parts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, part, value, n): years (the five most frequent), months and weekdays (Monday is 0)."""
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(p).alias("part"), f(ident(c)).alias("value")) for c in columns for p, f in (("year", F.year), ("month", F.month), ("weekday", F.weekday))])
    n = df.select(F.inline(parts)).where("value is not null").groupBy("column", "part", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("column", "part").orderBy(F.desc("n"), "value"))
    return n.withColumn("rank", rank).where("part <> 'year' or rank <= 5").drop("rank")


def text_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    """Average, least and greatest length, average number of words, share of distinct texts among non-null ones."""

    def atoms(c: str) -> dict[str, Column]:
        x = ident(c)
        words = F.when(x.isNotNull(), F.when(F.trim(F.regexp_replace(x, r"\s+", " ")) == "", 0).otherwise(F.regexp_count(x, F.lit(r"\S+"))))
        return {"count": F.count(x), "avg_length": F.avg(F.length(x)), "min_length": F.min(F.length(x)), "max_length": F.max(F.length(x)), "avg_words": F.avg(words)}

    unique = cardinalities(df, columns).select("column", ratio(F.col("n_unique") * 100.0, F.col("count")).alias("unique_pct"))
    return per_column(df, columns, atoms).join(unique, "column")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Classes of the target, most frequent first: count, share, and the table's imbalance (largest over smallest, above 2)."""
    n = df.where(ident(target).isNotNull()).groupBy(ident(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    n = with_totals(n, [], total=F.sum("n"), most=F.max("n"), fewest=F.min("n"), n_classes=F.count(F.lit(1)))
    r = F.col("most") / F.greatest("fewest", F.lit(1))
    return n.select("class", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"), "n_classes", r.alias("imbalance_ratio"), (r > 2).alias("is_imbalanced")).orderBy(F.desc("n"), "class")


def target_correlations(df: DataFrame, columns: list[str], target: str, k: int = 15) -> DataFrame:
    """Correlation of each numeric column with a numeric target and the line through it, strongest first."""
    y = real(target)

    def atoms(c: str) -> dict[str, Column]:
        return {"r": pearson(real(c), y), "slope": F.regr_slope(y, real(c)), "intercept": F.regr_intercept(y, real(c))}

    cs = [c for c in columns if c != target]
    return per_column(df, cs, atoms).where("r is not null").orderBy(F.desc(F.abs("r")), "column").limit(k)


def box_by_category(df: DataFrame, category: str, number: str, k: int = 10) -> DataFrame:
    """Five-number summaries of ``number`` within the ``k`` most frequent values of ``category``."""
    x = real(number)
    q = quantiles(x, 0.25, 0.5, 0.75)
    got = df.where(ident(category).isNotNull()).groupBy(ident(category).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("min"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), F.max(x).alias("max"))
    return got.orderBy(F.desc("n"), "category").limit(k)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (a, b, n, row_n, column_n, total) of the non-null pairs; margins over the aggregated table."""
    return joint_counts(df, [(a, b)], nulls=False).select("a", "b", "n", F.col("na").alias("row_n"), F.col("nb").alias("column_n"), "total")


def chi_square(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Independence tests: statistic (with Yates' correction for a 2 x 2 table), degrees of freedom, p-value, verdict.

    The statistic of all cells comes from those that occur: the missing ones add their expected counts, and those sum
    to the total less the expected counts of the cells that occur. Tables below 2 x 2 are left out. One read of the
    table serves all pairs, and one row per pair comes back.
    """
    spark, out = df.sparkSession, []
    e = F.col("na") * F.col("nb") / F.col("total")
    d = F.abs(F.col("n") - e)
    yates = d - F.least(F.lit(0.5), d)
    tests = joint_counts(df, pairs, nulls=False).groupBy("pair").agg(
        F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"), F.count(F.lit(1)).alias("cells"), F.max("total").alias("total"),
        F.sum(d * d / e).alias("plain"), F.sum(yates * yates / e).alias("yates"), F.sum(e).alias("e"),
    )
    for r in tests.collect() if pairs else []:
        a, b = r["pair"].split("\x00")
        if r["r"] < 2 or r["c"] < 2:
            continue
        dof = (r["r"] - 1) * (r["c"] - 1)
        empty = r["total"] - r["e"]
        stat = r["plain"] + empty
        if dof == 1:
            absent = 4 - r["cells"]
            stat = r["yates"] + sum((max(0.0, empty / absent - 0.5)) ** 2 / (empty / absent) for _ in range(absent) if empty > 0)
        p = chi2_tail(stat, dof)
        out.append((a, b, float(stat), p, int(dof), p < 0.05))
    out.sort(key=lambda x: (x[3], x[0], x[1]))
    return spark.createDataFrame(out, "a string, b string, statistic double, p_value double, dof long, dependent boolean")


def problem_type(df: DataFrame, target: str | None) -> DataFrame:
    """One row: the kind of learning problem a target poses, with confidence."""
    if target is None:
        return df.sparkSession.createDataFrame([("unknown", "low", 0)], "problem_type string, confidence string, n_unique long")
    kind = type_family(df.schema[target].dataType)
    c = ident(target)
    whole = F.coalesce(F.bool_and(real(target) == F.floor(real(target))), F.lit(False)) if kind == "numeric" else F.lit(False)
    n = F.col("n_unique")
    got = df.agg(F.count_distinct(c).alias("n_unique"), whole.alias("whole"))
    binary = F.lit(kind == "boolean") | (n == 2)
    few = F.lit(kind != "numeric")
    return got.select(
        F.when(binary, "binary classification").when(few | (F.col("whole") & (n <= 20)), "multiclass classification").otherwise("regression").alias("problem_type"),
        F.when(binary, "high").when(few, F.when(n <= 20, "high").otherwise("medium")).when(F.col("whole") & (n <= 20), "medium").otherwise("high").alias("confidence"),
        n,
    )


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows without replacement, the same on every run, every row as likely as any other.

    Equal rows are counted and the counts laid end to end in the order of the rows' hashes; ``n`` places of that line are
    drawn, so a row with many copies is drawn as often as its share asks for.
    """
    total = df.count()
    if total <= n:
        return df
    names = [f"c{i}" for i in range(len(df.columns))]
    hashed = [ident(f.name) for f in df.schema if type_family(f.dataType) != "nested"]
    own = [ident(f.name).alias(c) for f, c in zip(df.schema, names, strict=True)]
    counted = df.select(F.xxhash64(F.lit(seed), *hashed).alias("__h"), *own).groupBy("__h", *names).agg(F.count(F.lit(1)).alias("__n"))
    return _drawn(cut(counted, "sample"), names, total, n, seed).toDF(*df.columns)


#: Bits of a hash by which rows are dealt to the runs of a sample's line.
RUNS = 16


def _drawn(counted: DataFrame, names: list[str], total: int, n: int, seed: int) -> DataFrame:
    """The rows (``names``) at ``n`` of ``total`` places, each row of ``counted`` (__h, names, __n) filling __n places in order of __h.

    The line is cut into runs of equal leading bits, counted first; only rows of runs with a place are put in order, each run by itself.
    """
    import random
    from bisect import bisect_left

    import numpy as np
    import pyarrow as pa

    run_of = F.shiftright("__h", 64 - RUNS).cast("int")
    places, before, used = np.array(sorted(random.Random(seed).sample(range(total), n))), 0, []
    for r in sorted(counted.groupBy(run_of.alias("run")).agg(F.sum("__n").alias("n")).collect()):
        if bisect_left(places, before) < bisect_left(places, before + r["n"]):
            used.append((r["run"], before))
        before += r["n"]
    runs = counted.sparkSession.createDataFrame(used, "__run int, __before long")
    up = F.sum("__n").over(Window.partitionBy("__run").orderBy("__h").rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before")
    line = counted.withColumn("__run", run_of).join(F.broadcast(runs), "__run").withColumn("__up", up)

    def run(batches):
        for batch in batches:
            up, n_own = batch.column("__up").to_numpy(), batch.column("__n").to_numpy()
            times = np.searchsorted(places, up) - np.searchsorted(places, up - n_own)
            yield batch.select(names).take(pa.array(np.repeat(np.arange(len(up)), times)))

    return line.mapInArrow(run, counted.select(*names).schema)


NORMALITY_SAMPLE, QQ_SAMPLE = 5_000, 1_000


def normality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Shapiro-Wilk, D'Agostino K2 and Kolmogorov-Smirnov against the normal, per column with at least eight values.

    K2 and the KS distance use all rows in one aggregate and one sorted frequency table; Shapiro-Wilk is defined up to
    5,000 values and takes that many at random (fixed seed). A column counts as normal if both Shapiro and K2 have p above 0.05, a
    p of zero included.
    """
    x = F.col("x")
    g = {r["column"]: r for r in per_number(df, columns, {"n": F.count(x), "g1": F.skewness(x), "g2": F.kurtosis(x), "m": F.avg(x), "s": F.when(~constant(x), F.stddev_pop(x))}, zero=("n",)).collect()}
    cells = F.array(*[F.struct(F.lit(i).alias("i"), real(c).alias("v")) for i, c in enumerate(columns)])
    counted = cut(df.select(F.inline(cells)).where("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")), "values")  # one pass for all columns and tests
    out = []
    for i, (c, r) in enumerate((c, g[c]) for c in columns):
        if r["n"] < 8:
            continue
        if not r["s"]:
            out.append((c, int(r["n"]), None, None, None, None, None, None, False))
            continue
        own, n = counted.where(F.col("i") == i).select("v", "n"), int(r["n"])
        if n <= NORMALITY_SAMPLE:
            values = [v for v, times in own.collect() for _ in range(times)]
        else:
            values = [v[0] for v in _drawn(own.select(F.xxhash64(F.lit(42), "v").alias("__h"), "v", F.col("n").alias("__n")), ["v"], n, NORMALITY_SAMPLE, 42).collect()]
        w, pw = shapiro_wilk(values)
        k2, pk = k2_test(r["g1"], r["g2"], n)
        d = _ks_of_counts(own, r["m"], r["s"]).first()["d"]
        out.append((c, n, w, pw, k2, pk, d, kolmogorov_tail(d, n), pw > 0.05 and pk > 0.05))
    return df.sparkSession.createDataFrame(out, "column string, count long, shapiro double, shapiro_p double, k2 double, k2_p double, ks double, ks_p double, is_normal boolean")


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function in SQL, to 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, 1 - tail / 2).otherwise(tail / 2)


def ks_normal(df: DataFrame, column: str, mean: float, std: float) -> DataFrame:
    """One row: largest distance of the standardised column's empirical distribution from the normal one."""
    return _ks_of_counts(cut(df.select(real(column).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n")), "values"), mean, std)


def _ks_of_counts(v: DataFrame, mean: float, std: float) -> DataFrame:
    """``ks_normal`` of distinct values and their numbers (v, n)."""
    total = v.agg(F.sum("n").alias("total"))
    up = running(v, ["v"], {"up": "n"}).crossJoin(F.broadcast(total))  # one row of totals
    step = up.select("v", (F.col("up") / F.col("total")).alias("hi"), ((F.col("up") - F.col("n")) / F.col("total")).alias("lo"))
    p = normal_cdf((F.col("v") - mean) / std)
    return step.agg(F.max(F.greatest(F.abs(F.col("hi") - p), F.abs(p - F.col("lo")))).alias("d"))


def qq_points(df: DataFrame, column: str) -> DataFrame:
    """Rows (theoretical, sample): quantiles of at most 1,000 values against the normal's."""
    from assay.functions.special import NORMAL

    v = sorted(x[0] for x in sample_rows(df.select(real(column).alias("v")).where("v is not null"), QQ_SAMPLE).collect())
    rows = [(NORMAL.inv_cdf((i + 0.5) / len(v)), float(x)) for i, x in enumerate(v)]
    return df.sparkSession.createDataFrame(rows, "theoretical double, sample double")


def pca_ratio(df: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """Explained and cumulative variance of the principal components of the standardised complete rows.

    Eigenvalues of the correlation matrix, which one aggregate makes; constant columns carry no variance. ``enough``
    marks the first component with which 95 % is reached.
    """
    import numpy as np

    full = df.select(*[real(c).alias(c) for c in columns]).na.drop()
    n = full.count()
    if n < 4 or len(columns) < 2:
        raise ValueError("principal components need two columns and four complete rows")
    matrix = np.eye(len(columns))
    place = {c: i for i, c in enumerate(columns)}
    for r in pearson_pairs(full, columns).collect():
        i, j = place[r["a"]], place[r["b"]]
        matrix[i, j] = matrix[j, i] = r["r"] or 0.0
    equal = full.agg(*[constant(ident(c)) for c in columns]).first()
    for i, same in enumerate(equal):
        if same:
            matrix[i, i] = 0.0
    values = np.clip(np.sort(np.linalg.eigvalsh(matrix))[::-1], 0, None)
    share = values / values.sum() if values.sum() else values
    cum = np.cumsum(share)
    k = min(len(columns), n, most)
    enough = int(np.argmax(cum >= 0.95)) + 1 if (cum[:k] >= 0.95).any() else k
    rows = [(i + 1, float(share[i]), float(cum[i]), i + 1 == enough) for i in range(k)]
    return df.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double, enough boolean")


def numeric_columns(df: DataFrame) -> list[str]:
    return of_kind({f.name: type_family(f.dataType) for f in df.schema}, "numeric")
