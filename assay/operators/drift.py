"""Drift between a reference table and a newer one: PSI, Kolmogorov-Smirnov, chi-square, missing rates, schema."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.exprs import above, count_where, ident, quantiles, ratio
from assay.functions.special import chi2_tail, kolmogorov_tail
from assay.plans.kinds import drift_kind, type_family
from assay.plans.ranks import running
from assay.plans.statplan import unpivot, with_totals

#: Limits of the levels, and what an empty bin or category counts.
LEVELS = [(0.25, "Major"), (0.20, "Moderate"), (0.10, "Minor")]
FLOOR = 1e-4
SHARES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


def level(psi: Column) -> Column:
    return above(psi, LEVELS, "Negligible", strict=False)


def sides(ref: DataFrame, new: DataFrame, columns: list[str], cast: str) -> DataFrame:
    """Rows (column, value, is_new) of both tables' non-null values."""
    both = [unpivot(d, columns, cast).withColumn("is_new", F.lit(flag)) for d, flag in ((ref, False), (new, True))]
    return both[0].unionByName(both[1]).where("value is not null")


def _tables(ref: DataFrame, new: DataFrame, columns: list[str], cast: str) -> DataFrame:
    """Rows (column, value, r, n): frequencies on both sides; every later step works on distinct values only."""
    return sides(ref, new, columns, cast).groupBy("column", "value").agg(count_where(~F.col("is_new")).alias("r"), count_where(F.col("is_new")).alias("n"))


def psi_numeric(ref: DataFrame, new: DataFrame, columns: list[str], buckets: int = 10) -> DataFrame:
    """Rows (column, psi): equal-width bins over both tables' range, empty bins at a floor share, no renormalising.

    0 where one side has no values or all values are equal.
    """
    rows = sides(ref, new, columns, "double")
    ends = rows.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), count_where(~F.col("is_new")).alias("nr"), count_where(F.col("is_new")).alias("nn"))
    width = F.col("hi") - F.col("lo")
    at = F.least(F.floor(ratio((F.col("value") - F.col("lo")) * buckets, width)), F.lit(buckets - 1))
    bins = rows.join(F.broadcast(ends), "column").groupBy("column", at.alias("bin"), "nr", "nn").agg(count_where(~F.col("is_new")).alias("r"), count_where(F.col("is_new")).alias("n"))
    pr, pn = F.col("r") / F.when(F.col("nr") > 0, F.col("nr")), F.col("n") / F.when(F.col("nn") > 0, F.col("nn"))
    pr, pn = F.when(F.col("r") == 0, FLOOR).otherwise(pr), F.when(F.col("n") == 0, FLOOR).otherwise(pn)
    psi = F.abs(F.sum(F.when(F.col("bin").isNotNull() & (F.col("nr") > 0) & (F.col("nn") > 0), (pn - pr) * F.log(pn / pr))))  # a bin empty on both sides adds nothing
    return bins.groupBy("column").agg(F.coalesce(psi, F.lit(0.0)).alias("psi"))


def psi_categorical(ref: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, psi): categories missing on a side get a floor share, then both sides are renormalised."""
    t = _tables(ref, new, columns, "string")
    t = with_totals(t, ["column"], nr=F.sum("r"), nn=F.sum("n")).where("nr > 0 and nn > 0")
    t = t.withColumn("p", F.when(F.col("r") == 0, FLOOR).otherwise(F.col("r") / F.col("nr"))).withColumn("q", F.when(F.col("n") == 0, FLOOR).otherwise(F.col("n") / F.col("nn")))
    t = with_totals(t, ["column"], sp=F.sum("p"), sq=F.sum("q")).withColumn("p", F.col("p") / F.col("sp")).withColumn("q", F.col("q") / F.col("sq"))
    got = t.groupBy("column").agg(F.abs(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p")))).alias("psi"))
    every = ref.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("column"))
    return every.join(got, "column", "left").select("column", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def ks_two_sample(ref: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, ks, nr, nn): largest distance of the two empirical distributions, over distinct values."""
    t = _tables(ref, new, columns, "double")
    sums = t.groupBy("column").agg(F.sum("r").alias("nr"), F.sum("n").alias("nn")).where("nr > 0 and nn > 0")
    t = running(t, ["value"], {"cr": "r", "cn": "n"}, group=["column"]).join(F.broadcast(sums), "column")
    return t.groupBy("column").agg(F.max(F.abs(F.col("cr") / F.col("nr") - F.col("cn") / F.col("nn"))).alias("ks"), F.max("nr").alias("nr"), F.max("nn").alias("nn"))


def snapshots(ref: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, side, n, mean, std, median, p0, ..., p100) of each side; population deviation."""
    q = quantiles(F.col("value"), *SHARES)
    got = sides(ref, new, columns, "double").groupBy("column", F.when(F.col("is_new"), "new").otherwise("ref").alias("side"))
    got = got.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), q.alias("q"))
    return got.select("column", "side", "n", "mean", "std", F.col("q")[3].alias("median"), *[F.col("q")[i].alias(f"p{round(s * 100)}") for i, s in enumerate(SHARES)])


def numeric_drift(ref: DataFrame, new: DataFrame, columns: list[str], buckets: int = 10) -> DataFrame:
    """One record per numeric column: PSI, level, KS with p-value, absolute shifts of mean and deviation in percent.

    Below five values on a side there is no PSI, and ``error`` says so.
    """
    s = snapshots(ref, new, columns)
    wide = s.groupBy("column").agg(*[F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}") for side in ("ref", "new") for c in ("n", "mean", "std", "median")])
    got = wide.join(psi_numeric(ref, new, columns, buckets), "column", "left").join(ks_two_sample(ref, new, columns).select("column", "ks"), "column", "left")
    enough = (F.coalesce("ref_n", F.lit(0)) >= 5) & (F.coalesce("new_n", F.lit(0)) >= 5)
    shift = lambda c: F.when(enough, F.abs(F.col(f"new_{c}") - F.col(f"ref_{c}")) / F.greatest(F.abs(f"ref_{c}"), F.lit(1e-9)) * 100)
    got = got.withColumn("psi", F.when(enough, F.col("psi"))).withColumn("ks", F.when(enough, F.col("ks"))).withColumn("mean_shift_pct", shift("mean")).withColumn("std_shift_pct", shift("std"))
    rows = []
    for r in got.withColumn("level", F.when(enough, level(F.col("psi")))).collect():
        d = r.asDict()
        d["ks_p"] = kolmogorov_tail(d["ks"], d["ref_n"] * d["new_n"] / (d["ref_n"] + d["new_n"])) if d["ks"] is not None else None
        d["ks_significant"] = d["ks_p"] is not None and d["ks_p"] < 0.05
        d["error"] = None if d["psi"] is not None else "fewer than five values on a side"
        rows.append(d)
    fields = ["column", "ref_n", "new_n", "psi", "level", "ks", "ks_p", "ks_significant", "ref_mean", "new_mean", "mean_shift_pct", "ref_std", "new_std", "std_shift_pct", "ref_median", "new_median", "error"]
    kinds_ = ["string", "long", "long", "double", "string", "double", "double", "boolean", *["double"] * 8, "string"]
    return ref.sparkSession.createDataFrame([tuple(d[f] for f in fields) for d in rows], ", ".join(f"`{f}` {k}" for f, k in zip(fields, kinds_, strict=True)))


def category_churn(ref: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, category, change): categories that appeared or disappeared."""
    t = _tables(ref, new, columns, "string")
    return t.where("r = 0 or n = 0").select("column", F.col("value").alias("category"), F.when(F.col("r") == 0, "appeared").otherwise("disappeared").alias("change"))


def category_shares(ref: DataFrame, new: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """The ``k`` most frequent categories of each side: (column, side, rank, category, pct)."""
    t = _tables(ref, new, columns, "string")
    out = None
    for side, c in (("ref", "r"), ("new", "n")):
        some = t.where(F.col(c) > 0)
        s = some.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc(c), "value"))).where(F.col("rank") <= k)
        s = s.join(F.broadcast(some.groupBy("column").agg(F.sum(c).alias("total"))), "column").withColumn("pct", F.col(c) * 100.0 / F.col("total")).select("column", F.lit(side).alias("side"), "rank", F.col("value").alias("category"), "pct")
        out = s if out is None else out.unionByName(s)
    return out


def chi_square_fit(ref: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, chi2, dof): the new counts (plus one) against the reference's (plus one), scaled to equal totals."""
    t = _tables(ref, new, columns, "string")
    t = with_totals(t, ["column"], nn=F.sum(F.col("n") + 1), nr=F.sum(F.col("r") + 1))
    t = t.withColumn("e", (F.col("r") + 1) * F.col("nn") / F.col("nr"))
    return t.groupBy("column").agg(F.sum((F.col("n") + 1 - F.col("e")) ** 2 / F.col("e")).alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"))


#: Names of churned categories in one record; ``category_churn`` has all of them, whatever their number.
CHURN_NAMES = 100


def categorical_drift(ref: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """One record per categorical column: PSI, level, chi-square fit, distinct values and churned categories.

    A record shows the first ``CHURN_NAMES`` churned categories by name and counts all of them.
    """
    t = _tables(ref, new, columns, "string").groupBy("column").agg(
        count_where(F.col("r") > 0).alias("ref_unique"), count_where(F.col("n") > 0).alias("new_unique"),
        count_where(F.col("r") == 0).alias("n_appeared"), count_where(F.col("n") == 0).alias("n_disappeared"),
    )
    churn = category_churn(ref, new, columns)
    place = F.row_number().over(Window.partitionBy("column", "change").orderBy("category"))  # each task keeps its first names before the shuffle
    named = churn.withColumn("place", place).where(F.col("place") <= CHURN_NAMES).groupBy("column").agg(*[F.sort_array(F.collect_list(F.when(F.col("change") == c, F.col("category")))).alias(c) for c in ("appeared", "disappeared")])
    none = F.array().cast("array<string>")
    t = t.join(named, "column", "left").withColumns({c: F.coalesce(c, none) for c in ("appeared", "disappeared")})
    got = psi_categorical(ref, new, columns).join(chi_square_fit(ref, new, columns), "column", "left").join(t, "column", "left").withColumn("level", level(F.col("psi")))
    tail = {r["column"]: (chi2_tail(r["chi2"], r["dof"]) if r["dof"] else 1.0) for r in got.select("column", "chi2", "dof").where("chi2 is not null").collect()}
    p = F.create_map(*[F.lit(x) for kv in tail.items() for x in kv])[F.col("column")] if tail else F.lit(None).cast("double")
    return got.withColumn("chi2_p", p).select("column", "psi", "level", "chi2", "dof", "chi2_p", "ref_unique", "new_unique", "n_appeared", "n_disappeared", "appeared", "disappeared")


def missing_rate_drift(ref: DataFrame, new: DataFrame, columns: list[str], least: float = 3.0) -> DataFrame:
    """Columns whose share of nulls moved by at least ``least`` points: above 20 high, above 10 medium, else low."""
    out = None
    for d, side in ((ref, "ref"), (new, "new")):
        cells = F.array(*[F.struct(F.lit(c).alias("column"), ident(c).isNull().cast("double").alias("gone")) for c in columns])
        got = d.select(F.inline(cells)).groupBy("column").agg((F.avg("gone") * 100).alias(f"{side}_pct"))
        out = got if out is None else out.join(got, "column")
    delta = F.col("new_pct") - F.col("ref_pct")
    out = out.withColumn("delta", delta).where(F.abs("delta") >= least)
    return out.withColumn("severity", above(F.abs("delta"), [(20, "high"), (10, "medium")], "low")).withColumn("direction", F.when(F.col("delta") > 0, "up").otherwise("down")).orderBy(F.desc(F.abs("delta")), "column")


def schema_diff(ref: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (column, change, ref_type, new_type): columns that appeared, disappeared or changed type."""
    a, b = ({f.name: f.dataType.simpleString() for f in d.schema} for d in (ref, new))
    rows = [(c, "appeared", None, b[c]) for c in b if c not in a] + [(c, "disappeared", a[c], None) for c in a if c not in b]
    rows += [(c, "type changed", a[c], b[c]) for c in a if c in b and a[c] != b[c]]
    return ref.sparkSession.createDataFrame(sorted(rows), "column string, change string, ref_type string, new_type string")


def common_columns(ref: DataFrame, new: DataFrame, target: str | None = None) -> tuple[list[str], list[str]]:
    """Columns both tables have, without target and dates, as (numeric, categorical) by the reference's types."""
    names = [f for f in ref.schema if f.name in new.columns and f.name != target and type_family(f.dataType) != "nested"]
    return [f.name for f in names if drift_kind(f.dataType) == "numeric"], [f.name for f in names if drift_kind(f.dataType) == "categorical"]


VERDICTS = {
    "Major": "Distributions have moved far; retrain before relying on the model.",
    "Moderate": "Distributions have clearly moved; watch the model and plan to retrain.",
    "Minor": "Small movements within the usual; keep watching.",
    "Negligible": "Distributions are stable.",
}


def dataset_drift(ref: DataFrame, new: DataFrame, target: str | None = None, buckets: int = 10) -> DataFrame:
    """One row: mean PSI over columns (4 places), its level, columns per level, verdict. Too small columns don't count."""
    numbers, categories = common_columns(ref, new, target)
    parts = []
    if numbers:
        n = sides(ref, new, numbers, "double").groupBy("column").agg(F.least(count_where(~F.col("is_new")), count_where(F.col("is_new"))).alias("least"))
        parts.append(psi_numeric(ref, new, numbers, buckets).join(n.where("least >= 5"), "column", "left_semi"))
    if categories:
        parts.append(psi_categorical(ref, new, categories))
    if not parts:
        rows = ref.sparkSession.createDataFrame([], "column string, psi double")
    else:
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = rows.withColumn("level", level(F.col("psi")))
    got = rows.agg(F.coalesce(F.round(F.avg("psi"), 4), F.lit(0.0)).alias("avg_psi"), F.count(F.lit(1)).alias("n_columns"), *[count_where(F.col("level") == x).alias(f"n_{x.lower()}") for x in VERDICTS])
    text = F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv])
    return got.withColumn("level", level(F.col("avg_psi"))).withColumn("verdict", text[F.col("level")])


def report(ref: DataFrame, new: DataFrame, target: str | None = None, buckets: int = 10) -> dict:
    """The whole comparison as plain values."""
    numbers, categories = common_columns(ref, new, target)
    columns = [r.asDict() for r in numeric_drift(ref, new, numbers, buckets).collect()] if numbers else []
    columns += [r.asDict() for r in categorical_drift(ref, new, categories).collect()] if categories else []
    rank = {name: i for i, name in enumerate(VERDICTS)}
    columns.sort(key=lambda r: (rank.get(r["level"], 9), -(r["psi"] or 0.0), r["column"]))
    shared = [c for c in ref.columns if c in new.columns]
    return {
        **dataset_drift(ref, new, target, buckets).first().asDict(), "columns": columns,
        "missing": [r.asDict() for r in missing_rate_drift(ref, new, shared).collect()], "schema": [r.asDict() for r in schema_diff(ref, new).collect()],
    }
