"""Registered queries of the engine's operators over the driver's tables, and the same in SQL.

The tables hold no nulls and no copies, so ``lineitem_gaps`` and the like put them in by rule on both sides. Doubles
are rounded alike on both sides to nine significant digits, since sums differ in their last bits by order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.exprs import clean
from assay.operators import drift, interactions, leakage, profile, readiness, recommend, temporal, transforms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: Where nine-digit rounding cuts: not at one half, for short decimals often lie there and sums' last bits would decide.
SHIFT = 0.3819660113
#: Below this only the rounding of sums that cancel out is left.
FLOOR = 1e-14


def stable(df: DataFrame) -> DataFrame:
    """Doubles to nine significant digits; what is left of zero by rounding becomes zero."""

    def nine(v):
        k = F.lit(8) - F.floor(F.log10(F.abs(v)))
        up, down = F.pow(F.lit(10.0), k), F.pow(F.lit(10.0), -k)
        rounded = F.when(k >= 0, F.floor(v * up + SHIFT) / up).otherwise(F.floor(v / down + SHIFT) * down)
        return F.when(F.isnan(v), v).when(F.abs(v) < FLOOR, 0.0).when(v.isNotNull(), rounded)

    return df.withColumns({c: nine(F.col(f"`{c}`")) for c, t in df.dtypes if t == "double"})


def stable_sql(sql: str, doubles: str) -> str:
    """``sql`` with its double columns rounded as ``stable`` rounds them."""

    def nine(c: str) -> str:
        v = f'"{c}"::DOUBLE'
        k = f"(8 - floor(log10(abs({v}))))"
        return f"""CASE WHEN abs({v}) < {FLOOR} THEN 0 WHEN {k} >= 0 THEN floor({v} * pow(10.0::DOUBLE, {k}) + {SHIFT}::DOUBLE) / pow(10.0::DOUBLE, {k}) ELSE floor({v} / pow(10.0::DOUBLE, -{k}) + {SHIFT}::DOUBLE) * pow(10.0::DOUBLE, -{k}) END::DOUBLE AS "{c}\""""

    return f"SELECT * REPLACE ({', '.join(nine(c) for c in doubles.split())}) FROM ({sql}) AS found" if doubles else sql


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query; ``doubles`` names the SQL's double columns."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: stable(f(Tables(spark, sf_dir)))
        if sql:
            ORACLE_SQL[name] = stable_sql(sql, doubles)
        return f

    return put


GAPS = """SELECT * REPLACE (CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS l_tax,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE l_shipdate END AS l_shipdate,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
  CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_linestatus END AS l_linestatus) FROM lineitem"""
CUT = "TIMESTAMP '2024-01-16 00:00:00'"
REF = f"(SELECT value, event_type, CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id END AS user_id FROM events WHERE ts < {CUT})"
NEW = f"(SELECT value * 1.5 AS value, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'other' ELSE event_type END AS event_type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS user_id FROM events WHERE ts >= {CUT})"
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORIES = ["l_returnflag", "l_linestatus"]


class Tables:
    """The driver's tables, and those with nulls, copies and shifts put in by rule."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return clean(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))

    def gaps(self) -> DataFrame:
        gone = lambda m, c: F.when(F.col("l_orderkey") % m != 0, F.col(c))
        return self.lineitem.withColumns({c: gone(m, c) for m, c in ((7, "l_tax"), (3, "l_discount"), (2, "l_shipdate"), (11, "l_returnflag"), (50, "l_linestatus"))})

    def halves(self) -> tuple[DataFrame, DataFrame]:
        e, at = self.events, F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
        ref = e.where(F.col("ts") < at).select("value", "event_type", F.when(F.col("event_id") % 10 != 0, F.col("user_id")).alias("user_id"))
        first = e.agg(F.min("event_type")).first()[0]
        kind = F.when(F.col("event_type") == first, "other").otherwise(F.col("event_type"))
        new = e.where(F.col("ts") >= at).select((F.col("value") * 1.5).alias("value"), kind.alias("event_type"), F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("user_id"))
        return ref, new

    def priced(self) -> DataFrame:
        return self.lineitem.withColumn("net_price", F.col("l_extendedprice") * (1 - F.col("l_discount")))

    def skewed(self) -> DataFrame:
        """Events with a skewed positive column, a constant, and gaps."""
        return self.events.select("event_id", "event_type", "value", F.when(F.col("event_id") % 9 != 0, F.exp(F.col("value") / 100)).alias("growth"), F.lit(1).alias("one"), F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("user_id"))


SKEWED = "SELECT event_id, event_type, value, CASE WHEN event_id % 9 <> 0 THEN exp(value / 100) END AS growth, 1 AS one, CASE WHEN event_id % 2 = 0 THEN user_id END AS user_id FROM events"
PRICED = "SELECT *, l_extendedprice * (1 - l_discount) AS net_price FROM lineitem"


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def moments(c: str) -> dict[str, str]:
    return {
        "skewness": f"CASE WHEN count({c}) > 2 THEN CASE WHEN stddev_pop({c}) = 0 THEN 0 ELSE skewness({c}) END END",
        "kurtosis": f"CASE WHEN count({c}) > 3 THEN CASE WHEN stddev_pop({c}) = 0 THEN 0 ELSE kurtosis({c}) END END",
    }


# ---------------------------------------------------------------- profile

LINEITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()

query(
    "overview",
    f"""WITH t AS ({GAPS}) SELECT count(*) AS n_rows, 11::BIGINT AS n_columns, count(*) * 11 AS cells, ({' + '.join(f'(count(*) - count({c}))' for c in LINEITEM)})::BIGINT AS missing_cells,
    ({' + '.join(f'(count(*) - count({c}))' for c in LINEITEM)}) * 100.0::DOUBLE / (count(*) * 11) AS missing_pct, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)))::BIGINT AS duplicate_rows,
    (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t))) * 100.0::DOUBLE / count(*) AS duplicate_pct FROM t""",
    "missing_pct duplicate_pct",
)(lambda t: profile.overview(t.gaps()).drop("estimated_bytes"))
query(
    "duplicates",
    """WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity)
    SELECT sum(n - 1)::BIGINT AS duplicate_rows, sum(n - 1) * 100.0::DOUBLE / sum(n) AS duplicate_pct, sum(n - 1) > 0 AS has_duplicates FROM g""",
    "duplicate_pct",
)(lambda t: profile.duplicates(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity")))
query(
    "missing_profile",
    f"""WITH t AS ({GAPS}), m AS ({union(f"SELECT '{c}' AS column, count(*) - count({c}) AS missing, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS missing_pct FROM t" for c in LINEITEM)})
    SELECT *, CASE WHEN missing_pct > 40 THEN 'high' WHEN missing_pct > 10 THEN 'medium' ELSE 'low' END AS severity, missing_pct < 5 AS mcar_likely FROM m WHERE missing > 0""",
    "missing_pct",
)(lambda t: profile.missing_profile(t.gaps()))
META = {"o_orderkey": ("bigint", "numeric"), "o_custkey": ("bigint", "numeric"), "o_orderstatus": ("string", "categorical"), "o_totalprice": ("double", "numeric"), "o_orderdate": ("timestamp_ntz", "datetime"), "o_orderpriority": ("string", "categorical")}
query(
    "column_meta",
    union(
        f"SELECT '{c}' AS column, '{d}' AS dtype, '{k}' AS kind, count({c}) AS count, count(*) - count({c}) AS missing, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS missing_pct, count(DISTINCT {c}) AS n_unique, count(DISTINCT {c}) * 100.0::DOUBLE / count(*) AS unique_pct, {str(c == 'o_orderstatus').lower()} AS is_target FROM orders"
        for c, (d, k) in META.items()
    ),
    "missing_pct unique_pct",
)(lambda t: profile.column_meta(t.orders, "o_orderstatus"))


def outliers_sql(table: str, columns: list[str]) -> str:
    return union(
        f"""SELECT * FROM (WITH f AS (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3, quantile_cont({c}::DOUBLE, 0.05) AS p5, quantile_cont({c}::DOUBLE, 0.95) AS p95,
        min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, avg({c}) AS m, stddev_pop({c}) AS s FROM {table})
        SELECT '{c}' AS column, count({c}) AS count, any_value(q1) AS q1, any_value(q3) AS q3, any_value(q1 - 1.5 * (q3 - q1)) AS lower, any_value(q3 + 1.5 * (q3 - q1)) AS upper,
        count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS iqr_outliers, count(*) FILTER (s > 0 AND abs({c} - m) / s > 3) AS z_outliers,
        any_value(p5) AS p5, any_value(p95) AS p95, any_value(min) AS min, any_value(max) AS max,
        count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0::DOUBLE / count({c}) AS iqr_pct FROM {table}, f) WHERE count >= 4 AND (iqr_outliers > 0 OR z_outliers > 0)"""
        for c in columns
    )


FIVE = "q1 q3 lower upper p5 p95 min max iqr_pct"
query("iqr_outliers", outliers_sql("events", ["value", "user_id"]), FIVE)(lambda t: profile.iqr_outliers(t.events, ["value", "user_id"]))
query("iqr_outliers_documents", outliers_sql("documents", ["n_chars"]), FIVE)(lambda t: profile.iqr_outliers(t.documents, ["n_chars"]))
query("iqr_outliers_zero_iqr", outliers_sql("labels", ["quality", "toxic"]), FIVE)(lambda t: profile.iqr_outliers(t.labels, ["quality", "toxic"]))


def numeric_sql(table: str, columns: list[str]) -> str:
    one = lambda c: f"""SELECT '{c}' AS column, count({c}) AS count, count(*) - count({c}) AS missing, avg({c}::DOUBLE) AS mean, quantile_cont({c}::DOUBLE, 0.5) AS median,
      (SELECT {c}::DOUBLE FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode, stddev_samp({c}::DOUBLE) AS std, var_samp({c}::DOUBLE) AS variance, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
      quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3, quantile_cont({c}::DOUBLE, 0.05) AS p5, quantile_cont({c}::DOUBLE, 0.95) AS p95, {moments(c)['skewness']} AS skewness, {moments(c)['kurtosis']} AS kurtosis,
      count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives FROM t"""  # noqa: E731
    return f"""WITH t AS ({table}), u AS ({union(one(c) for c in columns)}) SELECT *, max - min AS range, q3 - q1 AS iqr, std * 100 / CASE WHEN mean <> 0 THEN mean END AS cv,
      CASE WHEN abs(skewness) < 0.5 THEN 'approximately normal' WHEN abs(skewness) < 1 THEN 'moderate' ELSE 'high' END AS skew_label FROM u"""


query("univariate_numeric", numeric_sql(GAPS, NUMBERS), "mean median mode std variance min max q1 q3 p5 p95 skewness kurtosis range iqr cv")(lambda t: profile.univariate_numeric(t.gaps(), NUMBERS))
query("univariate_numeric_skewed", numeric_sql(SKEWED, ["value", "growth", "one"]), "mean median mode std variance min max q1 q3 p5 p95 skewness kurtosis range iqr cv")(lambda t: profile.univariate_numeric(t.skewed(), ["value", "growth", "one"]))


def categorical_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column, sum(n)::BIGINT AS count, any_value(gone) AS missing, count(*) AS n_unique, count(*) * 100.0::DOUBLE / sum(n) AS unique_pct, arg_min(v, rk) AS top_value, max(n)::BIGINT AS top_count,
      max(n) * 100.0::DOUBLE / sum(n) AS top_pct, -sum(q * ln(q)) AS entropy, count(*) > 20 AS high_cardinality
      FROM (SELECT *, p / sum(p) OVER () AS q, row_number() OVER (ORDER BY n DESC, v) AS rk, (SELECT count(*) - count({c}) FROM t) AS gone FROM (SELECT {c}::VARCHAR AS v, count(*) AS n, count(*)::DOUBLE / (SELECT count({c}) FROM t) + 1e-9::DOUBLE AS p FROM t WHERE {c} IS NOT NULL GROUP BY 1))"""


query("univariate_categorical", f"WITH t AS ({GAPS}) {union(f'SELECT * FROM ({categorical_sql(c)})' for c in CATEGORIES)}", "unique_pct top_pct entropy")(lambda t: profile.univariate_categorical(t.gaps(), CATEGORIES))
query(
    "top_categories",
    union(
        f"SELECT * FROM (SELECT '{c}' AS column, row_number() OVER (ORDER BY count(*) DESC, {c})::INTEGER AS rank, {c} AS value, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM part GROUP BY {c}) WHERE rank <= 10"
        for c in ("p_brand", "p_type")
    ),
    "pct",
)(lambda t: profile.top_categories(t.part, ["p_brand", "p_type"]))
query(
    "histogram",
    """WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events), n AS (SELECT least(floor((value - a) * 40 / (b - a)), 39)::INTEGER AS bin, count(*) AS n FROM events, e GROUP BY 1)
    SELECT 'value' AS column, r.bin::INTEGER AS bin, a + r.bin * ((b - a) / 40) AS lower, a + (r.bin + 1) * ((b - a) / 40) AS upper, coalesce(n.n, 0)::BIGINT AS n FROM e, range(40) r(bin) LEFT JOIN n ON n.bin = r.bin""",
    "lower upper",
)(lambda t: profile.histogram(t.events, ["value"]))


def corr_sql(a: str, b: str) -> str:
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def pairs_of(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


FOUR = [*NUMBERS, "l_linenumber"]
query("pearson_matrix", f"WITH t AS ({GAPS}) {union(f'''SELECT '{a}' AS a, '{b}' AS b, {corr_sql(a, b)} AS r FROM t''' for a, b in pairs_of(FOUR))}", "r")(lambda t: profile.pearson_pairs(t.gaps(), FOUR))
query("covariance_matrix", f"WITH t AS ({GAPS}) {union(f'''SELECT '{a}' AS a, '{b}' AS b, covar_samp({a}, {b}) AS covariance FROM t''' for a, b in [*pairs_of(FOUR), *[(c, c) for c in FOUR]])}", "covariance")(lambda t: profile.covariance_matrix(t.gaps(), FOUR))
STRONG = ["l_quantity", "l_extendedprice", "net_price", "l_discount"]
query(
    "strong_pairs",
    f"""WITH t AS ({PRICED}), p AS ({union(f"SELECT '{a}' AS a, '{b}' AS b, {corr_sql(a, b)} AS r FROM t" for a, b in pairs_of(STRONG))})
    SELECT *, CASE WHEN abs(r) > 0.9 THEN 'very strong' WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS label FROM p WHERE abs(r) > 0.5 ORDER BY abs(r) DESC LIMIT 20""",
    "r",
)(lambda t: profile.strong_pairs(t.priced(), STRONG))
query(
    "skew_kurt",
    f"""WITH t AS ({SKEWED}), u AS ({union(f"SELECT '{c}' AS column, count({c}) AS n, {moments(c)['skewness']} AS skewness, {moments(c)['kurtosis']} AS kurtosis FROM t" for c in ('value', 'growth', 'one'))})
    SELECT "column", skewness, kurtosis, CASE WHEN skewness > 0 THEN 'right' WHEN skewness < 0 THEN 'left' ELSE 'symmetric' END AS direction,
    CASE WHEN abs(skewness) > 2 THEN 'severe' WHEN abs(skewness) > 1 THEN 'high' WHEN abs(skewness) > 0.5 THEN 'moderate' ELSE 'normal' END AS severity,
    CASE WHEN kurtosis > 1 THEN 'leptokurtic' WHEN kurtosis < -1 THEN 'platykurtic' ELSE 'mesokurtic' END AS tails, abs(skewness) > 1 AS needs_transform FROM u WHERE n >= 3""",
    "skewness kurtosis",
)(lambda t: profile.skew_kurt(t.skewed(), ["value", "growth", "one"]))
query(
    "variance_rank",
    union(f"SELECT '{c}' AS column, var_samp({c}) AS variance, stddev_samp({c}) AS std, stddev_samp({c}) * 100 / abs(nullif(avg({c}), 0)) AS cv, var_samp({c}) < 0.01 AS low_variance FROM lineitem" for c in NUMBERS),
    "variance std cv",
)(lambda t: profile.variance_rank(t.lineitem, NUMBERS))
query(
    "datetime_parts",
    """WITH n AS (SELECT 'year' AS part, year(o_orderdate)::INTEGER AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'month', month(o_orderdate)::INTEGER, count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'weekday', (isodow(o_orderdate) - 1)::INTEGER, count(*) FROM orders GROUP BY 2), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, value) AS rank FROM n)
    SELECT 'o_orderdate' AS column, part, value, n FROM r WHERE part <> 'year' OR rank <= 5""",
)(lambda t: profile.datetime_parts(t.orders, ["o_orderdate"]))
query(
    "datetime_ranges",
    union(f"SELECT '{c}' AS column, count({c}) AS count, strftime(min({c}), '%Y-%m-%d %H:%M:%S') AS first, strftime(max({c}), '%Y-%m-%d %H:%M:%S') AS last, floor((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000.0)::BIGINT AS range_days FROM {t}" for c, t in (("o_orderdate", "orders"),)),
)(lambda t: profile.datetime_ranges(t.orders, ["o_orderdate"]))
query(
    "text_lengths",
    union(
        f"SELECT 'text' AS column, count(text) AS count, avg(length(text)) AS avg_length, min(length(text))::INTEGER AS min_length, max(length(text))::INTEGER AS max_length, avg(len(regexp_extract_all(text, '\\S+'))) AS avg_words, count(DISTINCT text) * 100.0::DOUBLE / count(text) AS unique_pct FROM {t}"
        for t in ("conversations",)
    ),
    "avg_length avg_words unique_pct",
)(lambda t: profile.text_lengths(t.conversations, ["text"]))


def balance_sql(table: str, c: str) -> str:
    return f"""WITH n AS (SELECT {c}::VARCHAR AS class, count(*) AS n FROM {table} GROUP BY 1) SELECT class, n, n * 100.0::DOUBLE / sum(n) OVER () AS pct, count(*) OVER () AS n_classes,
    max(n) OVER ()::DOUBLE / greatest(min(n) OVER (), 1) AS imbalance_ratio, max(n) OVER ()::DOUBLE / greatest(min(n) OVER (), 1) > 2 AS is_imbalanced FROM n"""


query("class_balance", balance_sql("labels", "quality"), "pct imbalance_ratio")(lambda t: profile.class_balance(t.labels, "quality"))
query("class_balance_orders", balance_sql("orders", "o_orderstatus"), "pct imbalance_ratio")(lambda t: profile.class_balance(t.orders, "o_orderstatus"))
query(
    "feature_target",
    f"""WITH t AS ({PRICED}), u AS ({union(f"SELECT '{c}' AS column, {corr_sql(c, 'net_price')} AS r, regr_slope(net_price, {c}) AS slope, regr_intercept(net_price, {c}) AS intercept FROM t" for c in ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'))})
    SELECT * FROM u WHERE r IS NOT NULL ORDER BY abs(r) DESC LIMIT 12""",
    "r slope intercept",
)(lambda t: profile.target_correlations(t.priced(), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "net_price", 12))
query(
    "box_by_category",
    """SELECT p_brand AS category, count(*) AS n, min(p_retailprice) AS min, quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.5) AS median, quantile_cont(p_retailprice, 0.75) AS q3, max(p_retailprice) AS max
    FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "min q1 median q3 max",
)(lambda t: profile.box_by_category(t.part, "p_brand", "p_retailprice"))


def chi_sql(a: str, b: str, yates: bool) -> str:
    d = "abs(coalesce(n, 0) - e)"
    y = f"{d} - least(0.5, {d})" if yates else d
    return f"""SELECT '{a}' AS a, '{b}' AS b, sum(pow({y}, 2) / e) AS statistic, ((SELECT count(*) FROM x) - 1) * ((SELECT count(*) FROM y) - 1) AS dof FROM
    (SELECT x.v AS v, y.v AS w, x.n * y.n / (SELECT count(*) FROM t)::DOUBLE AS e FROM x, y) g LEFT JOIN (SELECT {a} AS v, {b} AS w, count(*) AS n FROM t GROUP BY 1, 2) c ON c.v = g.v AND c.w = g.w"""


def chi_query(table: str, a: str, b: str, yates: bool = False) -> str:
    return f"WITH t AS (SELECT {a}, {b} FROM ({table}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL), x AS (SELECT {a} AS v, count(*) AS n FROM t GROUP BY 1), y AS (SELECT {b} AS v, count(*) AS n FROM t GROUP BY 1) {chi_sql(a, b, yates)}"


query("crosstab_chi2", chi_query(GAPS, "l_returnflag", "l_linestatus"), "statistic")(lambda t: profile.chi_square(t.gaps(), [("l_returnflag", "l_linestatus")]).drop("p_value", "dependent"))
query("crosstab_chi2_yates", chi_query("SELECT quality::VARCHAR AS quality, toxic::VARCHAR AS toxic FROM labels", "quality", "toxic", True), "statistic")(
    lambda t: profile.chi_square(t.labels.select(F.col("quality").cast("string"), F.col("toxic").cast("string")), [("quality", "toxic")]).drop("p_value", "dependent")
)
query(
    "problem_type",
    """SELECT 'orders' AS t, 'multiclass classification' AS problem_type, 'high' AS confidence, count(DISTINCT o_orderstatus) AS n_unique FROM orders HAVING count(DISTINCT o_orderstatus) BETWEEN 3 AND 20
    UNION ALL SELECT 'labels', 'binary classification', 'high', count(DISTINCT quality) FROM labels HAVING count(DISTINCT quality) = 2
    UNION ALL SELECT 'lineitem', 'multiclass classification', 'medium', count(DISTINCT l_linenumber) FROM lineitem HAVING count(DISTINCT l_linenumber) BETWEEN 3 AND 20 AND bool_and(l_linenumber = floor(l_linenumber))
    UNION ALL SELECT 'price', 'regression', 'high', count(DISTINCT l_extendedprice) FROM lineitem HAVING count(DISTINCT l_extendedprice) > 20""",
)(
    lambda t: profile.problem_type(t.orders, "o_orderstatus").withColumn("t", F.lit("orders"))
    .unionByName(profile.problem_type(t.labels, "quality").withColumn("t", F.lit("labels")))
    .unionByName(profile.problem_type(t.lineitem, "l_linenumber").withColumn("t", F.lit("lineitem")))
    .unionByName(profile.problem_type(t.lineitem, "l_extendedprice").withColumn("t", F.lit("price")))
)
query("normality")(lambda t: profile.normality(t.lineitem, NUMBERS))
query(
    "ks_normal",
    """WITH m AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events), v AS (SELECT value AS v, count(*) AS n FROM events GROUP BY 1), c AS (SELECT v, n, sum(n) OVER (ORDER BY v) / sum(n) OVER ()::DOUBLE AS hi, (sum(n) OVER (ORDER BY v) - n) / sum(n) OVER ()::DOUBLE AS lo FROM v),
    z AS (SELECT hi, lo, (v - m) / s AS z, abs((v - m) / s) / sqrt(2.0::DOUBLE) AS x FROM c, m), w AS (SELECT *, 1 / (1 + 0.3275911 * x) AS k FROM z),
    p AS (SELECT hi, lo, z, k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * exp(-x * x) AS tail FROM w)
    SELECT max(greatest(abs(hi - CASE WHEN z >= 0 THEN 1 - tail / 2 ELSE tail / 2 END), abs(CASE WHEN z >= 0 THEN 1 - tail / 2 ELSE tail / 2 END - lo))) AS d FROM p""",
    "d",
)(lambda t: profile.ks_normal(t.events, "value", *t.events.agg(F.avg("value"), F.stddev_pop("value")).first()))
query("qq_points")(lambda t: profile.qq_points(t.events, "value"))
query("pca_ratio")(lambda t: profile.pca_ratio(t.priced(), ["l_quantity", "l_extendedprice", "net_price", "l_discount", "l_tax"]))

# ---------------------------------------------------------------- time

def shift_sql(columns: dict[str, str]) -> str:
    return f"""WITH q AS (SELECT quantile_cont(epoch_us(ts)::DOUBLE, 0.25) AS a, quantile_cont(epoch_us(ts)::DOUBLE, 0.5) AS b, quantile_cont(epoch_us(ts)::DOUBLE, 0.75) AS c FROM events),
    e AS (SELECT *, CASE WHEN epoch_us(ts) <= a THEN 1 WHEN epoch_us(ts) <= b THEN 2 WHEN epoch_us(ts) <= c THEN 3 ELSE 4 END AS k FROM events, q),
    u AS ({union(f"SELECT '{c}' AS column, avg({x}) FILTER (k = 1) AS q1, avg({x}) FILTER (k = 2) AS q2, avg({x}) FILTER (k = 3) AS q3, avg({x}) FILTER (k = 4) AS q4 FROM e" for c, x in columns.items())})
    SELECT *, abs(q4 - q1) / greatest(abs(q1), 1e-9) * 100 AS drift_pct, abs(q4 - q1) / greatest(abs(q1), 1e-9) * 100 > 20 AS drifted FROM u"""


query(
    "temporal_quartile_shift",
    shift_sql({"value": "value", "user_id": "user_id", "grown": "value * event_id"}),
    "q1 q2 q3 q4 drift_pct",
)(lambda t: temporal.quartile_shift(t.events.withColumn("grown", F.col("value") * F.col("event_id")), "ts", ["value", "user_id", "grown"]))
query(
    "rolling_trend",
    "SELECT event_id AS key, ts AS time, value, avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS rolling FROM events",
    "value rolling",
)(lambda t: temporal.rolling_mean(t.events, "ts", "value", "event_id", 500).withColumn("time", F.col("time").cast("timestamp_ntz")))
query("temporal_awareness", f"SELECT *, 'ts' AS time FROM ({shift_sql({c: c for c in ('event_id', 'user_id', 'value')})})", "q1 q2 q3 q4 drift_pct")(lambda t: temporal.temporal_awareness(t.events))

# ---------------------------------------------------------------- interactions


def cramers_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, CASE WHEN least(count(DISTINCT x), count(DISTINCT y)) < 2 THEN 0 ELSE least(1.0, sqrt(greatest(0.0, sum(n * n / (nx * ny)::DOUBLE) - 1) / nullif(least(count(DISTINCT x), count(DISTINCT y)) - 1, 0))) END AS v
    FROM (SELECT x, y, n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM (SELECT coalesce({a}, '__missing__') AS x, coalesce({b}, '__missing__') AS y, count(*) AS n FROM t GROUP BY 1, 2))"""


query("cramers_v", f"WITH t AS ({GAPS}) {cramers_sql('l_returnflag', 'l_linestatus')}", "v")(lambda t: interactions.cramers_v(interactions.fill(t.gaps(), CATEGORIES), [("l_returnflag", "l_linestatus")]))


def eta_sql(g: str, x: str) -> str:
    return f"""SELECT '{g}' AS category, '{x}' AS number, coalesce(least(1.0, sum(n * pow(m - (SELECT avg({x}) FROM t), 2)) / nullif((SELECT var_pop({x}) * count({x}) FROM t), 0)), 0) AS eta2 FROM (SELECT {g}, count({x}) AS n, avg({x}) AS m FROM t WHERE {x} IS NOT NULL GROUP BY 1)"""


query("eta_squared", f"WITH t AS ({GAPS}) {union(f'SELECT * FROM ({eta_sql(g, x)})' for g in CATEGORIES for x in ('l_quantity', 'l_extendedprice'))}", "eta2")(
    lambda t: interactions.eta_squared(t.gaps(), [(g, x) for g in CATEGORIES for x in ("l_quantity", "l_extendedprice")])
)


def mi_sql(rows: str, a: str, b: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, greatest(0, mi) AS mi, coalesce(least(1.0, greatest(0.0, mi / nullif(sqrt(ha * hb), 0))), 0) AS score FROM (WITH j AS (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS n FROM {rows} GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM j),
    px AS (SELECT x, sum(n) AS n FROM j GROUP BY 1), py AS (SELECT y, sum(n) AS n FROM j GROUP BY 1)
    SELECT sum(j.n / t * ln(j.n * t / (px.n * py.n))) AS mi, (SELECT -sum(n / t * ln(n / t)) FROM px, t) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM py, t) AS hb FROM j JOIN px USING (x) JOIN py USING (y), t)"""


MI_PAIRS = [("l_extendedprice", "net_price"), ("l_quantity", "net_price")]
ROW_KEY = [c for c in LINEITEM if c != "l_shipdate"]  # all columns of a row, so that rows of equal keys are equal


def keyed_rows(t: Tables) -> DataFrame:
    return t.priced().withColumn("k", F.md5(F.concat_ws("|", *[F.col(c).cast("decimal(20,2)").cast("string") if c not in CATEGORIES else F.col(c) for c in ROW_KEY]).cast("binary")))


def bins_sql(columns: list[str], few: tuple[str, ...] = ()) -> str:
    key = "md5(concat_ws('|', " + ", ".join(c if c in CATEGORIES else f"{c}::DECIMAL(20,2)::VARCHAR" for c in ROW_KEY) + "))"
    return f"p AS (SELECT *, {key} AS k FROM ({PRICED})), b AS (SELECT {', '.join(f'{c}' if c in few else f'ntile(16) OVER (ORDER BY {c}, k) AS {c}' for c in columns)} FROM p)"


query("binned_mi", f"WITH {bins_sql(['l_extendedprice', 'net_price', 'l_quantity'])} {union(f'SELECT * FROM ({mi_sql('b', a, b)})' for a, b in MI_PAIRS)}", "mi score")(
    lambda t: interactions.mutual_information(interactions.binned(keyed_rows(t), ["l_extendedprice", "net_price", "l_quantity"], "k"), MI_PAIRS)
)
EVENT_BINS = "WITH b AS (SELECT ntile(16) OVER (ORDER BY value, event_id) AS value, ntile(16) OVER (ORDER BY user_id, event_id) AS user_id, ntile(16) OVER (ORDER BY value * value + event_id / 100.0, event_id) AS mixed FROM events)"
EVENT_PAIRS = [("value", "user_id"), ("value", "mixed"), ("user_id", "mixed")]
query("binned_mi_events", f"{EVENT_BINS} {union(f'SELECT * FROM ({mi_sql('b', a, b)})' for a, b in EVENT_PAIRS)}", "mi score")(
    lambda t: interactions.mutual_information(interactions.binned(t.events.select("event_id", "value", "user_id", (F.col("value") * F.col("value") + F.col("event_id") / 100.0).alias("mixed")), ["value", "user_id", "mixed"], "event_id"), EVENT_PAIRS)
)
STRENGTH = "CASE WHEN score >= 0.7 THEN 'Strong' WHEN score >= 0.4 THEN 'Moderate' WHEN score >= 0.15 THEN 'Weak' ELSE 'Negligible' END AS strength"
PAIR_NUMBERS = [c for c in LINEITEM if c not in (*CATEGORIES, "l_shipdate")] + ["net_price"]
query(
    "pair_scores",
    f"""WITH {bins_sql(PAIR_NUMBERS, ('l_linenumber', 'l_discount', 'l_tax'))}, t AS (SELECT * FROM p), s AS ({union([
        *[f"SELECT a, b, 'mutual_information' AS method, score FROM ({mi_sql('b', a, b)})" for a, b in pairs_of(PAIR_NUMBERS)],
        *[f"SELECT a, b, 'cramers_v' AS method, v AS score FROM ({cramers_sql(a, b)})" for a, b in pairs_of(CATEGORIES)],
        *[f"SELECT number AS a, category AS b, 'correlation_ratio' AS method, eta2 AS score FROM ({eta_sql(g, x)})" for g in CATEGORIES for x in PAIR_NUMBERS],
    ])}) SELECT *, {STRENGTH} FROM s""",
    "score",
)(lambda t: interactions.pair_scores(keyed_rows(t).drop("l_shipdate"), "k"))
SOME_EVENTS = f"{EVENT_BINS}, t AS (SELECT event_id, event_type, value, user_id FROM events)"
query(
    "target_scores",
    f"""{SOME_EVENTS}, s AS (SELECT 'user_id' AS column, 'mutual_information' AS method, mi AS score FROM ({mi_sql('b', 'user_id', 'value')}) UNION ALL
    SELECT 'event_type', 'correlation_ratio', eta2 FROM ({eta_sql('event_type', 'value')})) SELECT *, {STRENGTH} FROM s""",
    "score",
)(lambda t: interactions.target_scores(t.events.select("event_id", "event_type", "value", "user_id"), "value", "event_id"))
query(
    "interaction_matrix",
    f"""{SOME_EVENTS}, s AS (SELECT a, b, score FROM ({mi_sql('b', 'user_id', 'value')}) UNION ALL {union(f"SELECT number, category, eta2 FROM ({eta_sql('event_type', x)})" for x in ('value', 'user_id'))})
    SELECT a, b, score FROM s UNION ALL SELECT b, a, score FROM s UNION ALL {union(f"SELECT '{c}', '{c}', 1.0::DOUBLE" for c in ('value', 'user_id', 'event_type'))}""",
    "score",
)(lambda t: interactions.matrix(interactions.pair_scores(t.events.select("event_id", "event_type", "value", "user_id"), "event_id")))

# ---------------------------------------------------------------- drift


def psi_sql(c: str) -> str:
    return f"""WITH a AS (SELECT {c}::DOUBLE AS v, 0 AS s FROM {REF} WHERE {c} IS NOT NULL UNION ALL SELECT {c}::DOUBLE, 1 FROM {NEW} WHERE {c} IS NOT NULL), e AS (SELECT min(v) AS lo, max(v) AS hi, count(*) FILTER (s = 0) AS nr, count(*) FILTER (s = 1) AS nn FROM a),
    h AS (SELECT least(floor((v - lo) * 10 / (hi - lo)), 9) AS bin, count(*) FILTER (s = 0) AS r, count(*) FILTER (s = 1) AS n FROM a, e GROUP BY 1),
    p AS (SELECT CASE WHEN r = 0 THEN 1e-4::DOUBLE ELSE r / nr::DOUBLE END AS p, CASE WHEN n = 0 THEN 1e-4::DOUBLE ELSE n / nn::DOUBLE END AS q FROM h, e) SELECT '{c}' AS column, abs(sum((q - p) * ln(q / p))) AS psi FROM p"""


query("psi_numeric", union(f"SELECT * FROM ({psi_sql(c)})" for c in ("value", "user_id")), "psi")(lambda t: drift.psi_numeric(*t.halves(), ["value", "user_id"]))
CAT = f"""WITH a AS (SELECT event_type AS v, 0 AS s FROM {REF} UNION ALL SELECT event_type, 1 FROM {NEW}), c AS (SELECT v, count(*) FILTER (s = 0) AS r, count(*) FILTER (s = 1) AS n FROM a WHERE v IS NOT NULL GROUP BY 1)"""
query(
    "psi_categorical",
    f"""{CAT}, p AS (SELECT CASE WHEN r = 0 THEN 1e-4::DOUBLE ELSE r / (SELECT sum(r) FROM c)::DOUBLE END AS p, CASE WHEN n = 0 THEN 1e-4::DOUBLE ELSE n / (SELECT sum(n) FROM c)::DOUBLE END AS q FROM c),
    w AS (SELECT p / (SELECT sum(p) FROM p) AS p, q / (SELECT sum(q) FROM p) AS q FROM p) SELECT 'event_type' AS column, abs(sum((q - p) * ln(q / p))) AS psi FROM w""",
    "psi",
)(lambda t: drift.psi_categorical(*t.halves(), ["event_type"]))
query(
    "ks_two_sample",
    f"""WITH a AS (SELECT value AS v, 0 AS s FROM {REF} UNION ALL SELECT value, 1 FROM {NEW}), c AS (SELECT v, count(*) FILTER (s = 0) AS r, count(*) FILTER (s = 1) AS n FROM a GROUP BY 1),
    u AS (SELECT sum(r) OVER (ORDER BY v) AS cr, sum(n) OVER (ORDER BY v) AS cn, sum(r) OVER () AS nr, sum(n) OVER () AS nn FROM c) SELECT 'value' AS column, max(abs(cr / nr::DOUBLE - cn / nn::DOUBLE)) AS ks, max(nr)::BIGINT AS nr, max(nn)::BIGINT AS nn FROM u""",
    "ks",
)(lambda t: drift.ks_two_sample(*t.halves(), ["value"]))
query(
    "percentile_snapshot",
    union(
        f"SELECT 'value' AS column, '{s}' AS side, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.5) AS median, {', '.join(f'quantile_cont(value, {p / 100}) AS p{p}' for p in (0, 5, 25, 50, 75, 95, 100))} FROM {t}"
        for s, t in (("ref", REF), ("new", NEW))
    ),
    "mean std median p0 p5 p25 p50 p75 p95 p100",
)(lambda t: drift.snapshots(*t.halves(), ["value"]))
query(
    "missing_rate_drift",
    f"""WITH a AS ({union(f"SELECT '{c}' AS column, (SELECT (count(*) - count({c})) * 100.0::DOUBLE / count(*) FROM {REF}) AS ref_pct, (SELECT (count(*) - count({c})) * 100.0::DOUBLE / count(*) FROM {NEW}) AS new_pct" for c in ('value', 'event_type', 'user_id'))})
    SELECT *, new_pct - ref_pct AS delta, CASE WHEN abs(new_pct - ref_pct) > 20 THEN 'high' WHEN abs(new_pct - ref_pct) > 10 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN new_pct > ref_pct THEN 'up' ELSE 'down' END AS direction FROM a WHERE abs(new_pct - ref_pct) >= 3""",
    "ref_pct new_pct delta",
)(lambda t: drift.missing_rate_drift(*t.halves(), ["value", "event_type", "user_id"]))
query("category_churn", f"{CAT} SELECT 'event_type' AS column, v AS category, CASE WHEN r = 0 THEN 'appeared' ELSE 'disappeared' END AS change FROM c WHERE r = 0 OR n = 0")(lambda t: drift.category_churn(*t.halves(), ["event_type"]))
query(
    "category_shares",
    f"""{CAT} {union(f"SELECT * FROM (SELECT 'event_type' AS column, '{s}' AS side, row_number() OVER (ORDER BY {x} DESC, v)::INTEGER AS rank, v AS category, {x} * 100.0::DOUBLE / sum({x}) OVER () AS pct FROM c WHERE {x} > 0) WHERE rank <= 10" for s, x in (('ref', 'r'), ('new', 'n')))}""",
    "pct",
)(lambda t: drift.category_shares(*t.halves(), ["event_type"]))
query(
    "drift_chi2",
    f"""{CAT}, e AS (SELECT n + 1 AS n, (r + 1) * (SELECT sum(n + 1) FROM c) / (SELECT sum(r + 1) FROM c)::DOUBLE AS e FROM c) SELECT 'event_type' AS column, sum(pow(n - e, 2) / e) AS chi2, count(*) - 1 AS dof FROM e""",
    "chi2",
)(lambda t: drift.chi_square_fit(*t.halves(), ["event_type"]))
LEVEL = "CASE WHEN {0} >= 0.25 THEN 'Major' WHEN {0} >= 0.2 THEN 'Moderate' WHEN {0} >= 0.1 THEN 'Minor' ELSE 'Negligible' END"
DRIFT_PSI = union([*[f"SELECT psi FROM ({psi_sql(c)})" for c in ("value", "user_id")], f"SELECT psi FROM ({ORACLE_SQL['psi_categorical']})"])
query(
    "drift_dataset",
    f"""WITH p AS (SELECT psi, {LEVEL.format('psi')} AS level FROM ({DRIFT_PSI})), g AS (SELECT round(avg(psi), 4) AS avg_psi, count(*) AS n_columns, count(*) FILTER (level = 'Major') AS n_major, count(*) FILTER (level = 'Moderate') AS n_moderate,
    count(*) FILTER (level = 'Minor') AS n_minor, count(*) FILTER (level = 'Negligible') AS n_negligible FROM p) SELECT *, {LEVEL.format('avg_psi')} AS level FROM g""",
    "avg_psi",
)(lambda t: drift.dataset_drift(*t.halves()).drop("verdict"))
def record_sql(c: str) -> str:
    """One numeric record: the shifts are absolute."""
    return f"""WITH r AS (SELECT count({c}) AS n, avg({c}) AS m, stddev_pop({c}) AS s, quantile_cont({c}::DOUBLE, 0.5) AS q FROM {REF}), w AS (SELECT count({c}) AS n, avg({c}) AS m, stddev_pop({c}) AS s, quantile_cont({c}::DOUBLE, 0.5) AS q FROM {NEW}),
    a AS (SELECT {c} AS v, 0 AS s FROM {REF} UNION ALL SELECT {c}, 1 FROM {NEW}), f AS (SELECT v, count(*) FILTER (s = 0) AS x, count(*) FILTER (s = 1) AS y FROM a WHERE v IS NOT NULL GROUP BY 1),
    g AS (SELECT sum(x) OVER (ORDER BY v) / sum(x) OVER ()::DOUBLE AS x, sum(y) OVER (ORDER BY v) / sum(y) OVER ()::DOUBLE AS y FROM f), d AS (SELECT max(abs(x - y)) AS ks FROM g),
    e AS (SELECT ks, sqrt(r.n * w.n / (r.n + w.n)::DOUBLE) AS root FROM d, r, w), p AS (SELECT ks, 2 * sum((CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * j * j * pow((root + 0.12 + 0.11 / root) * ks, 2))) AS tail FROM e, range(1, 101) j(j) GROUP BY ks)
    SELECT '{c}' AS column, r.n AS ref_n, w.n AS new_n, psi, {LEVEL.format('psi')} AS level, ks, least(1.0, greatest(0.0, tail)) AS ks_p, tail < 0.05 AS ks_significant, r.m AS ref_mean, w.m AS new_mean, abs(w.m - r.m) / greatest(abs(r.m), 1e-9) * 100 AS mean_shift_pct,
    r.s AS ref_std, w.s AS new_std, abs(w.s - r.s) / greatest(abs(r.s), 1e-9) * 100 AS std_shift_pct, r.q AS ref_median, w.q AS new_median, NULL::VARCHAR AS error FROM r, w, p, ({psi_sql(c)}) z"""


RECORD = "psi ks ks_p ref_mean new_mean mean_shift_pct ref_std new_std std_shift_pct ref_median new_median"
query("drift_numeric_records", union(f"SELECT * FROM ({record_sql(c)})" for c in ("value", "user_id")), RECORD)(lambda t: drift.numeric_drift(*t.halves(), ["value", "user_id"]))
query(
    "drift_categorical_records",
    f"""WITH x AS ({CAT} SELECT count(*) FILTER (r > 0) AS ref_unique, count(*) FILTER (n > 0) AS new_unique, count(*) FILTER (r = 0) AS n_appeared, count(*) FILTER (n = 0) AS n_disappeared,
    coalesce(string_agg(v, ',' ORDER BY v) FILTER (r = 0), '') AS appeared, coalesce(string_agg(v, ',' ORDER BY v) FILTER (n = 0), '') AS disappeared FROM c)
    SELECT 'event_type' AS column, psi, {LEVEL.format('psi')} AS level, chi2, dof, x.* FROM x, ({ORACLE_SQL['psi_categorical']}) p, ({ORACLE_SQL['drift_chi2']}) q""",
    "psi chi2",
)(lambda t: drift.categorical_drift(*t.halves(), ["event_type"]).drop("chi2_p").withColumns({c: F.array_join(c, ",") for c in ("appeared", "disappeared")}))
query(
    "schema_diff",
    "SELECT * FROM (VALUES ('added', 'appeared', NULL, 'int'), ('props', 'disappeared', 'string', NULL), ('value', 'type changed', 'double', 'string')) AS v(\"column\", change, ref_type, new_type)",
)(lambda t: drift.schema_diff(t.events, t.events.withColumn("value", F.col("value").cast("string")).withColumn("added", F.lit(1)).drop("props")))

# ---------------------------------------------------------------- readiness and leakage

KINDS = {"l_orderkey": "numeric", "l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric", "l_tax": "numeric", "l_returnflag": "categorical", "l_linestatus": "categorical", "l_shipdate": "datetime", "net_price": "numeric"}


def label_sql(c: str) -> str:
    return f"CASE {c} WHEN 'A' THEN 'Production-ready' WHEN 'B' THEN 'Minor prep needed' WHEN 'C' THEN 'Moderate prep needed' WHEN 'D' THEN 'Significant issues' ELSE 'Critical — fix before training' END"


def readiness_sql() -> str:
    """Every dimension written out for the table with gaps and target net_price."""
    parts = []
    for c, k in KINDS.items():
        num = k == "numeric"
        x = f"{c}::DOUBLE" if num else "NULL::DOUBLE"
        fence = f"(SELECT [quantile_cont({c}::DOUBLE, 0.25), quantile_cont({c}::DOUBLE, 0.75)] FROM t)" if num else "[0.0, 0.0]"
        name = 98 if c == "net_price" else 50 if "price" in c.split("_") else 0
        parts.append(
            f"""SELECT '{c}' AS column, '{k}' AS kind, {num} AS num, {c == 'net_price'} AS is_target, {name}.0::DOUBLE AS risk, count(*) AS rows, count({c}) AS n, count(DISTINCT {c}) AS u, (SELECT max(n) FROM (SELECT count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c})) AS top,
            {moments(c)['skewness'] if num else 'NULL::DOUBLE'} AS skew, {moments(c)['kurtosis'] if num else 'NULL::DOUBLE'} AS kurt, {f"abs({corr_sql(c, 'net_price')})" if num and c != 'net_price' else 'NULL::DOUBLE'} AS r,
            any_value(f[2] - f[1]) AS iqr, count(*) FILTER ({x} < f[1] - 1.5 * (f[2] - f[1]) OR {x} > f[2] + 1.5 * (f[2] - f[1])) * 100.0::DOUBLE / count({c}) AS outp FROM t, (SELECT {fence} AS f)"""
        )
    return f"""WITH t AS (SELECT *, l_extendedprice * (1 - coalesce(l_discount, 0)) AS net_price FROM ({GAPS}) AS g), s AS ({union(parts)}), m AS (SELECT *, (rows - n) * 100.0::DOUBLE / rows AS gone FROM s),
    d AS (SELECT "column", kind, CASE WHEN gone = 0 THEN 100 WHEN gone < 2 THEN 95 WHEN gone < 5 THEN 88 WHEN gone < 15 THEN 70 WHEN gone < 30 THEN 48 WHEN gone < 50 THEN 22 ELSE 5 END::DOUBLE AS completeness,
    CASE WHEN NOT num THEN 85 WHEN n < 4 THEN 70 ELSE CASE WHEN abs(skew) < 0.5 THEN 70 WHEN abs(skew) < 1 THEN 60 WHEN abs(skew) < 2 THEN 42 WHEN abs(skew) < 3 THEN 22 ELSE 10 END + CASE WHEN abs(kurt) < 1 THEN 30 WHEN abs(kurt) < 3 THEN 24 WHEN abs(kurt) < 7 THEN 16 ELSE 8 END END::DOUBLE AS distribution,
    CASE WHEN kind IN ('numeric', 'datetime') THEN 95 WHEN u = 1 THEN 20 WHEN u = 2 THEN 100 WHEN u <= 10 THEN 95 WHEN u <= 20 THEN 82 WHEN u <= 50 THEN 65 WHEN u <= 100 THEN 45 WHEN u / n::DOUBLE > 0.9 THEN 10 ELSE 28 END::DOUBLE AS cardinality,
    CASE WHEN is_target THEN 100 ELSE 100 - greatest(risk, coalesce(CASE WHEN r > 0.97 THEN 95 WHEN r > 0.9 THEN 78 WHEN r > 0.8 THEN 55 WHEN r > 0.7 THEN 35 END, 0)) END::DOUBLE AS leakage_risk,
    CASE WHEN NOT num THEN 90 WHEN n < 4 OR iqr = 0 THEN 75 WHEN outp = 0 THEN 100 WHEN outp < 0.5 THEN 95 WHEN outp < 1 THEN 88 WHEN outp < 3 THEN 72 WHEN outp < 7 THEN 50 WHEN outp < 15 THEN 28 ELSE 10 END::DOUBLE AS outlier_severity,
    CASE kind WHEN 'numeric' THEN 95 WHEN 'datetime' THEN 68 ELSE 80 END::DOUBLE AS type_fitness, CASE WHEN n = 0 THEN 50 WHEN top / n::DOUBLE > 0.99 THEN 15 WHEN top / n::DOUBLE > 0.95 THEN 40 ELSE 100 END::DOUBLE AS consistency,
    gone AS missing_pct, skew, CASE WHEN num AND iqr > 0 THEN outp END AS outlier_pct, u AS n_unique, is_target FROM m),
    g AS (SELECT *, round((completeness * 2.5 + leakage_risk * 2.0 + outlier_severity * 1.5 + distribution + cardinality + type_fitness * 0.8 + consistency * 0.2) / 9.0, 1) AS total FROM d)
    SELECT *, {label_sql('grade')} AS label FROM (SELECT *, CASE WHEN total >= 90 THEN 'A' WHEN total >= 75 THEN 'B' WHEN total >= 60 THEN 'C' WHEN total >= 45 THEN 'D' ELSE 'F' END AS grade FROM g)"""


def ready(t: Tables) -> DataFrame:
    df = t.gaps().withColumn("net_price", F.col("l_extendedprice") * (1 - F.coalesce("l_discount", F.lit(0.0)))).select(*KINDS)
    return readiness.column_scores(df, "net_price")


DIMS = " ".join(readiness.WEIGHTS)
query("readiness_columns", readiness_sql(), f"{DIMS} total missing_pct skew outlier_pct")(ready)
query(
    "readiness_dataset",
    f"""WITH c AS ({readiness_sql()}), s AS (SELECT round(sum(total * CASE WHEN kind = 'numeric' THEN 1.5 ELSE 1 END) / sum(CASE WHEN kind = 'numeric' THEN 1.5 ELSE 1 END), 1) AS score, {', '.join(f'round(avg({d}), 1) AS {d}' for d in readiness.WEIGHTS)},
    {', '.join(f"count(*) FILTER (grade = '{g}') AS grade_{g.lower()}" for g in 'ABCDF')} FROM c) SELECT *, {label_sql('grade')} AS label FROM (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END AS grade FROM s)""",
    f"score {DIMS}",
)(lambda t: readiness.dataset_score(ready(t)))
query(
    "readiness_extremes",
    f"""WITH c AS ({readiness_sql()}) SELECT * FROM (SELECT 'worst' AS list, "column", total, grade FROM c WHERE NOT is_target AND grade IN ('D', 'F') ORDER BY total, "column" LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'best' AS list, "column", total, grade FROM c WHERE NOT is_target AND grade = 'A' ORDER BY total DESC, "column" LIMIT 5)""",
    "total",
)(lambda t: readiness.extremes(ready(t)))

LEAKY = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CORR = f"""SELECT "column", 'target_correlation' AS detector, CASE WHEN abs(r) >= 0.97 THEN 'critical' ELSE 'high' END AS severity, r AS detail FROM ({union(f"SELECT '{c}' AS column, {corr_sql(c, 'net_price')} AS r FROM t" for c in LEAKY)}) WHERE abs(r) >= 0.85"""
query("leak_target_corr", f"WITH t AS ({PRICED}) {CORR}", "detail")(lambda t: leakage.target_correlation(t.priced().select(*LEAKY, "net_price"), "net_price"))
query("leak_name", "SELECT * FROM (VALUES ('l_extendedprice', 'name_similarity', 'high', NULL::DOUBLE), ('net_price', 'name_similarity', 'high', NULL)) AS v(\"column\", detector, severity, detail)", "detail")(lambda t: leakage.name_similarity(t.priced(), "price"))
query("leak_suffix", "SELECT * FROM (VALUES ('order_status', 'derived_name', 'high', NULL::DOUBLE)) AS v(\"column\", detector, severity, detail)", "detail")(lambda t: leakage.derived_name(t.orders.withColumnRenamed("o_orderstatus", "order_status"), "o_orderstatus order"))


def id_sql(table: str, columns: dict[str, str]) -> str:
    return union(
        f"""SELECT '{c}' AS column, 'identifier' AS detector, CASE WHEN {named} THEN 'high' ELSE 'medium' END AS severity, count(DISTINCT {c}) / count({c})::DOUBLE AS detail FROM {table} HAVING count(DISTINCT {c}) / count({c})::DOUBLE > 0.95 AND count(DISTINCT {c}) > 50"""
        for c, named in columns.items()
    )


query("leak_id", id_sql("customer", {"c_custkey": "false", "c_name": "false", "c_nationkey": "false", "c_mktsegment": "false"}), "detail")(lambda t: leakage.identifiers(t.customer))
query(
    "leak_constant",
    f"""WITH t AS ({SKEWED}) {union(f"SELECT '{c}' AS column, 'constant' AS detector, 'medium' AS severity, count(DISTINCT {c})::DOUBLE AS detail FROM t HAVING count(DISTINCT {c}) <= 1" for c in ('event_id', 'event_type', 'value', 'growth', 'one', 'user_id'))}""",
    "detail",
)(lambda t: leakage.constants(t.skewed()))
query(
    "leak_future",
    "SELECT 'o_orderdate' AS column, 'future_data' AS detector, 'high' AS severity, count(*) FILTER (o_orderdate > TIMESTAMP '1998-01-01') * 100.0::DOUBLE / count(*) AS detail FROM orders HAVING count(*) FILTER (o_orderdate > TIMESTAMP '1998-01-01') > 0",
    "detail",
)(lambda t: leakage.future_data(t.orders, cutoff="1998-01-01 00:00:00"))
query(
    "leak_consolidated",
    f"""WITH t AS ({PRICED}), f AS (SELECT "column", detector, severity FROM ({CORR}))
    SELECT "column", detector, severity, 1::BIGINT AS n_findings FROM f""",
)(lambda t: leakage.consolidated(leakage.findings(t.priced().select(*LEAKY, "net_price"), "net_price")))


def recommend_sql(target: str) -> str:
    """The rules over the table with gaps; its columns' kinds are known."""
    numbers = [c for c in LINEITEM if c not in (*CATEGORIES, "l_shipdate")]
    part = lambda i, c: f"""SELECT {i} AS place, '{c}' AS c, {c in numbers} AS num, {c in CATEGORIES} AS cat, {c == target} AS is_target, (count(*) - count({c}))::DOUBLE / count(*) AS gone, count({c}) AS n, count(DISTINCT {c}) AS u,
      {f"(SELECT quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25) FROM t)" if c in numbers else 'NULL::DOUBLE'} AS iqr,
      {f"(SELECT count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) / count({c})::DOUBLE FROM t, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.75) AS b FROM t))" if c in numbers else 'NULL::DOUBLE'} AS outliers,
      {moments(c)['skewness'] if c in numbers else 'NULL::DOUBLE'} AS skew, {f'min({c})::DOUBLE' if c in numbers else 'NULL::DOUBLE'} AS least FROM t"""  # noqa: E731
    rules = {
        "drop_high_miss": "gone > 0.4", "impute_num": "num AND gone > 0.05 AND gone <= 0.4", "impute_cat": "cat AND gone > 0.05 AND gone <= 0.4", "outliers": "num AND NOT is_target AND iqr > 0 AND n >= 4 AND outliers > 0.05",
        "skew": "num AND NOT is_target AND n > 2 AND abs(skew) > 1.5 AND least > 0", "scale": "num AND NOT is_target", "enc_low": "cat AND NOT is_target AND u <= 15", "enc_high": "cat AND NOT is_target AND u > 15",
    }
    offer = lambda k: f"'{recommend.OFFERS[k][0]}' AS category, '{recommend.OFFERS[k][1]}' AS severity"
    out = [f"SELECT '{k}' AS id, {offer(k)}, string_agg(c, ',' ORDER BY place) AS affected, '{','.join(recommend.OFFERS[k][2])}' AS actions FROM s WHERE {rule} HAVING count(*) > 0" for k, rule in rules.items()]
    out.append(f"SELECT 'dups', {offer('dups')}, '', '{','.join(recommend.OFFERS['dups'][2])}' WHERE (SELECT count(*) FROM t) > (SELECT count(*) FROM (SELECT DISTINCT * FROM t))")
    return f"WITH t AS ({GAPS}), s AS ({union(part(i, c) for i, c in enumerate(LINEITEM))}) {union(f'SELECT * FROM ({x})' for x in out)}"


query("recommendations", recommend_sql("l_quantity"))(lambda t: recommend.recommendations(t.gaps(), "l_quantity").withColumns({c: F.array_join(c, ",") for c in ("affected", "actions")}))

# ---------------------------------------------------------------- transforms

KEYED = f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax, l_returnflag FROM ({GAPS}) AS g"


def keyed(t: Tables) -> DataFrame:
    return t.gaps().select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")


GAPPY = ["l_discount", "l_tax"]


def transform_query(action: str, exprs: dict[str, str] | None, columns: list[str], where: str = "", table: str = KEYED, frame=keyed, doubles: str = "", target: str | None = None, **options) -> None:
    sql = None
    if exprs is not None:
        swap = ", ".join(f"{e} AS {c}" for c, e in exprs.items())
        sql = f"WITH t AS ({table}) SELECT * {f'REPLACE ({swap})' if swap else ''} FROM t {where}"
    query(f"t_{action}", sql, doubles)(lambda t: transforms.apply(frame(t), action, columns, target, **options))


NUM = "l_quantity l_discount l_tax"
transform_query("impute_mean", {c: f"coalesce({c}, (SELECT avg({c}) FROM t))" for c in GAPPY}, GAPPY, doubles=NUM)
transform_query("impute_median", {c: f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM t))" for c in GAPPY}, GAPPY, doubles=NUM)
transform_query("impute_mode", {c: f"coalesce({c}, (SELECT {c} FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1))" for c in [*GAPPY, "l_returnflag"]}, [*GAPPY, "l_returnflag"], doubles=NUM)
transform_query("impute_unknown", {"l_returnflag": "coalesce(l_returnflag, 'Unknown')"}, ["l_returnflag"], doubles=NUM)
fence = lambda c, s: f"(SELECT quantile_cont({c}, {0.25 if s < 0 else 0.75}) {'-' if s < 0 else '+'} 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM t)"
EVENTS = "SELECT event_id, value, CASE WHEN event_id % 9 <> 0 THEN value * value END AS square FROM events"


def events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "value", F.when(F.col("event_id") % 9 != 0, F.col("value") * F.col("value")).alias("square"))


BOTH = ["value", "square"]
transform_query("cap_outliers", {c: f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {fence(c, -1)}), {fence(c, 1)}) END" for c in BOTH}, BOTH, table=EVENTS, frame=events, doubles="value square")
transform_query("remove_outliers", {}, BOTH, where="WHERE " + " AND ".join(f"{c} BETWEEN {fence(c, -1)} AND {fence(c, 1)}" for c in BOTH), table=EVENTS, frame=events, doubles="value square")
transform_query("log_transform", {c: f"CASE WHEN {c} IS NOT NULL THEN ln(1 + greatest({c}, 0)) END" for c in BOTH}, BOTH, table=EVENTS, frame=events, doubles="value square")
transform_query("sqrt_transform", {c: f"CASE WHEN {c} IS NOT NULL THEN sqrt(greatest({c}, 0)) END" for c in BOTH}, BOTH, table=EVENTS, frame=events, doubles="value square")
zero = lambda c: f"coalesce({c}, 0)"
transform_query("scale_standard", {c: f"({zero(c)} - (SELECT avg({zero(c)}) FROM t)) / (SELECT stddev_pop({zero(c)}) FROM t)" for c in BOTH}, BOTH, table=EVENTS, frame=events, doubles="value square")
transform_query("scale_minmax", {c: f"({zero(c)} - (SELECT min({zero(c)}) FROM t)) / (SELECT max({zero(c)}) - min({zero(c)}) FROM t)" for c in BOTH}, BOTH, table=EVENTS, frame=events, doubles="value square")
mid = lambda c: f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM t))"
filled = lambda c, p: f"(SELECT quantile_cont({mid(c)}, {p}) FROM t)"
transform_query("scale_robust", {c: f"({mid(c)} - {filled(c, 0.5)}) / ({filled(c, 0.75)} - {filled(c, 0.25)})" for c in BOTH}, BOTH, table=EVENTS, frame=events, doubles="value square")
transform_query("yeo_johnson", None, BOTH, table=EVENTS, frame=events)
transform_query("impute_knn", None, GAPPY)
query(
    "t_encode_frequency",
    f"WITH t AS ({KEYED}) SELECT * REPLACE (CASE WHEN l_returnflag IS NOT NULL THEN count(*) OVER (PARTITION BY l_returnflag)::DOUBLE / count(l_returnflag) OVER () END AS l_returnflag) FROM t",
    f"{NUM} l_returnflag",
)(lambda t: transforms.apply(keyed(t), "encode_frequency", ["l_returnflag"]))
query(
    "t_encode_target",
    f"WITH t AS ({KEYED}) SELECT * REPLACE (CASE WHEN l_returnflag IS NOT NULL THEN avg(l_quantity) OVER (PARTITION BY l_returnflag) END AS l_returnflag) FROM t",
    f"{NUM} l_returnflag",
)(lambda t: transforms.apply(keyed(t), "encode_target", ["l_returnflag"], "l_quantity"))
query(
    "t_encode_label",
    f"""WITH t AS ({KEYED}), f AS (SELECT l_returnflag AS v, row_number() OVER (ORDER BY min(l_orderkey), l_returnflag) - 1 AS code FROM t WHERE l_returnflag IS NOT NULL GROUP BY 1)
    SELECT t.* REPLACE (coalesce(code, -1)::INTEGER AS l_returnflag) FROM t LEFT JOIN f ON f.v = t.l_returnflag""",
    NUM,
)(lambda t: transforms.apply(keyed(t), "encode_label", ["l_returnflag"], order_by="l_orderkey"))
query(
    "t_encode_label_first",
    """WITH f AS (SELECT v, row_number() OVER (ORDER BY first, v) - 1 AS code FROM (SELECT o_orderpriority AS v, min(file_row_number) AS first FROM (SELECT *, row_number() OVER () AS file_row_number FROM orders) GROUP BY 1))
    SELECT o_orderkey, code::INTEGER AS o_orderpriority FROM orders JOIN f ON f.v = o_orderpriority""",
)(lambda t: transforms.apply(t.orders.select("o_orderkey", "o_orderpriority"), "encode_label", ["o_orderpriority"]))
query(
    "t_encode_onehot",
    "SELECT o_orderkey, " + ", ".join(f"coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END = '{v}', false) AS \"o_orderstatus_{v}\"" for v in "FOP") + " FROM orders",
)(lambda t: transforms.apply(t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus")), "encode_onehot", ["o_orderstatus"]))
for name in ("drop_duplicates", "keep_first"):
    query(f"t_{name}", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem", "l_quantity")(lambda t, name=name: transforms.apply(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity"), name))
query("t_drop_high_missing", "SELECT event_id, event_type, value, CASE WHEN event_id % 9 <> 0 THEN value END AS some FROM events", "value some")(
    lambda t: transforms.apply(t.events.select("event_id", "event_type", "value", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("some"), F.when(F.col("event_id") % 9 == 0, F.col("value")).alias("few")), "drop_high_missing")
)
transform_query("skip", {}, GAPPY, doubles=NUM)
