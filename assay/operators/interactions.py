"""Association of pairs of columns: binned mutual information, Cramer's V, correlation ratio, redundancy groups."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.exprs import above, ident, ratio, real
from assay.plans.kinds import interaction_kind, type_family
from assay.plans.ranks import tiles
from assay.plans.select import extents, quantile_values
from assay.plans.statplan import cardinalities, joint_counts, with_totals
from assay.plans.tiles import codes

MISSING = "__missing__"
BINS = 16
STRENGTH = [(0.70, "Strong"), (0.40, "Moderate"), (0.15, "Weak")]


def strength(score):
    return above(score, STRENGTH, "Negligible", strict=False)


def choose_columns(df: DataFrame, target: str | None = None, max_cols: int = 25, key: str | None = None) -> list[str]:
    """Columns worth pairing: no target, no row key, no dates, no nearly unique categories; numeric first; at most ``max_cols``."""
    family = {f.name: interaction_kind(f.dataType) for f in df.schema if type_family(f.dataType) != "nested" and f.name not in (target, key)}
    categories = [c for c, k in family.items() if k == "categorical"]
    unique = {r["column"] for r in cardinalities(df, categories).collect() if r["count"] and r["n_unique"] / r["count"] > 0.85} if categories else set()
    numbers = [c for c, k in family.items() if k == "numeric"]
    return (numbers + [c for c in categories if c not in unique])[:max_cols]


def fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls replaced: numbers by their median, everything else by a category of its own."""
    numbers = [c for c in columns if interaction_kind(df.schema[c].dataType) == "numeric"]
    gone = df.select(*[ident(c) for c in numbers]).agg(*[F.max(ident(c).isNull()).alias(str(i)) for i, c in enumerate(numbers)]).first() if numbers else ()
    medians = {c: q[0] if q else None for c, q in quantile_values(df, [c for c, g in zip(numbers, gone, strict=True) if g], 0.5).items()}
    number = lambda c: F.coalesce(real(c), F.lit(medians[c] or 0.0)) if c in medians else real(c)
    return df.withColumns({c: number(c) if c in numbers else F.coalesce(ident(c).cast("string"), F.lit(MISSING)) for c in columns})


def binned(df: DataFrame, columns: list[str], key: str, bins: int = BINS) -> DataFrame:
    """Numeric columns replaced by bins: by value up to ``bins`` distinct ones, else ``bins`` equally full ones.

    Equal fullness splits ties by the row's ``key``. The bins' ends are searched for, so no row is sorted but those that tie
    with an end. Columns that doubles don't hold exactly, or with nulls, get their bins from ranks over sorted ranges.
    """
    values = [real(c) for c in columns]
    known = extents(df, values)
    exact = lambda c, a, b: isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) or (not isinstance(df.schema[c].dataType, T.DecimalType) and max(abs(a or 0), abs(b or 0)) < 2**53)
    plain = [i for i, (c, (_, _, a, b)) in enumerate(zip(columns, known, strict=True)) if bins < 127 and interaction_kind(df.schema[c].dataType) == "numeric" and exact(c, a, b)]
    out, left = codes(df, [columns[i] for i in plain], [values[i] for i in plain], key, bins, [known[i] for i in plain]) if plain else (df, [])
    left += [c for i, c in enumerate(columns) if i not in plain]
    few = {r["column"] for r in cardinalities(df, left).collect() if r["n_unique"] <= bins} if left else set()
    for c in left:
        out = out.withColumn(c, ident(c).cast("string")) if c in few else tiles(out, c, key, bins, c)
    return out


def _named(found: DataFrame) -> DataFrame:
    p = F.split("pair", "\x00")
    return found.select(p[0].alias("a"), p[1].alias("b"), *[c for c in found.columns if c != "pair"])


def cramers_v(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows (a, b, v): Cramer's V without correction, at most 1; 0 for a table below 2 x 2."""
    got = joint_counts(df, pairs).groupBy("pair").agg(
        F.max("total").alias("t"), (F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))) - 1).alias("phi2"), F.least(F.count_distinct("a"), F.count_distinct("b")).alias("k")
    )
    v = F.when(F.col("k") < 2, 0.0).otherwise(F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), F.col("phi2")) / F.when(F.col("k") > 1, F.col("k") - 1))))
    return _named(got.select("pair", v.alias("v")))


def eta_squared(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows (category, number, eta2): share of a number's variance between categories; 0 below four rows or if constant."""
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), ident(a).cast("string").alias("g"), real(b).alias("x")) for i, (a, b) in enumerate(pairs)])
    by = df.select(F.inline(cells)).where("x is not null").groupBy("pair", "g").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.when(F.min("x") < F.max("x"), F.var_pop("x") * F.count(F.lit(1))).otherwise(0.0).alias("within"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    by = with_totals(by, ["pair"], mean=F.sum(F.col("n") * F.col("m")) / F.sum("n"))
    got = by.withColumn("between", F.col("n") * (F.col("m") - F.col("mean")) ** 2).groupBy("pair").agg(F.sum("n").alias("n"), F.sum("between").alias("b"), F.sum("within").alias("w"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    value = F.when((F.col("n") < 4) | (F.col("lo") == F.col("hi")), 0.0).otherwise(F.coalesce(F.least(F.lit(1.0), ratio(F.col("b"), F.col("b") + F.col("w"))), F.lit(0.0)))
    name = lambda side: F.array(*[F.lit(p[side]) for p in pairs])[F.col("pair")]
    return got.select(name(0).alias("category"), name(1).alias("number"), value.alias("eta2"))


def mutual_information(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows (a, b, mi, score) over columns that are binned already: nats, and mi / sqrt(H(a) H(b)), at most 1."""
    small = all(isinstance(df.schema[c].dataType, T.ByteType) for p in pairs for c in p)
    j = joint_counts(df, pairs, small=small)
    p = F.col("n") / F.col("total")
    info = j.groupBy("pair").agg(F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))

    def entropy(side: str, n: str) -> DataFrame:
        q = F.col(n) / F.col("total")
        return j.select("pair", side, n, "total").distinct().groupBy("pair").agg((-F.sum(q * F.log(q))).alias(f"h_{side}"))

    got = info.join(entropy("a", "na"), "pair").join(entropy("b", "nb"), "pair")
    scale = F.sqrt(F.col("h_a") * F.col("h_b"))
    score = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio(F.col("mi"), F.when(scale > 1e-12, scale)))), F.lit(0.0))
    return _named(got.select("pair", F.greatest(F.lit(0.0), F.col("mi")).alias("mi"), score.alias("score")))


def pair_scores(df: DataFrame, key: str, target: str | None = None, max_cols: int = 25, top: int | None = None) -> DataFrame:
    """Rows (a, b, method, score, strength) of every pair of chosen columns, strongest first.

    Two numbers: normalised mutual information; two categories: Cramer's V; mixed: correlation ratio. Fewer than five
    rows give scores of zero and the method ``insufficient_data``.
    """
    columns = choose_columns(df, target, max_cols, key)
    filled = fill(df.select(*[ident(c) for c in dict.fromkeys([*columns, key])]), columns)
    number = {c: interaction_kind(df.schema[c].dataType) == "numeric" for c in columns}
    spark, pairs = df.sparkSession, list(combinations(columns, 2))
    if not pairs:
        return spark.createDataFrame([], "a string, b string, method string, score double, strength string")
    if df.limit(5).count() < 5:
        return spark.createDataFrame([(a, b, "insufficient_data", 0.0, "Negligible") for a, b in pairs], "a string, b string, method string, score double, strength string")
    parts = []
    nn = [p for p in pairs if number[p[0]] and number[p[1]]]
    cc = [p for p in pairs if not number[p[0]] and not number[p[1]]]
    mixed = [p for p in pairs if number[p[0]] != number[p[1]]]
    if nn:
        safe = filled.withColumn("__key", ident(key))
        parts.append(mutual_information(binned(safe, sorted({c for p in nn for c in p}), "__key"), nn).select("a", "b", F.lit("mutual_information").alias("method"), "score"))
    if cc:
        parts.append(cramers_v(filled, cc).select("a", "b", F.lit("cramers_v").alias("method"), F.col("v").alias("score")))
    if mixed:
        got = eta_squared(filled, [(b, a) if number[a] else (a, b) for a, b in mixed])
        parts.append(got.select(F.col("number").alias("a"), F.col("category").alias("b"), F.lit("correlation_ratio").alias("method"), F.col("eta2").alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("strength", strength(F.col("score"))).orderBy(F.desc("score"), "a", "b")
    return out.limit(top) if top else out


def target_scores(df: DataFrame, target: str, key: str, max_cols: int = 25) -> DataFrame:
    """Rows (column, method, score, strength) of every chosen column against the target, strongest first.

    Categories: correlation ratio for a numeric target with more than 15 values, else Cramer's V. Numbers: mutual
    information in nats, which may exceed 1 and keeps the same strength limits.
    """
    columns = choose_columns(df, target, max_cols, key)
    filled = fill(df.select(*[ident(c) for c in dict.fromkeys([*columns, target, key])]), [*columns, target]).withColumn("__key", ident(key))
    classes = df.agg(F.count_distinct(ident(target))).first()[0]
    continuous = interaction_kind(df.schema[target].dataType) == "numeric" and classes > 15
    numbers = [c for c in columns if interaction_kind(df.schema[c].dataType) == "numeric"]
    categories = [c for c in columns if c not in numbers]
    parts = []
    if numbers:
        ready = binned(filled, numbers + [target] * continuous, "__key")
        parts.append(mutual_information(ready, [(c, target) for c in numbers]).select(F.col("a").alias("column"), F.lit("mutual_information").alias("method"), F.col("mi").alias("score")))
    if categories and continuous:
        parts.append(eta_squared(filled, [(c, target) for c in categories]).select(F.col("category").alias("column"), F.lit("correlation_ratio").alias("method"), F.col("eta2").alias("score")))
    elif categories:
        parts.append(cramers_v(filled, [(c, target) for c in categories]).select(F.col("a").alias("column"), F.lit("cramers_v").alias("method"), F.col("v").alias("score")))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, method string, score double, strength string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("strength", strength(F.col("score"))).orderBy(F.desc("score"), "column")


def matrix(scores: DataFrame) -> DataFrame:
    """The symmetric matrix of pair scores as rows (a, b, score), ones on the diagonal."""
    both = scores.select("a", "b", "score").unionByName(scores.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    names = both.select("a").distinct()
    return both.unionByName(names.select("a", F.col("a").alias("b"), F.lit(1.0).alias("score")))


def redundancy_groups(scores: DataFrame, least: float = 0.70) -> list[list[str]]:
    """Groups of columns that hang together at ``least`` or more, the largest first; columns, so a small driver job."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in scores.where(F.col("score") >= least).collect():
        a, b = sorted((find(r["a"]), find(r["b"])))
        parent[b] = a
    groups: dict[str, list[str]] = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    return sorted((sorted(g) for g in groups.values() if len(g) > 1), key=lambda g: (-len(g), g))


def summary(scores: DataFrame) -> str:
    """One sentence on how strongly the columns hang together."""
    counts = {r["strength"]: r["n"] for r in scores.groupBy("strength").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return "No pair of columns could be compared."
    top = scores.orderBy(F.desc("score"), "a", "b").first()
    return f"{total} pairs compared: {counts.get('Strong', 0)} strong, {counts.get('Moderate', 0)} moderate, {counts.get('Weak', 0)} weak; closest are {top['a']} and {top['b']} ({top['score']:.2f})."


