"""Fused plans: all statistics of all columns in one aggregate, one frequency table for everything that counts values.

``per_column`` builds a single ``agg`` of one struct per column and unpivots the one row that comes back, so a profile
of k columns reads the table once. ``frequencies`` replaces k distinct counts (which Spark would plan as an Expand of k
times the rows through one sort) by a partial aggregate over (column, value). ``CHUNK`` bounds the expressions of a job.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.exprs import ident, real, sketching, top_count

CHUNK = 200


def per_column(df: DataFrame, columns: list[str], atoms: Callable[[str], dict[str, Column]]) -> DataFrame:
    """Rows (column, atom...) from one aggregate per ``CHUNK`` expressions; the atoms have the same names for all."""
    if not columns:
        raise ValueError("no column to aggregate")
    width = max(1, CHUNK // max(1, len(atoms(columns[0]))))
    parts = []
    for at in range(0, len(columns), width):
        group = columns[at : at + width]
        structs = [F.struct(F.lit(c).alias("column"), *[e.alias(n) for n, e in atoms(c).items()]) for c in group]
        parts.append(df.agg(F.array(*structs).alias("s")).select(F.inline("s")))
    return reduce(DataFrame.unionByName, parts)


def per_number(df: DataFrame, columns: list[str], atoms: dict[str, Column], constants: dict[str, dict[str, object]] | None = None, beside: Column | None = None, zero: tuple[str, ...] = ()) -> DataFrame:
    """Rows (column, atom...) of numeric columns from one aggregate over cells: ``atoms`` are of the double ``x``, of ``y`` (``beside``), and of ``constants`` (name to value per column).

    The code of ``per_column`` grows with the columns until Java no longer compiles it; this one's doesn't. Atoms in ``zero`` are 0 for an empty table.
    """
    constants = constants or {}
    cells = F.array(*[F.struct(F.lit(i).alias("__i"), real(c).alias("x"), *[F.lit(v[c]).alias(k) for k, v in constants.items()]) for i, c in enumerate(columns)])
    rows = df.select(F.inline(cells)) if beside is None else df.select(beside.alias("y"), F.inline(cells))
    got = rows.groupBy("__i").agg(*[e.alias(n) for n, e in atoms.items()])
    names = df.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("__i"), F.lit(c).alias("column")) for i, c in enumerate(columns)])))
    out = names.join(F.broadcast(got), "__i", "left")  # a row per column
    return out.select("column", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) if n in zero else n for n in atoms])


def of_column(values: dict[str, float | None]) -> Column:
    """The value that belongs to the row's ``column``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(v).cast("double").alias("v")) for c, v in values.items()])
    return F.filter(pairs, lambda p: p["c"] == F.col("column"))[0]["v"]


def unpivot(df: DataFrame, columns: list[str], cast: str = "string", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (keep..., column, value)."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), ident(c).cast(cast).alias("value")) for c in columns])
    return df.select(*[ident(k) for k in keep], F.inline(cells))


def frequencies(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (keep..., column, value, n): how often each value occurs, null included."""
    return unpivot(df, columns, keep=keep).groupBy(*keep, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def with_totals(df: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """``df`` with an aggregate per entry of ``sums`` over the rows that share ``by`` (few groups: names of columns or of pairs).

    An aggregate with partial sums and a broadcast of one row per group, where a window would sort a whole group in one task.
    """
    totals = df.groupBy(*by).agg(*[e.alias(n) for n, e in sums.items()])
    return df.join(F.broadcast(totals), by) if by else df.crossJoin(F.broadcast(totals))


def joint_counts(df: DataFrame, pairs: list[tuple[str, str]], nulls: bool = True, small: bool = False) -> DataFrame:
    """Rows (pair, a, b, n, na, nb, total): joint and marginal counts of many pairs of columns from one read of the table.

    small: the columns are tinyint without nulls; a pair of them is counted as one number, and a and b are numbers.
    """
    names = F.array(*[F.lit(f"{a}\x00{b}") for a, b in pairs])
    if small:
        at = lambda c: ident(c).cast("int") + 128
        counted = df.select(F.explode(F.array(*[F.lit(i * 65_536) + at(a) * 256 + at(b) for i, (a, b) in enumerate(pairs)])).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
        n = counted.select(names[F.shiftright("c", 16)].alias("pair"), F.col("c").bitwiseAND(65_280).alias("a"), F.col("c").bitwiseAND(255).alias("b"), "n")
    else:
        cells = F.array(*[F.struct(F.lit(i).alias("p"), ident(a).cast("string").alias("a"), ident(b).cast("string").alias("b")) for i, (a, b) in enumerate(pairs)])
        rows = df.select(F.inline(cells))
        n = (rows if nulls else rows.where("a is not null and b is not null")).groupBy("p", "a", "b").agg(F.count(F.lit(1)).alias("n")).select(names[F.col("p")].alias("pair"), "a", "b", "n")
    n = n.select("*", F.sum("n").over(Window.partitionBy("pair", "a")).alias("na"), F.sum("n").over(Window.partitionBy("pair", "b")).alias("nb"))
    return with_totals(n, ["pair"], total=F.sum("n"))


def cardinalities(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, count, n_rows, n_unique, top_n) of non-null values from one frequency table.

    In the sketching mode (see ``exprs.sketching``) from one aggregate without a shuffle of cells: HyperLogLog counts
    (within 1 %) and frequent-item sketches, for tables whose distinct values are too many to be counted.
    """
    if sketching(df):
        from functools import reduce as fold

        parts = []
        for c in columns:  # a sketch per column, all in one aggregate per CHUNK columns
            x = ident(c).cast("string")
            parts.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), F.count(F.lit(1)).alias("n_rows"), F.approx_count_distinct(x, 0.01).alias("n_unique"), top_count(x).alias("top_n")))
        width = max(1, CHUNK // 4)
        return fold(DataFrame.unionByName, [df.agg(F.array(*parts[i : i + width]).alias("s")).select(F.inline("s")) for i in range(0, len(parts), width)])
    some = F.col("value").isNotNull()
    return typed_frequencies(df, columns, lambda f: f.groupBy("column").agg(
        F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).cast("long").alias("count"),
        F.sum("n").cast("long").alias("n_rows"),
        F.count(F.when(some, 1)).cast("long").alias("n_unique"),
        F.coalesce(F.max(F.when(some, F.col("n"))), F.lit(0)).cast("long").alias("top_n"),
    ))


def typed_frequencies(df: DataFrame, columns: list[str], use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``use`` makes of (column, value, n), once for the columns of each type: numbers, dates and strings are counted as what they are, not as text."""
    plain = {f.name: f.dataType for f in df.schema}
    wide = {c: "bigint" if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else "double" if isinstance(t, (T.FloatType, T.DoubleType)) else t.simpleString() if isinstance(t, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)) else "string" for c, t in plain.items()}
    parts = []
    for kind in dict.fromkeys(wide[c] for c in columns):
        own = [c for c in columns if wide[c] == kind]
        cells = F.array(*[F.struct(F.lit(i).alias("__i"), ident(c).cast(kind).alias("value")) for i, c in enumerate(own)])
        f = df.select(F.inline(cells)).groupBy("__i", "value").agg(F.count(F.lit(1)).alias("n"))
        parts.append(use(f.select(F.array(*map(F.lit, own))[F.col("__i")].alias("column"), "value", "n")))
    return reduce(DataFrame.unionByName, parts)


def modes(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The most frequent value of each numeric column as a double, of equally frequent ones the least."""
    top = F.min_by(F.col("value").cast("double"), F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), F.col("value"))))
    return {r["column"]: r["v"] for r in typed_frequencies(df, columns, lambda f: f.groupBy("column").agg(top.alias("v"))).collect()}
