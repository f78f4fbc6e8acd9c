"""Which of a few equally full bins each row falls in, for many columns at once: only the bins' ends are searched for, rows aren't sorted.

The value at each end is an order statistic. Where rows tie with it, the end is one of their keys: ties are dealt to ranges of
keys by a bounded sample until a range is short, and only the ranges that hold an end are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.plans.select import order_statistics, search

#: Keys that the driver may look at in a round, ranges of keys in a round, rows of a range that one task may sort.
SAMPLE, RANGES, SORTED = 10_000, 256, 200_000


def codes(df: DataFrame, columns: list[str], values: list[Column], key: str, bins: int, known: list[tuple]) -> tuple[DataFrame, list[str]]:
    """``df`` with the ``columns`` of doubles (``values``, without nulls unless there are ``bins`` distinct ones at most) as
    tinyint: the place of the value among ``bins`` distinct ones at most, else its bin by (value, key), from 1, as ``ntile``;
    0 for null. And the columns left as they are, since they have nulls or as it isn't known whether they have few values.
    """
    ends = []
    for _, n, _, _ in known:
        q, more = divmod(n, bins)
        ends.append([r for r in sorted({(t + 1) * q + min(t + 1, more) - 1 for t in range(bins)}) if 0 <= r < n - 1])
    found, levels = order_statistics(df, values, [e or [0] * (n > 0) for e, (_, n, _, _) in zip(ends, known, strict=True)], known, bins)
    left = [c for c, few, (rows, n, _, _) in zip(columns, levels, known, strict=True) if n and (few is None or (not few and n < rows))]
    done = [i for i, c in enumerate(columns) if c not in left]
    split: list[tuple[int, float, list[int]]] = []  # column, value, how many of the rows that tie go below each end
    for i in done:
        for v in [] if levels[i] else sorted({found[i][r][0] for r in ends[i]}):
            here = sorted(r + 1 - below for r in ends[i] for x, below, ties in [found[i][r]] if x == v and r + 1 < below + ties)
            split += [(i, v, here)] * bool(here)
    at = _key_ends(df, values, key, split, {(i, v): ties for i, f in enumerate(found) for v, _, ties in f.values()}) if split else {}
    uneven = {(i, v): cut for i, v, needs in split for n in needs if (cut := at[i, v, n])[1] < cut[2]}
    again = {i for i, _ in uneven}

    def after(i: int, r: int) -> Column:
        (v, below, _), x = found[i][r], values[i]
        if (i, v, r + 1 - below) not in at:
            return x > F.lit(v)
        k, own, n = at[i, v, r + 1 - below]
        beyond = F.col(key) > F.lit(k)
        if own < n:
            beyond = beyond | ((F.col(key) == F.lit(k)) & (F.coalesce(F.col(f"__n{i}"), F.lit(0)) > own))
        return (x > F.lit(v)) | ((x == F.lit(v)) & beyond)

    def code(i: int) -> Column:
        cuts, test = (levels[i][:-1], lambda v, i=i: values[i] > F.lit(v)) if levels[i] else (ends[i], lambda r, i=i: after(i, r))
        return F.when(values[i].isNotNull(), search(values[i], cuts, [F.lit(t + 1) for t in range(len(cuts) + 1)], test)).otherwise(0).cast("tinyint")

    if uneven:  # equal keys on both sides of an end: these few rows are numbered
        groups = {i: F.coalesce(*[F.when((values[i] == F.lit(v)) & (F.col(key) == F.lit(at[i, v, n][0])), g) for g, (j, v, needs) in enumerate(split) if j == i for n in needs if at[i, v, n][1] < at[i, v, n][2]]) for i in again}
        hit = F.coalesce(*groups.values()).isNotNull()
        numbered = df.where(hit).select("*", *[F.when(g.isNotNull(), F.row_number().over(Window.partitionBy(g, F.when(g.isNotNull(), F.col(key))).orderBy(F.lit(1)))).alias(f"__n{i}") for i, g in groups.items()])
        df = df.where(F.coalesce(hit, F.lit(False)) == F.lit(False)).select("*", *[F.lit(None).cast("int").alias(f"__n{i}") for i in groups]).unionByName(numbered)
    new = {columns[i]: code(i) for i in done}
    return df.withColumns(new).drop(*[f"__n{i}" for i in again]), left


def _key_ends(df: DataFrame, values: list[Column], key: str, split: list[tuple[int, float, list[int]]], ties: dict) -> dict:
    """(column, value, n) to the key of the n-th of the rows with that value in order of keys, how many rows with that key lie up to it, and how many have it."""
    spans = [{"g": g, "lo": None, "hi": None, "below": 0, "n": ties[i, v], "needs": needs} for g, (i, v, needs) in enumerate(split)]
    own: dict[int, list[tuple[int, float]]] = {}
    for g, (i, v, _) in enumerate(split):
        own.setdefault(i, []).append((g, v))
    x = {i: values[i] for i in own}
    held = F.coalesce(*[F.when(x[i].isin([v for _, v in gs]), True) for i, gs in own.items()])
    groups = F.array(*[search(x[i], [v for _, v in gs[:-1]], [F.when(x[i] == F.lit(v), g) for g, v in gs]) for i, gs in own.items()])
    rows = df.where(held).select(F.col(key).alias("k"), F.explode(groups).alias("g")).where("g is not null")

    def inside(spans: list[dict]) -> DataFrame:
        """Rows with s, the span they lie in: above its ``lo`` and up to its ``hi``."""

        def leaf(s: int) -> Column:
            a, b = spans[s]["lo"], spans[s]["hi"]
            both = [F.col("k") > F.lit(a)] * (a is not None) + [F.col("k") <= F.lit(b)] * (b is not None)
            return F.when(both[0] & both[-1], s) if both else F.lit(s)

        by = {g: [s for s, x in enumerate(spans) if x["g"] == g] for g in sorted({x["g"] for x in spans})}
        of = lambda ss: search(F.col("k"), [spans[s]["hi"] for s in ss[:-1]], [leaf(s) for s in ss])
        gs = list(by)
        return rows.where(F.col("g").isin(gs)).select("k", search(F.col("g"), gs[:-1], [of(by[g]) for g in gs]).cast("int").alias("s")).where("s is not null")

    while any(s["n"] > SORTED for s in spans):
        inner = inside(spans)
        total = sum(s["n"] for s in spans)
        seen: dict[int, list] = {}
        for r in inner.sample(min(1.0, SAMPLE / total), seed=1).collect():
            seen.setdefault(r["s"], []).append(r["k"])
        each = max(2, RANGES // len(spans))
        cuts = {s: sorted({v[len(v) * j // each] for v in [sorted(seen.get(s, []))] if v for j in range(1, each)}) for s in range(len(spans))}
        order = range(len(spans))
        place = search(F.col("s"), list(order)[:-1], [search(F.col("k"), cuts[s], [F.lit(s * RANGES + j) for j in range(len(cuts[s]) + 1)]) for s in order])
        counts = {r["p"]: r["n"] for r in inner.groupBy(place.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        narrow = []
        for s in order:
            below, limits = spans[s]["below"], [spans[s]["lo"], *cuts[s], spans[s]["hi"]]
            for j in range(len(cuts[s]) + 1):
                n = counts.get(s * RANGES + j, 0)
                if here := [x for x in spans[s]["needs"] if below < x <= below + n]:
                    narrow.append({"g": spans[s]["g"], "lo": limits[j], "hi": limits[j + 1], "below": below, "n": n, "needs": here})
                below += n
        done = max(s["n"] for s in narrow) >= max(s["n"] for s in spans)  # a key that so many rows have: its rows are counted below
        spans = narrow
        if done:
            break
    counted = inside(spans).groupBy("s", "k").agg(F.count(F.lit(1)).alias("n"))
    up = F.sum("n").over(Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) + F.array(*[F.lit(s["below"]).cast("long") for s in spans])[F.col("s")]
    wanted = F.array(*[F.array(*[F.lit(n).cast("long") for n in s["needs"]]) for s in spans])[F.col("s")]
    out = {}
    for r in counted.withColumn("up", up).withColumn("needs", F.filter(wanted, lambda n: (n > F.col("up") - F.col("n")) & (n <= F.col("up")))).where(F.size("needs") > 0).collect():
        i, v, _ = split[spans[r["s"]]["g"]]
        out |= {(i, v, n): (r["k"], n - (r["up"] - r["n"]), r["n"]) for n in r["needs"]}
    return out
