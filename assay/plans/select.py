"""Exact order statistics of many numeric columns without a sort, and without a task that holds a column's values.

Every column is cut into bins of equal width between its least and greatest value; the counts tell in which bin a wanted rank
lies, and that bin is cut again between its own least and greatest value. Once the bins left hold few rows, or one value each,
their values are counted. Shuffles and what the driver gets are bounded by ``CELLS`` and ``GATHER``, whatever the table's size.
"""

from __future__ import annotations

import math
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.exprs import quantiles, real, sketching
from assay.plans.statplan import per_column

#: Bins of a round over all columns together, at most so many of one interval; rows whose values the driver may look at.
CELLS, BINS, GATHER = 32_768, 4_096, 50_000


def search(x: Column, cuts: list, leaves: list[Column], after=None) -> Column:
    """The leaf of the range of sorted ``cuts`` that ``x`` lies in (a cut belongs to the range below it): few comparisons, for it's a tree."""
    after = after or (lambda cut: x > F.lit(cut))
    if not cuts:
        return leaves[0]
    mid = len(cuts) // 2
    return F.when(after(cuts[mid]), search(x, cuts[mid + 1 :], leaves[mid + 1 :], after)).otherwise(search(x, cuts[:mid], leaves[: mid + 1], after))


def extents(df: DataFrame, values: list[Column]) -> list[tuple[int, int, float | None, float | None]]:
    """Per column: rows, values, least and greatest value."""
    got = df.agg(F.count(F.lit(1)).alias("rows"), *[f(v).alias(f"{k}{i}") for i, v in enumerate(values) for k, f in (("n", F.count), ("a", F.min), ("b", F.max))]).first()
    return [(got["rows"], got[f"n{i}"], got[f"a{i}"], got[f"b{i}"]) for i in range(len(values))]


def _counted(df: DataFrame, values: list[Column], spans: list[dict], bins: int) -> dict[int, list]:
    """Rows (least, greatest, n) of the bins of every span that hold values, in order; a bin for every value if ``bins`` is 0."""
    cells = []
    for i, own in groupby(sorted(spans, key=lambda s: (s["i"], s["lo"])), key=lambda s: s["i"]):
        own, x = list(own), values[i]

        def leaf(s: dict, x=x) -> Column:
            if not bins:
                place = F.lit(s["id"])
            else:
                width = s["hi"] / 2 - s["lo"] / 2
                fine = width > 0 and math.isfinite(bins / width)
                at = F.least(F.floor((x / 2 - s["lo"] / 2) * (bins / width)), F.lit(bins - 1)) if fine else (x > F.lit(s["lo"])).cast("long")
                place = at.cast("int") + s["id"] * bins
            return F.when((x >= F.lit(s["lo"])) & (x <= F.lit(s["hi"])), place)

        cells.append(F.struct(search(x, [s["hi"] for s in own[:-1]], [leaf(s) for s in own]).cast("int").alias("place"), x.alias("x")))
    rows = df.select(F.inline(F.array(*cells))).where("place is not null")
    out: dict[int, list] = {s["id"]: [] for s in spans}
    if bins:
        for r in rows.groupBy("place").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count(F.lit(1)).alias("n")).collect():
            out[r["place"] // bins].append((r["a"], r["b"], r["n"]))
    else:
        for r in rows.groupBy("place", "x").agg(F.count(F.lit(1)).alias("n")).collect():
            out[r["place"]].append((r["x"], r["x"], r["n"]))
    return {k: sorted(v) for k, v in out.items()}


def order_statistics(df: DataFrame, values: list[Column], ranks: list[list[int]], known: list[tuple] | None = None, few: int = 0) -> tuple[list[dict[int, tuple[float, int, int]]], list[list[float] | None]]:
    """Per column of doubles a dict of rank (from 0, nulls left out) to (value, values below it, values equal to it); and
    the column's distinct values if there are ``few`` at most, an empty list if there are more, None where that isn't known.

    known: the columns' ``extents``, if they have been asked for.
    """
    known = known or extents(df, values)
    out: list[dict] = [{} for _ in values]
    levels: list[list[float] | None] = [None] * len(values)
    spans = []
    for i, (wanted, (_, n, a, b)) in enumerate(zip(ranks, known, strict=True)):
        if n and few:
            levels[i] = [a] if a == b else None
        if n and a == b:
            out[i] = dict.fromkeys(wanted, (a, 0, n))
        elif n and wanted:
            spans.append({"i": i, "lo": a, "hi": b, "below": 0, "n": n, "ranks": wanted})
    first = True
    while spans:
        for k, s in enumerate(spans):
            s["id"] = k
        bins = 0 if sum(s["n"] for s in spans) <= GATHER else max(2, min(BINS, CELLS // len(spans)))
        counted, left = _counted(df, values, spans, bins), []
        for s in spans:
            own, below, asked = counted[s["id"]], s["below"], sorted(s["ranks"])
            if first and len(own) > few:
                levels[s["i"]] = []
            elif first and all(a == b for a, b, _ in own):
                levels[s["i"]] = [a for a, _, _ in own]
            for a, b, n in own:
                here = [r for r in asked if below <= r < below + n]
                if here and a == b:
                    out[s["i"]] |= dict.fromkeys(here, (a, below, n))
                elif here:
                    left.append({"i": s["i"], "lo": a, "hi": b, "below": below, "n": n, "ranks": here})
                below += n
        spans, first = left, False
    return out, levels


def quantile_values(df: DataFrame, columns: list[str], *at: float) -> dict[str, list[float] | None]:
    """Quantiles by linear interpolation per column, None without values; sketched in the sketching mode (see ``exprs.sketching``)."""
    if not columns:
        return {}
    if sketching(df):
        return {r["column"]: r["q"] for r in per_column(df, columns, lambda c: {"q": quantiles(real(c), *at)}).collect()}
    values = [real(c) for c in columns]
    known = extents(df, values)
    place = [[(n - 1) * p for p in at] if n else [] for _, n, _, _ in known]
    found, _ = order_statistics(df, values, [sorted({k for p in ps for k in (math.floor(p), math.ceil(p))}) for ps in place], known)
    out: dict[str, list[float] | None] = {}
    for c, ps, v in zip(columns, place, found, strict=True):
        low, high = [v[math.floor(p)][0] for p in ps], [v[math.ceil(p)][0] for p in ps]
        out[c] = [a if a == b else (math.ceil(p) - p) * a + (p - math.floor(p)) * b for p, a, b in zip(ps, low, high, strict=True)] or None
    return out
