"""Mixing sources to target weights (operator 9, DataFrame operations only).

Tokens are aggregated per source, a repetition rate is derived per source, and each document is emitted floor(rate)
times plus one further time if its hash-seeded Bernoulli draw falls below the fraction. The only shuffle is of one
partial sum per source and task; rates go back to the documents by a broadcast of checked size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.exprs import ident
from assay.llm.shared import WORD, cut, table
from assay.plans.ranks import running
from assay.plans.statplan import with_totals

#: More sources than this and the rates are joined by a shuffle, whose skew adaptive execution splits.
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets per source from rows (source, source_size): adds weight, target and rate.

    Sources ordered by code point, null last, take ``weights`` in turn and divide ``share`` of all tokens by weight.
    A target stops at ``cap`` times its source's size and the excess is shared again by weight among the rest until
    none is above: with sources ordered by cap/weight, all before some point stop at their cap and the others get one
    common level times their weight. One row per source is ordered here, never a document, and over sorted ranges, for
    sources may be as many as hosts of the web.
    """
    s = sizes.select("source", "source_size", F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), F.lit(1).cast("long").alias("one"))
    s = running(s, ["none", "name"], {"turn": "one"}).withColumn("turn", F.col("turn") - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("turn") % len(weights) + 1).cast("int")))
    s = cut(s.withColumn("cap", cap * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight")), "mix-weights")
    s = running(s, ["ratio", "turn"], {"caps": "cap", "weights": "weight", "place": "one"})
    s = with_totals(s, [], all_weights=F.sum("weight"), all_sizes=F.sum("source_size"))
    before, rest = F.col("caps") - F.col("cap"), F.col("all_weights") - (F.col("weights") - F.col("weight"))
    s = s.withColumn("level", (share * F.col("all_sizes") - before) / rest)
    s = with_totals(cut(s, "mix-levels"), [], found=F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))))
    s = s.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("found.level") * F.col("weight")), F.col("cap")))
    return s.select("source", "source_size", "weight", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed and key; a null key counts as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / float(1 << 52)


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """Rows (row, size, source_size, target, copies): each row of ``docs`` as a struct, so that no name clashes.

    Null texts have size 0; the null source is a source like any other; rows that share an id share their draw; a
    source without tokens has target 0 and no copies; an empty table gives no rows.
    """
    sized = docs.select(F.struct(*[ident(c) for c in docs.columns]).alias("row"), n_words(ident(text_col)).alias("size"), ident(source_col).cast("string").alias("own"), ident(id_col).alias("key"))
    sizes = cut(sized.groupBy(F.col("own").alias("source")).agg(F.sum("size").alias("source_size")), "mix-sources")
    rates = source_targets(sizes, weights, share, cap).select("source", "source_size", "target", "rate")
    rates = F.broadcast(rates) if sizes.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else rates
    whole = F.floor("rate")
    extra = (draw(F.col("key"), seed) < F.col("rate") - whole).cast("int")
    joined = sized.join(rates, F.col("own").eqNullSafe(F.col("source")))
    return joined.select("row", "size", "source_size", "target", (whole + extra).cast("int").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed table: each row of ``docs`` as many times as its copies say, columns unchanged."""
    many = with_copies(docs, **options).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return many.select("row.*")


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = with_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn, 2.0::DOUBLE * source_size AS cap FROM sizes
), w AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM weighed
), levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, turn) AS place,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), found AS (
  SELECT *, (SELECT arg_min(level, place) FROM levels WHERE level * weight <= cap) AS l FROM levels
), targets AS (
  SELECT source, source_size, coalesce(least(cap, l * weight), cap) AS target FROM found
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
)
SELECT d.doc_id, d.size, r.source_size, r.target,
  d.size * (floor(r.rate)::BIGINT
    + CASE WHEN ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS taken
FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
"""
