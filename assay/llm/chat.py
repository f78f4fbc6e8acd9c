"""Multi-party perspective rotation of dialogues (operator 8, DataFrame operations only).

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, the others as
named users, narrators as the system, and a mask of spans that covers the assistant's words only.

Turns get their place in the conversation over sorted ranges, so that no conversation, however long, is ordered in one
task. A dialogue is rendered in parts of at most ``PART_TURNS`` turns, so that none is gathered whole; the text of a
perspective is its parts' texts in a row, and there is one part unless the conversation is longer. Speakers are
pre-aggregated to one row per conversation and speaker before they meet the turns again, in an equi-join whose skew
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.exprs import ident
from assay.llm.shared import table
from assay.plans.ranks import running

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Speakers that set the scene and never become the assistant.
NARRATORS = ("system",)
#: Turns of a part.
PART_TURNS = 256


def escaped(text: Column) -> Column:
    """``text`` without any mark: each ``<|``, backslashes between or not, gets one more backslash. ``unescaped`` undoes it."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_name(name: Column) -> Column:
    """A name on one line and without marks: backslashes doubled, line ends as ``\\n`` and ``\\r``, then as ``escaped``."""
    plain = F.replace(F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return escaped(plain)


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", narrators=NARRATORS) -> DataFrame:
    """One row per conversation, participant and turn.

    Columns: conv_id, perspective (the participant), turn, place (from 0, of the turn in its conversation), speaker,
    role (assistant, user or system), name (the speaker's, null unless role is user), rendered, target (whether the
    turn is trained on), target_start and target_len (code points of ``rendered`` that the mask covers: the text and
    its end mark; 0 and 0 where nothing is trained).

    Turns are in the order of ``turn``, null first, then speaker, null first, then the MD5 of the text, so that
    repeated and tied turns have one order too. A null speaker is a participant of its own, apart from any name, and
    has none in the text; null texts are empty. Narrators are system turns in every perspective, and a conversation of
    narrators only has no perspective and no rows. A row without a conversation is no part of a dialogue with others:
    it is rendered by itself, in its speaker's perspective. Texts and names are escaped, so neither can forge a mark.
    Extra columns are ignored.
    """
    t = turns.select(ident(conv_col).alias("conv_id"), ident(turn_col).alias("turn"), ident(speaker_col).cast("string").alias("speaker"), F.coalesce(ident(text_col).cast("string"), F.lit("")).alias("text"))
    narrator = F.coalesce(F.col("speaker").isin(*narrators), F.lit(False)) if narrators else F.lit(False)
    together = t.where("conv_id is not null").withColumns(
        {
            "turn_known": F.col("turn").isNotNull(), "turn_at": F.coalesce("turn", F.lit(0).cast(dict(t.dtypes)["turn"])), "speaker_known": F.col("speaker").isNotNull(),
            "speaker_at": F.coalesce("speaker", F.lit("")), "text_at": F.md5(F.col("text").cast("binary")), "one": F.lit(1).cast("long"),
        }
    )
    placed = running(together, ["turn_known", "turn_at", "speaker_known", "speaker_at", "text_at"], {"place": "one"}, group=["conv_id"])
    placed = placed.select("conv_id", "turn", (F.col("place") - 1).alias("place"), "speaker", "text")
    people = t.where(F.col("conv_id").isNotNull() & ~narrator).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    alone = t.where(F.col("conv_id").isNull() & ~narrator).select("conv_id", "turn", F.lit(0).cast("long").alias("place"), "speaker", "text", F.col("speaker").alias("perspective"))
    both = placed.join(people, "conv_id").unionByName(alone)
    target = F.col("speaker").eqNullSafe(F.col("perspective"))
    role = F.when(narrator, F.lit("system")).when(target, F.lit("assistant")).otherwise(F.lit("user"))
    head = F.concat(F.lit(OPEN), F.col("role"), F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), escaped_name(F.col("name")))).otherwise(F.lit("")), F.lit("\n"))
    out = both.withColumn("target", target).withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker"))).withColumn("head", head).withColumn("text", escaped(F.col("text")))
    return out.select(
        "conv_id", "perspective", "turn", "place", "speaker", "role", "name",
        F.concat("head", "text", F.lit(CLOSE + "\n")).alias("rendered"),
        "target",
        F.when(F.col("target"), F.length("head")).otherwise(0).cast("long").alias("target_start"),
        F.when(F.col("target"), F.length("text") + len(CLOSE)).otherwise(0).cast("long").alias("target_len"),
    )


def render_dialogues(turns: DataFrame, part_turns: int = PART_TURNS, **options) -> DataFrame:
    """One row per conversation, participant and part of ``part_turns`` turns: the dialogue as one text, with its mask.

    Columns: conv_id, perspective, part (from 0), n_turns, text, spans (array of start and len in code points of
    ``text``, in order: what is trained on). What ``rotate_perspectives`` says of nulls, ties and marks holds. Each row
    without a conversation is a dialogue of its own.
    """
    rows = rotate_perspectives(turns, **options)
    turn = F.struct("place", "rendered", "target", "target_start", "target_len")
    single = rows.where("conv_id is null").select("conv_id", "perspective", F.lit(0).cast("long").alias("part"), F.array(turn).alias("turns"))
    parts = rows.where("conv_id is not null").groupBy("conv_id", "perspective", F.floor(F.col("place") / part_turns).alias("part")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    none = F.array().cast("array<struct<start:bigint,len:bigint>>")
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")),
        lambda got, x: F.struct(
            (got["at"] + F.length(x["rendered"])).alias("at"),
            F.when(x["target"], F.concat(got["spans"], F.array(F.struct((got["at"] + x["target_start"]).alias("start"), x["target_len"].alias("len"))))).otherwise(got["spans"]).alias("spans"),
        ),
        lambda got: got["spans"],
    )
    text = F.array_join(F.transform("turns", lambda x: x["rendered"]), "")
    return parts.unionByName(single).select("conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), spans.alias("spans"))


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = render_dialogues(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["len"].cast("string"))), ";")
    return found.withColumn("spans", mask).withColumnRenamed("spans", "mask")


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN 0 ELSE row_number() OVER
    (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(coalesce(text, ''))) - 1 END AS place, row_number() OVER () AS id FROM conversations
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE conv_id IS NOT NULL AND speaker IS DISTINCT FROM 'system'
), b AS (
  SELECT t.*, p.perspective, 0 AS alone FROM t JOIN people p ON t.conv_id = p.conv_id UNION ALL SELECT t.*, speaker, id FROM t WHERE conv_id IS NULL AND speaker IS DISTINCT FROM 'system'
), r AS (
  SELECT *, speaker IS NOT DISTINCT FROM perspective AS target,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker IS NOT DISTINCT FROM perspective THEN 'assistant' ELSE 'user' END AS role FROM b
), h AS (
  SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' AND speaker IS NOT NULL
    THEN ' name=' || regexp_replace(replace(replace(replace(speaker, '\', '\\'), chr(10), '\n'), chr(13), '\r'), '<(\\*)\|', '<\1\\|', 'g') ELSE '' END || chr(10) AS head,
    regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS body FROM r
), w AS (
  SELECT *, place // 256 AS part, head || body || '<|im_end|>' || chr(10) AS rendered FROM h
), o AS (
  SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective, part, alone ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w
)
SELECT conv_id, perspective, part::BIGINT AS part, count(*) AS n_turns, string_agg(rendered, '' ORDER BY place) AS text,
  coalesce(string_agg((before + length(head))::BIGINT || ':' || (length(body) + 10), ';' ORDER BY place) FILTER (target), '') AS mask
FROM o GROUP BY conv_id, perspective, part, alone
"""
