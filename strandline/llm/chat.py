"""Chat formatting by perspective rotation: each participant in turn is the assistant.

A conversation is rendered once per participant, whole: that speaker's messages as the assistant's, those of others
as named users', system messages as they are. The mask lists the character ranges of the rendering to train on,
which is what the rotated speaker wrote, with the end mark.

A rendering is handed out in blocks of BLOCK messages, in the order of the dialogue, so that no row grows without
bound. Every participant has every block, those in which they are silent too; a participant's blocks, one behind
another, are the whole rendering, and `start` and the mask count characters from its beginning. Nearly all
conversations are one block. Of longer ones messages are ranked in ranges of the order and the blocks' starts are
prefix sums over lengths, so that no task holds a whole conversation.

Defined results for the unusual: rows that repeat a turn's number, role and text are one message; messages of
one turn number are ordered by role, then text; a null turn comes first; a null or empty role is the participant
`unknown`; a null text is empty; rows with a null conv_id belong to no conversation and are left out; a
conversation in which only the system speaks gives no row; texts of any length are rendered whole; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, table, written

#: Messages of one row.
BLOCK = 256
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT, USER = "assistant", "user name="
_ORDER = ("turn", "role", "text")


def _header(role: Column, speaker: Column) -> Column:
    named = F.when(role == SYSTEM, F.lit(SYSTEM)).when(role == speaker, F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER), role))
    return F.concat(F.lit(START), named, F.lit("\n"))


def _distinct(messages: DataFrame) -> DataFrame:
    return messages.filter("conv_id IS NOT NULL").select(
        "conv_id",
        "turn",
        F.when(F.coalesce("role", F.lit("")) == "", F.lit("unknown")).otherwise(F.col("role")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()


def _listed(m: DataFrame) -> DataFrame:
    return m.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct(*_ORDER))).alias("messages"))


def _ranked(m: DataFrame, size: int) -> DataFrame:
    """m with column block: a message's rank in its conversation by turn, role and text, divided by size."""
    dealt = m.repartitionByRange(shuffle_parts(m.sparkSession), "conv_id", *_ORDER).withColumn("range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    held = dealt.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*_ORDER))
    ranked = dealt.withColumn("rank", rank).join(held, ["conv_id", "range"])
    return ranked.withColumn("block", F.floor((F.col("ahead") + F.col("rank") - 1) / size).cast("long")).drop("range", "rank", "ahead")


def _starts(blocked: DataFrame) -> DataFrame:
    """(conv_id, block, participant, start) of every block and every participant of its conversation.

    Only lengths are summed: those of a block as all others read it, and what the headers of a participant's own
    messages differ by.
    """
    spoken = blocked.groupBy("conv_id", "block", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.length("text") + (len(START) + len(END) + 2)).cast("long")).alias("size")
    )
    spoken = written(spoken, "lengths")
    name = F.when(F.col("role") == SYSTEM, F.lit(len(SYSTEM))).otherwise(F.length("role") + len(USER))
    whole = spoken.groupBy("conv_id", "block").agg(F.sum(F.col("size") + F.col("n") * name).alias("size"))
    own = spoken.filter(F.col("role") != SYSTEM).select("conv_id", "block", F.col("role").alias("participant"), (F.col("n") * (len(ASSISTANT) - len(USER) - F.length("role"))).alias("more"))
    each = whole.join(own.select("conv_id", "participant").distinct(), "conv_id").join(own, ["conv_id", "block", "participant"], "left")
    before = Window.partitionBy("conv_id", "participant").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.sum(F.col("size") + F.coalesce("more", F.lit(0))).over(before)
    return each.select("conv_id", "block", "participant", F.coalesce(ahead, F.lit(0)).cast("long").alias("start"))


def blocks(messages: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv_id, block, participant, start, messages): messages is an ordered array<struct<turn, role, text>> of at most size."""
    m = written(_distinct(messages), "messages")
    long = m.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > size).select("conv_id")
    long = written(long, "long")
    speakers = F.array_distinct(F.filter(F.transform("messages", lambda x: x["role"]), lambda r: r != SYSTEM))
    zero = F.lit(0).cast("long")
    short = _listed(m.join(long.hint("merge"), "conv_id", "left_anti").withColumn("block", zero))
    short = short.select("conv_id", "block", F.explode(speakers).alias("participant"), zero.alias("start"), "messages")
    if not long.limit(1).count():
        return short
    blocked = written(_ranked(m.join(long.hint("merge"), "conv_id", "left_semi"), size), "blocks")
    return short.unionByName(_listed(blocked).join(_starts(blocked).hint("merge"), ["conv_id", "block"]))


def rotate(messages: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv_id, participant, block, start, n_messages, n_trained, rendered, mask): every block for every participant.

    mask: array<struct<start, end>>, character ranges of the whole rendering, as start is.
    """
    who = F.col("participant")
    pieces = F.transform(
        "messages",
        lambda x: F.struct(_header(x["role"], who).alias("head"), F.concat(x["text"], F.lit(END)).alias("body"), (x["role"] == who).alias("own")),
    )
    rows = blocks(messages, size).withColumn("pieces", pieces)
    empty = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("mask"))

    def step(s: Column, p: Column) -> Column:
        begin = s["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(s["mask"], span)).otherwise(s["mask"]).alias("mask"))

    return rows.select(
        "conv_id",
        "participant",
        "block",
        "start",
        F.size("messages").alias("n_messages"),
        F.size(F.filter("pieces", lambda p: p["own"])).alias("n_trained"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
        F.aggregate("pieces", empty, step, lambda s: s["mask"]).alias("mask"),
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, whole, for each of its participants; the mask as text."""
    spans = F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string")))
    return rotate(table(spark, sf_dir, "conversations")).withColumn("mask", F.array_join(spans, ","))


SQL = f"""
WITH m AS (
  SELECT DISTINCT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1) // {BLOCK} AS block FROM m
), p AS (SELECT DISTINCT conv_id, role AS participant FROM m WHERE role <> '{SYSTEM}'),
x AS (
  SELECT r.*, p.participant, r.role = p.participant AS own,
         '{START}' || CASE WHEN r.role = '{SYSTEM}' THEN '{SYSTEM}' WHEN r.role = p.participant THEN '{ASSISTANT}' ELSE '{USER}' || r.role END || chr(10) AS head,
         r.text || '{END}' AS body
  FROM r JOIN p USING (conv_id)
), o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER w, 0)::BIGINT AS pos
  FROM x WINDOW w AS (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT conv_id, participant, block::BIGINT AS block, min(pos) AS start, count(*)::INTEGER AS n_messages, (count(*) FILTER (WHERE own))::INTEGER AS n_trained,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN (pos + length(head)) || '-' || (pos + length(head) + length(body)) END, ',' ORDER BY turn NULLS FIRST, role, text), '') AS mask
FROM o GROUP BY 1, 2, 3
"""
