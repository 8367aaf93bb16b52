"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once with that speaker as the assistant: the
speaker's own turns are what a model learns, all other speakers are named users, and turns of a context role (system)
stand as they are. Spans of the learned text are given as code-point offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK_TURNS = 256
CONTEXT_ROLES = ("system",)
UNKNOWN = "unknown"
END = "<|end|>\n"


def numbered_turns(turns: DataFrame, conv: str, turn: str, speaker: str, text: str, block: int = BLOCK_TURNS) -> DataFrame:
    """``conv_id, n, speaker, text``: turns numbered from 0 in the order of turn, speaker and text, null turns last.

    A conversation is cut into spans of turn numbers; spans are numbered inside and offset by the sizes of the spans before,
    so a conversation of any length is not ordered in one task. Rows equal in all four columns are one turn;
    ``copies`` says how many there were.
    """
    plain = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    once = plain.groupBy("conv_id", "turn", "speaker", "text").agg(F.count("*").alias("copies"))
    # Null turns come after the last span.
    cut = once.withColumn("span", F.coalesce(F.floor(F.col("turn") / block), F.lit(2**62)))
    before = W.partitionBy("conv_id").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    bases = cut.groupBy("conv_id", "span").agg(F.count("*").alias("c")).select(
        F.col("conv_id").alias("_conv"), F.col("span").alias("_span"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base")
    )
    within = W.partitionBy("conv_id", "span").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
    placed = cut.withColumn("rn", F.row_number().over(within)).join(
        bases, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("span") == F.col("_span"))
    )
    return placed.select("conv_id", (F.col("base") + F.col("rn") - 1).alias("n"), "speaker", "text", "copies")


def _header(own: Column, context: Column) -> Column:
    return (
        F.when(own, F.lit("<|assistant|>\n"))
        .when(context, F.concat(F.lit("<|"), F.col("speaker"), F.lit("|>\n")))
        .otherwise(F.concat(F.lit("<|user name="), F.col("speaker"), F.lit("|>\n")))
    )


def rotated(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
    context_roles: tuple[str, ...] = CONTEXT_ROLES, block: int = BLOCK_TURNS,
) -> DataFrame:
    """``conv_id, perspective, block, n_turns, n_rows, text, mask`` for every participant of every conversation.

    ``mask`` holds the spans ``{start, end}`` in ``text`` that are learned: the participant's own turns with their end
    marks. Dialogues of more than ``block`` turns come in consecutive blocks whose texts concatenate to the whole.
    A null speaker is the participant ``unknown``; null texts are empty turns; turns with a null number come last; turns with one number are
    ordered by speaker and text; a null conversation id is one conversation. Conversations that have context turns only
    have no participant and no row, as has an empty table.
    """
    numbered = numbered_turns(turns, conv, turn, speaker, text, block)
    is_context = F.col("speaker").isin(*context_roles) if context_roles else F.lit(False)
    people = numbered.where(~is_context).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    views = numbered.join(people, F.col("conv_id").eqNullSafe(F.col("_conv")))
    own = F.col("speaker") == F.col("perspective")
    pieces = views.select(
        "conv_id", "perspective", F.floor(F.col("n") / block).alias("block"), "n", "copies", own.alias("own"),
        _header(own, is_context).alias("head"), F.concat("text", F.lit(END)).alias("body"),
    )
    size = F.char_length("head") + F.char_length("body")
    until = W.partitionBy("conv_id", "perspective", "block").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    offset = pieces.withColumn("end", F.sum(size).over(until).cast("long"))
    span = F.struct((F.col("end") - F.char_length("body")).alias("start"), F.col("end"))
    # At most ``block`` turns meet in a row.
    rendered = offset.groupBy("conv_id", "perspective", "block").agg(
        F.count("*").alias("n_turns"), F.sum("copies").alias("n_rows"),
        F.sort_array(F.collect_list(F.struct("n", F.concat("head", "body").alias("t")))).alias("parts"),
        F.sort_array(F.collect_list(F.when(F.col("own"), span))).alias("mask"),
    )
    return rendered.select(
        "conv_id", "perspective", "block", "n_turns", "n_rows",
        F.array_join(F.col("parts.t"), "").alias("text"), "mask",
    )


ORACLE = """
WITH once AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text, count(*) AS copies
  FROM conversations GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, speaker, text) - 1 AS n FROM once),
v AS (SELECT t.conv_id, p.speaker AS perspective, n // 256 AS block, n, copies, t.speaker = p.speaker AS own,
  CASE WHEN t.speaker = p.speaker THEN '<|assistant|>' || chr(10) WHEN t.speaker = 'system' THEN '<|system|>' || chr(10)
    ELSE '<|user name=' || t.speaker || '|>' || chr(10) END AS head, text || '<|end|>' || chr(10) AS body
  FROM t JOIN (SELECT DISTINCT conv_id, speaker FROM once WHERE speaker <> 'system') p
    ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, block ORDER BY n) AS e FROM v)
SELECT conv_id, perspective, block::BIGINT AS block, count(*) AS n_turns, sum(copies)::BIGINT AS n_rows,
  string_agg(head || body, '' ORDER BY n) AS text,
  coalesce(string_agg((e - length(body))::BIGINT || '-' || e::BIGINT, ',' ORDER BY n) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, perspective, block
"""
