"""Preference pairs as chat: the common turns once as prompt, the rest as two completions with masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import read_table

#: Marks of the chat form.
START, END = "<|im_start|>", "<|im_end|>"
#: Turns of this role are learned; all else is masked.
LEARNED = "assistant"

_TURN = "array<struct<turn:bigint,role:string,text:string>>"


def _escaped(text: Column) -> Column:
    """A text with the marks of the form made harmless: a space after their first character."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("< |im_"))


def _body(turn: Column) -> Column:
    return F.concat(_escaped(turn["text"]), F.lit(END))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))


def render(turns: Column) -> Column:
    """Turns as one text; empty for none."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def learned_spans(turns: Column) -> Column:
    """Spans (start, end, in characters) of the rendered text that are learned: text and end mark of assistant turns."""
    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(_head(t))
        end = start + F.length(_body(t))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        none = F.array().cast("array<struct<start:int,end:int>>")
        learned = F.coalesce(t["role"] == LEARNED, F.lit(False))
        return F.struct((end + 1).alias("at"), F.concat(state["spans"], F.when(learned, span).otherwise(none)).alias("spans"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, first, step, lambda s: s["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """How many first turns of both have the same role and text (null equals null)."""
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    place = F.array_position(same, F.lit(False))
    return F.when(place > 0, place - 1).otherwise(F.size(same)).cast("int")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Pairs of conversations (pair_id, chosen, rejected: arrays of turn, role, text, in order) to prompt and completions.

    ``prompt`` renders the longest common first turns once and is all masked.
    ``chosen`` and ``rejected`` render what follows; their masks are the spans
    that are learned, so that everything outside them is masked.  A null
    conversation has no turns; equal conversations have empty completions;
    conversations without a common turn have an empty prompt.
    """
    none = F.array().cast(_TURN)
    df = pairs.select("pair_id", F.coalesce("chosen", none).alias("_a"), F.coalesce("rejected", none).alias("_b"))
    df = df.withColumn("n_prompt_turns", common_turns(F.col("_a"), F.col("_b")))

    def rest(turns: str) -> Column:
        return F.slice(turns, F.col("n_prompt_turns") + 1, F.greatest(F.size(turns) - F.col("n_prompt_turns"), F.lit(0)))

    df = df.withColumn("_chosen", rest("_a")).withColumn("_rejected", rest("_b"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return df.select(
        "pair_id",
        "n_prompt_turns",
        render(F.slice("_a", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        render(F.col("_chosen")).alias("chosen"),
        text(learned_spans(F.col("_chosen"))).alias("chosen_spans"),
        render(F.col("_rejected")).alias("rejected"),
        text(learned_spans(F.col("_rejected"))).alias("rejected_spans"),
    )


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) to one row a conversation: ``turns`` in order.

    Repeated turns stay, ordered by role and text; null turn numbers come first.
    A conversation is the unit to be rendered, so it has to fit a row.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def stale_reply_pairs(conversations: DataFrame) -> DataFrame:
    """A preference pair from each conversation: chosen is the conversation, rejected repeats an earlier reply.

    The rejected side ends at the last assistant turn, whose text is replaced by
    that of the assistant turn before it; with one assistant turn it ends before
    that, and with none it is empty.
    """
    df = conversation_turns(conversations)
    said = F.transform("turns", lambda t, i: F.when(t["role"] == LEARNED, i))
    places = F.filter(said, lambda i: i.isNotNull())
    df = df.withColumn("_places", places)
    last, before = F.get("_places", F.size("_places") - 1), F.get("_places", F.size("_places") - 2)
    df = df.withColumn("_last", last).withColumn("_before", before)
    head = F.slice("turns", F.lit(1), F.coalesce("_last", F.lit(0)))
    stale = F.struct(
        F.get("turns", F.col("_last"))["turn"].alias("turn"),
        F.lit(LEARNED).alias("role"),
        F.get("turns", F.col("_before"))["text"].alias("text"),
    )
    rejected = F.when(F.size("_places") >= 2, F.concat(head, F.array(stale).cast(_TURN))).otherwise(head)
    return df.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


def op1_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair from every conversation."""
    return format_preferences(stale_reply_pairs(read_table(spark, sf_dir, "conversations")))


def op1_sql() -> str:
    body = f"replace(coalesce(text, ''), '<|im_', '< |im_') || '{END}'"
    return f"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM conversations),
k AS (
  SELECT conv_id, max(i) FILTER (role = '{LEARNED}') AS last,
    max(i) FILTER (role = '{LEARNED}' AND i < l) AS before
  FROM (SELECT *, max(CASE WHEN role = '{LEARNED}' THEN i END) OVER (PARTITION BY conv_id) AS l FROM t) GROUP BY conv_id),
r AS (
  SELECT conv_id, i, t.role, CASE WHEN i = last THEN b.text ELSE t.text END AS text
  FROM t JOIN k USING (conv_id) LEFT JOIN (SELECT conv_id, i AS before, text FROM t) b USING (conv_id, before)
  WHERE i < last OR i = last AND before IS NOT NULL),
n AS (
  SELECT k.conv_id, least(coalesce(x.i - 1, 1e9), coalesce(c.n, 0), coalesce(d.n, 0)) AS n
  FROM k LEFT JOIN (SELECT conv_id, count(*) AS n FROM t GROUP BY 1) c USING (conv_id)
  LEFT JOIN (SELECT conv_id, count(*) AS n FROM r GROUP BY 1) d USING (conv_id)
  LEFT JOIN (SELECT t.conv_id, min(t.i) AS i FROM t JOIN r USING (conv_id, i)
    WHERE t.role IS DISTINCT FROM r.role OR t.text IS DISTINCT FROM r.text GROUP BY 1) x USING (conv_id)),
f AS (
  SELECT 'a' AS side, conv_id, i, role, text FROM t UNION ALL SELECT 'b', conv_id, i, role, text FROM r),
g AS (
  SELECT side, f.conv_id, i, i > n AS later, role, '{START}' || coalesce(role, '') || chr(10) AS head, {body} AS body
  FROM f JOIN n USING (conv_id)),
h AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY side, conv_id, later ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM g),
s AS (
  SELECT conv_id,
    string_agg(head || body || chr(10), '' ORDER BY i) FILTER (side = 'a' AND NOT later) AS prompt,
    string_agg(head || body || chr(10), '' ORDER BY i) FILTER (side = 'a' AND later) AS chosen,
    string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(body) AS BIGINT), ',' ORDER BY i) FILTER (side = 'a' AND later AND role = '{LEARNED}') AS chosen_spans,
    string_agg(head || body || chr(10), '' ORDER BY i) FILTER (side = 'b' AND later) AS rejected,
    string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(body) AS BIGINT), ',' ORDER BY i) FILTER (side = 'b' AND later AND role = '{LEARNED}') AS rejected_spans
  FROM h GROUP BY conv_id)
SELECT conv_id AS pair_id, CAST(n AS INTEGER) AS n_prompt_turns, coalesce(prompt, '') AS prompt,
  coalesce(chosen, '') AS chosen, coalesce(chosen_spans, '') AS chosen_spans,
  coalesce(rejected, '') AS rejected, coalesce(rejected_spans, '') AS rejected_spans
FROM s JOIN n USING (conv_id)
"""
