"""Preference formatting of conversations (operator 6).

A pair is a chosen and a rejected conversation. Their longest common prefix of
turns (equal role and text) is rendered once as the prompt; what follows in
either is its completion, with a mask: loss only falls on assistant turns of a
completion, from the end of the turn's header on.

Turns come out as one row each, in order; concatenating a part's rows in order of
``seq`` gives its text. A conversation's turns are numbered by a window, so they
are sorted in one task, which spills; turns of the two sides are then compared by
(pair, position) with partial aggregation, and no text is gathered in a row.

The markers' own strings inside a role or text are broken by a blank after ``<|``,
and line feeds in a role become blanks, so that no text can pose as a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The public ChatML markers.
START, END = "<|im_start|>", "<|im_end|>\n"


def _harmless(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def format_pairs(turns: DataFrame) -> DataFrame:
    """``pair_id, part, seq, role, rendered, loss_from`` for each rendered turn.

    ``turns``: ``pair_id, side ('chosen' or 'rejected'), turn, role, text``.
    ``part`` is ``prompt``, ``chosen`` or ``rejected``; ``seq`` counts turns
    from 0 through prompt and completion; ``loss_from`` is the number of
    characters of ``rendered`` that stay masked, null if all do.

    Turns order by number, then role and text; identical repeated rows count
    once. Null roles and texts are rendered empty. Equal conversations are all
    prompt with no completions; a side without turns has none. An empty table
    gives no rows. Other columns are ignored.
    """
    rows = turns.select("pair_id", "side", "turn", _harmless(F.translate(F.coalesce("role", F.lit("")), "\n", " ")).alias("role"), _harmless(F.coalesce("text", F.lit(""))).alias("text")).distinct()
    order = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    rows = rows.withColumn("seq", (F.row_number().over(order) - 1).cast("int"))
    # two digests stand for a turn, so comparing moves no text
    digest = F.struct(F.xxhash64("role", "text"), F.sha2(F.concat_ws("\u0001", "role", "text"), 256))
    met = rows.groupBy("pair_id", "seq").agg(
        F.max(F.when(F.col("side") == "chosen", digest)).alias("c"), F.max(F.when(F.col("side") == "rejected", digest)).alias("r")
    )
    first = met.groupBy("pair_id").agg(F.min(F.when(~F.coalesce(F.col("c") == F.col("r"), F.lit(False)), F.col("seq"))).alias("shared"))
    placed = rows.join(first, "pair_id")
    prompt = F.coalesce(F.col("seq") < F.col("shared"), F.lit(True))
    header = F.concat(F.lit(START), F.col("role"), F.lit("\n"))
    return placed.where(~prompt | (F.col("side") == "chosen")).select(
        "pair_id",
        F.when(prompt, F.lit("prompt")).otherwise(F.col("side")).alias("part"),
        "seq",
        "role",
        F.concat(header, F.col("text"), F.lit(END)).alias("rendered"),
        F.when(~prompt & (F.col("role") == "assistant"), F.length(header)).alias("loss_from"),
    )


def with_stale_answers(conversations: DataFrame) -> DataFrame:
    """Pairs from conversations without preference labels.

    Chosen is the conversation; rejected is the same but for its last assistant
    turn, which repeats the assistant turn before it, or, if there is none,
    the turn just before it, or else is empty. Conversations without an assistant turn
    have no pair. Computed with windows over a conversation's turns.
    """
    rows = conversations.select(F.col("conv_id").alias("pair_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    order = Window.partitionBy("pair_id").orderBy("turn", "role", "text")
    answer = F.when(F.col("role") == "assistant", F.col("text"))
    rows = rows.select(
        "*",
        F.lag("text").over(order).alias("before"),
        F.last(answer, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("answer"),
        F.count(answer).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("left"),
        F.count(answer).over(Window.partitionBy("pair_id")).alias("answers"),
    ).where("answers > 0")
    stale = (F.col("role") == "assistant") & (F.col("left") == 1)
    side = F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("said")), F.struct(F.lit("rejected").alias("side"), F.when(stale, F.coalesce("answer", "before", F.lit(""))).otherwise(F.col("text")).alias("said"))))
    return rows.select("pair_id", "turn", "role", side.alias("s")).select("pair_id", "s.side", "turn", "role", F.col("s.said").alias("text"))


#: format_pairs(with_stale_answers(conversations)) in DuckDB SQL.
ORACLE = """
WITH r AS (SELECT DISTINCT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
w AS (
  SELECT *, lag(text) OVER o AS before,
    last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY pair_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS answer,
    count(CASE WHEN role = 'assistant' THEN 1 END) OVER (PARTITION BY pair_id ORDER BY turn, role, text ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    count(CASE WHEN role = 'assistant' THEN 1 END) OVER (PARTITION BY pair_id) AS answers
  FROM r WINDOW o AS (PARTITION BY pair_id ORDER BY turn, role, text)),
s AS (
  SELECT pair_id, 'chosen' AS side, turn, role, text FROM w WHERE answers > 0
  UNION
  SELECT pair_id, 'rejected', turn, role, CASE WHEN role = 'assistant' AND rest = 1 THEN coalesce(answer, before, '') ELSE text END FROM w WHERE answers > 0),
e AS (SELECT DISTINCT pair_id, side, turn, replace(replace(role, chr(10), ' '), '<|im_', '<| im_') AS role, replace(text, '<|im_', '<| im_') AS text FROM s),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) - 1 AS INTEGER) AS seq FROM e),
f AS (
  SELECT pair_id, min(seq) AS shared FROM (
    SELECT coalesce(c.pair_id, j.pair_id) AS pair_id, coalesce(c.seq, j.seq) AS seq
    FROM (SELECT * FROM n WHERE side = 'chosen') c FULL JOIN (SELECT * FROM n WHERE side = 'rejected') j ON c.pair_id = j.pair_id AND c.seq = j.seq
    WHERE c.role IS DISTINCT FROM j.role OR c.text IS DISTINCT FROM j.text)
  GROUP BY pair_id)
SELECT n.pair_id, CASE WHEN shared IS NULL OR seq < shared THEN 'prompt' ELSE side END AS part, seq, role,
  '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered,
  CASE WHEN seq >= shared AND role = 'assistant' THEN CAST(length('<|im_start|>' || role || chr(10)) AS INTEGER) END AS loss_from
FROM n LEFT JOIN f USING (pair_id) WHERE side = 'chosen' OR seq >= shared
"""
