"""Dialogues from the perspective of each speaker, with DataFrame functions only.

For every participant the dialogue is rendered with that speaker as the assistant and the others as
named users. The mask gives the characters to learn from: the assistant's words and end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The marks of the rendered format.
START, END = "<|im_start|>", "<|im_end|>"
# A dialogue is rendered in parts of so many turn numbers, so that no row grows with its length.
PART_TURNS = 64


def _head(role: Column, speaker: Column) -> Column:
    return F.concat(
        F.lit(START),
        F.when(role == "system", F.lit("system")).when(role == speaker, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), role)), F.lit("\n"),
    )


def rotate_perspectives(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``conv_id, speaker, part, n_turns, text, mask`` from ``conversations(conv_id, turn, role, text)``.

    Participants are all roles but ``system``, which keeps its role in every rendering; a dialogue of
    system turns alone gives no row. ``mask`` holds ``start:end`` of each span to learn from, in
    characters of ``text``, separated by commas; it is empty for a part in which the speaker is silent.
    Part p holds the turns from ``p * part_turns`` up to the next part's.

    Turns are in order of (turn, role, text). Repeated rows are one turn. A null turn comes first, in
    part -1; a null or blank role is ``unknown``; a null text is empty; rows without conv_id are one
    dialogue. In roles, white space and ``<|>`` become ``_``; in texts, ``<|`` becomes ``< |``, so that
    no text can hold a mark.
    """
    role = F.regexp_replace(F.trim(F.col("role").cast("string")), r"[ \t\r\n<|>]+", "_")
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.nullif(role, F.lit("")), F.lit("unknown")).alias("role"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("bigint")).distinct()
    parts = turns.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = (
        turns.where("role <> 'system'").select("conv_id", F.col("role").alias("speaker")).distinct()
        .withColumnRenamed("conv_id", "of_conv")
    )
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of_conv"))).drop("of_conv")
    heads = F.transform("turns", lambda t: _head(t["role"], F.col("speaker")))
    pieces = F.transform(
        F.arrays_zip("turns", "heads"), lambda x: F.concat(x["heads"], x["turns"]["text"], F.lit(END + "\n"))
    )
    spans = F.transform(
        F.col("turns"),
        lambda t, i: F.when(
            t["role"] == F.col("speaker"),
            F.concat_ws(
                ":", (F.get("begins", i) + F.length(F.get("heads", i))).cast("string"),
                (F.get("begins", i) + F.length(F.get("heads", i)) + F.length(t["text"]) + len(END)).cast("string"),
            ),
        ),
    )
    begins = F.transform(
        F.col("pieces"), lambda _, i: F.aggregate(F.slice("pieces", F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p))
    )
    return (
        both.withColumn("heads", heads).withColumn("pieces", pieces).withColumn("begins", begins)
        .select(
            "conv_id", "speaker", "part", F.size("turns").cast("bigint").alias("n_turns"),
            F.array_join("pieces", "").alias("text"), F.array_join(spans, ",").alias("mask"),
        )
    )


ORACLE = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, part, role, text FROM (
    SELECT conv_id, turn, coalesce(CAST(floor(turn / {PART_TURNS}.0) AS BIGINT), -1) AS part,
      coalesce(nullif(regexp_replace(trim(role), '[ \\t\\r\\n<|>]+', '_', 'g'), ''), 'unknown') AS role,
      replace(coalesce(text, ''), '<|', '< |') AS text
    FROM conversations)
), s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), m AS (
  SELECT t.conv_id, speaker, part, turn, role, text,
    '{START}' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), p AS (
  SELECT *, head || text || '{END}' || chr(10) AS piece,
    row_number() OVER w AS k,
    coalesce(sum(length(head) + length(text) + {len(END) + 1}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a
  FROM m WINDOW w AS (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(piece, '' ORDER BY k) AS text,
  coalesce(string_agg(CAST(a AS VARCHAR) || ':' || CAST(a + length(text) + {len(END)} AS VARCHAR), ',' ORDER BY k) FILTER (role = speaker), '') AS mask
FROM p GROUP BY conv_id, speaker, part
"""
