"""Preference formatting: a chosen and a rejected conversation share their longest common prefix of turns as prompt.

The result has one row a turn, not one value a conversation, so a conversation of any length stays distributed; masks
say which turns a trainer learns from. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def render(role: Column, text: Column) -> Column:
    """A turn as text: the role between marks, the text, an end mark. Null roles and texts count as empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def preference_segments(turns: DataFrame) -> DataFrame:
    """turns (pair_id, side 'chosen' or 'rejected', turn, role, text) to rows of prompt and masked completions.

    Returns pair_id, part ('prompt', 'chosen', 'rejected'), turn, sub, role, rendered, mask, paired. Turns equal in
    place, role and text before the first difference are the prompt, rendered once with mask 0; the rest of each side
    is its completion, with mask 1 for the assistant's turns. Of one side, rows that repeat turn, role and text count
    once; other rows of one turn number are numbered by role and text in sub. Null turns come first. A side that is
    missing gives a pair without prompt and paired false; two equal sides are all prompt; null pairs or sides are no
    pair and give no rows; other columns are ignored.
    """
    rows = turns.select("pair_id", "side", "turn", "role", "text").where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")).distinct()
    ranked = rows.withColumn("sub", F.row_number().over(Window.partitionBy("pair_id", "side", "turn").orderBy("role", "text")))
    said = F.struct("role", "text")
    places = ranked.groupBy("pair_id", F.coalesce("turn", F.lit(-(1 << 62))).alias("at"), "sub").agg(
        F.first("turn").alias("turn"), F.max(F.when(F.col("side") == "chosen", said)).alias("chosen"), F.max(F.when(F.col("side") == "rejected", said)).alias("rejected")
    )
    place = F.struct("at", "sub")
    parts = places.groupBy("pair_id").agg(
        F.min(F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), place)).alias("parts_at"),
        (F.max(F.col("chosen").isNotNull()) & F.max(F.col("rejected").isNotNull())).alias("paired"),
    )
    joined = places.join(parts, "pair_id")
    shared = F.col("parts_at").isNull() | (place < F.col("parts_at"))
    pick = lambda part, turn: F.struct(F.lit(part).alias("part"), turn.alias("said"))
    sides = F.when(shared, F.array(pick("prompt", F.col("chosen")))).otherwise(F.filter(F.array(pick("chosen", F.col("chosen")), pick("rejected", F.col("rejected"))), lambda x: x["said"].isNotNull()))
    flat = joined.select("pair_id", "turn", "sub", "paired", F.explode(sides).alias("x"))
    return flat.select(
        "pair_id", F.col("x.part").alias("part"), "turn", "sub", F.col("x.said.role").alias("role"), render(F.col("x.said.role"), F.col("x.said.text")).alias("rendered"),
        F.when((F.col("x.part") != "prompt") & (F.col("x.said.role") == "assistant"), 1).otherwise(0).alias("mask"), "paired",
    )


def assemble(segments: DataFrame) -> DataFrame:
    """One row a pair: prompt, chosen, rejected as text. Only for pairs that fit in a row."""
    def joined(part: str) -> Column:
        kept = F.collect_list(F.when(F.col("part") == part, F.struct("turn", "sub", "rendered")))
        return F.array_join(F.transform(F.array_sort(kept), lambda x: x["rendered"]), "").alias(part)

    return segments.groupBy("pair_id").agg(joined("prompt"), joined("chosen"), joined("rejected"), F.max("paired").alias("paired"))


def exchanged_answers(conversations: DataFrame) -> DataFrame:
    """Each conversation as chosen, and as rejected with its last answer exchanged for that of its neighbour.

    Neighbours are 2k and 2k + 1. The answer is the assistant's row of the highest turn (of several, the greatest text);
    without a neighbour, or with a neighbour that has none, it becomes empty. A conversation without an answer is its own
    rejected side. Null conv_ids give no rows; other columns are ignored.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL").distinct()
    answers = rows.where("role = 'assistant' AND turn IS NOT NULL").groupBy("conv_id").agg(F.max("turn").alias("at"), F.max_by("text", F.struct("turn", "text")).alias("said"))
    others = answers.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("said").alias("other"))
    swapped = rows.join(answers.select("conv_id", "at").join(others, "conv_id", "left"), "conv_id", "left")
    text = F.when((F.col("role") == "assistant") & (F.col("turn") == F.col("at")), F.coalesce("other", F.lit(""))).otherwise(F.col("text"))
    side = lambda df, name, text: df.select(F.col("conv_id").alias("pair_id"), F.lit(name).alias("side"), "turn", "role", text.alias("text"))
    return side(rows, "chosen", F.col("text")).unionByName(side(swapped, "rejected", text))


SQL = """
WITH base AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
ends AS (SELECT conv_id, max(turn) AS at_turn FROM base WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY 1),
answers AS (SELECT b.conv_id, at_turn, max(b.text) AS said FROM base b JOIN ends e ON b.conv_id = e.conv_id AND b.turn = e.at_turn WHERE b.role = 'assistant' GROUP BY 1, 2),
other AS (SELECT a.conv_id, a.at_turn, coalesce(b.said, '') AS said FROM answers a LEFT JOIN answers b ON b.conv_id = xor(a.conv_id, 1)),
rows AS (SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM base
  UNION ALL SELECT DISTINCT b.conv_id, 1, turn, role, CASE WHEN role = 'assistant' AND turn = at_turn THEN o.said ELSE text END FROM base b LEFT JOIN other o ON o.conv_id = b.conv_id),
ranked AS (SELECT *, coalesce(turn, -4611686018427387904) AS pos, row_number() OVER (PARTITION BY pair_id, side, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS sub FROM rows),
places AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.pos, r.pos) AS pos, coalesce(c.sub, r.sub) AS sub, coalesce(c.turn, r.turn) AS turn,
    c.pair_id IS NOT NULL AS has_c, c.role AS c_role, c.text AS c_text, r.pair_id IS NOT NULL AS has_r, r.role AS r_role, r.text AS r_text
  FROM (SELECT * FROM ranked WHERE side = 0) c FULL OUTER JOIN (SELECT * FROM ranked WHERE side = 1) r ON c.pair_id = r.pair_id AND c.pos = r.pos AND c.sub = r.sub),
differ AS (SELECT *, NOT (has_c AND has_r AND c_role IS NOT DISTINCT FROM r_role AND c_text IS NOT DISTINCT FROM r_text) AS d FROM places),
parts AS (SELECT pair_id, min(CASE WHEN d THEN pos END) AS d_at, bool_or(has_c) AND bool_or(has_r) AS paired FROM differ GROUP BY 1),
subs AS (SELECT p.pair_id, min(x.sub) AS d_sub FROM parts p JOIN differ x ON x.pair_id = p.pair_id AND x.pos = p.d_at AND x.d GROUP BY 1),
joined AS (SELECT x.*, p.paired, p.d_at IS NULL OR x.pos < p.d_at OR (x.pos = p.d_at AND x.sub < s.d_sub) AS shared FROM differ x JOIN parts p USING (pair_id) LEFT JOIN subs s USING (pair_id)),
flat AS (SELECT pair_id, 'prompt' AS part, turn, sub, c_role AS role, c_text AS text, paired FROM joined WHERE shared
  UNION ALL SELECT pair_id, 'chosen', turn, sub, c_role, c_text, paired FROM joined WHERE NOT shared AND has_c
  UNION ALL SELECT pair_id, 'rejected', turn, sub, r_role, r_text, paired FROM joined WHERE NOT shared AND has_r)
SELECT pair_id, part, turn, CAST(sub AS INTEGER) AS sub, role, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN 1 ELSE 0 END AS mask, paired FROM flat
"""
