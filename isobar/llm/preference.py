"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

The longest common prefix of turns of a pair is rendered once as the prompt; what follows in either
conversation is a completion with a mask. One shuffle, by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE))


def _body(t: Column) -> Column:
    return F.concat(t["text"], F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column, learned: str) -> Column:
    """Runs `flag:characters` over the rendered turns: 1 where the loss counts (the text and end mark of learned turns), else 0."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit("0:"), F.length(_head(t)).cast("string"), F.when(t["role"] == learned, ",1:").otherwise(",0:"), F.length(_body(t)).cast("string"))), ","
    )


def format_preferences(turns: DataFrame, pair: Column, rejected: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: str = "assistant") -> DataFrame:
    """One row for each pair that has both sides.

    turns has a row for each turn; `pair` names its pair and `rejected` tells its side. Returns pair_id,
    prompt_turns (the length of the longest common prefix of turns, by role and text), prompt, chosen,
    rejected, chosen_mask and rejected_mask. A completion is empty if that conversation is a prefix of the
    other. Turns are ordered by turn, then role and text (repeated rows are turns of their own; a null turn
    comes first). Null roles count as "unknown", null texts as empty. Rows whose pair or side is null, and pairs with
    one side only, are no pairs. Other columns are not read; an empty table gives no rows.
    """
    t = turns.select(
        pair.alias("pair_id"), rejected.cast("boolean").alias("__side"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("__turn"),
    ).where("pair_id is not null and __side is not null")
    sides = t.groupBy("pair_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("__side") == s, F.col("__turn")))).alias(n) for n, s in (("c", False), ("r", True))))
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    both = sides.where("size(c) > 0 and size(r) > 0").withColumn("k", F.when(first > 0, first - 1).otherwise(F.size("c")).cast("int"))
    rest = lambda x: F.slice(F.col(x), F.col("k") + 1, F.greatest(F.size(x) - F.col("k"), F.lit(0)))
    return both.select(
        "pair_id", F.col("k").alias("prompt_turns"), render(F.slice("c", F.lit(1), F.col("k"))).alias("prompt"),
        render(rest("c")).alias("chosen"), render(rest("r")).alias("rejected"), mask(rest("c"), learned).alias("chosen_mask"), mask(rest("r"), learned).alias("rejected_mask"),
    )


#: The same for pairs of the conversations 2m (chosen) and 2m + 1 (rejected), in DuckDB's SQL.
ORACLE = r"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS rn
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT pair_id, count(*) FILTER (WHERE side = 0) AS nc FROM t GROUP BY pair_id HAVING count(DISTINCT side) = 2),
d AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, min(coalesce(c.rn, r.rn)) AS k
  FROM (SELECT * FROM t WHERE side = 0) c FULL JOIN (SELECT * FROM t WHERE side = 1) r ON c.pair_id = r.pair_id AND c.rn = r.rn
  WHERE c.rn IS NULL OR r.rn IS NULL OR c.role <> r.role OR c.text <> r.text GROUP BY 1),
k AS (SELECT p.pair_id, coalesce(d.k - 1, p.nc) AS k FROM p LEFT JOIN d USING (pair_id)),
u AS (
  SELECT t.pair_id, t.side, t.rn, k.k, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS whole,
         '0:' || (length(role) + 5) || CASE WHEN role = 'assistant' THEN ',1:' ELSE ',0:' END || (length(text) + 8) AS m
  FROM t JOIN k USING (pair_id))
SELECT pair_id, CAST(any_value(k) AS INTEGER) AS prompt_turns,
       coalesce(string_agg(whole, '' ORDER BY rn) FILTER (WHERE side = 0 AND rn <= k), '') AS prompt,
       coalesce(string_agg(whole, '' ORDER BY rn) FILTER (WHERE side = 0 AND rn > k), '') AS chosen,
       coalesce(string_agg(whole, '' ORDER BY rn) FILTER (WHERE side = 1 AND rn > k), '') AS rejected,
       coalesce(string_agg(m, ',' ORDER BY rn) FILTER (WHERE side = 0 AND rn > k), '') AS chosen_mask,
       coalesce(string_agg(m, ',' ORDER BY rn) FILTER (WHERE side = 1 AND rn > k), '') AS rejected_mask
FROM u GROUP BY pair_id
"""
