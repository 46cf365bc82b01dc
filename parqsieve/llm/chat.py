"""Multi-party perspective rotation of dialogues.

For each participant of a conversation the whole dialogue is rendered with that speaker as the assistant, the others as
named users, and system turns as system. ``spans`` are the character ranges [begin, end) of the assistant's turns, the
ones that training is to learn from, and ``labels`` the mask, 1 or 0 for each turn. Turns go by number, equal numbers by
role and text, null numbers first. A null text is an empty one, a null role is a speaker of the name "unknown" and goes as such. Rows with a
null conv_id are no conversation and are left out. A conversation of system turns only has no participant and no row.

DataFrame functions only; the one shuffle, by conv_id, carries each turn once. A conversation has to fit in a row, as its
rendering does; within it nothing grows but with its turns times its participants, which is the size of the result. Where
a turn begins is summed up once for each conversation, as if all speakers were named users; a participant's own turns before
it shift that by the same length each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parqsieve.llm.common import pick, read_table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate(turns: DataFrame, system: str = "system") -> DataFrame:
    """conv_id, speaker, n_turns, n_trained, rendered, labels, spans for each participant of each conversation of turns (conv_id, turn, role, text)."""
    turns = pick(turns, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id is not null")
    turns = turns.withColumns({"role": F.coalesce("role", F.lit("unknown")), "text": F.coalesce("text", F.lit(""))})
    named, own_name = "user name=", "assistant"
    label = F.when(F.col("role") == system, F.lit(system)).otherwise(F.concat(F.lit(named), "role"))
    begin = F.lit(len(OPEN) + 1) + F.length(label)  # of the text, within its turn
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("at", F.coalesce(F.sum(begin + F.length("text") + len(CLOSE)).over(before), F.lit(0)) + begin)
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "at"))).alias("turns"))
    each = whole.select("conv_id", "turns", F.explode(F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: r != system))).alias("speaker"))
    own = lambda t: t["role"] == F.col("speaker")

    def head(t: Column) -> Column:
        name = F.when(own(t), F.lit(own_name)).when(t["role"] == system, F.lit(system)).otherwise(F.concat(F.lit(named), t["role"]))
        return F.concat(F.lit(OPEN), name, F.lit("\n"))

    def span(t: Column, k: Column) -> Column:
        """Of the k-th own turn: it and the k before it have a shorter or longer head than a named user's."""
        first = (t["at"] + (k + 1) * (F.lit(len(own_name) - len(named)) - F.length("speaker"))).cast("int")
        return F.struct(first.alias("begin"), (first + F.length(t["text"])).alias("end"))

    return each.select(
        "conv_id",
        "speaker",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", own)).cast("long").alias("n_trained"),
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(CLOSE))), "").alias("rendered"),
        F.transform("turns", lambda t: own(t).cast("int")).alias("labels"),
        F.transform(F.filter("turns", own), span).alias("spans"),
    )


def op10_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rotate(read_table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return made.select("conv_id", "speaker", "n_turns", "n_trained", "rendered", F.array_join(F.transform("labels", lambda x: x.cast("string")), "").alias("mask"), spans.alias("trained_spans"))


OP10_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
r AS (SELECT conv_id, speaker, turn, role, text, role = speaker AS own,
 '{OPEN}' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head FROM t JOIN s USING (conv_id)),
p AS (SELECT *, coalesce(sum(length(head) + length(text) + {len(CLOSE)}) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS b FROM r)
SELECT conv_id, speaker, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_trained,
 string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
 string_agg(CASE WHEN own THEN '1' ELSE '0' END, '' ORDER BY turn NULLS FIRST, role, text) AS mask,
 string_agg(CAST(b AS VARCHAR) || '-' || CAST(b + length(text) AS VARCHAR), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE own) AS trained_spans
FROM p GROUP BY conv_id, speaker
"""
