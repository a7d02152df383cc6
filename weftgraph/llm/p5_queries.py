"""Queries of problem 5 (conversations)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.conversations import conversation_faults, ordered_messages, rebuild
from weftgraph.sources.tables import table


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "chat_messages"), table(spark, sf_dir, "exports"), table(spark, sf_dir, "participants")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation that the rebuilding rejects, with the first fault that fits."""
    return conversation_faults(ordered_messages(*_tables(spark, sf_dir))).where(F.col("fault").isNotNull())


def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered turns of the sound conversations."""
    return rebuild(*_tables(spark, sf_dir))


QUERIES = {"p5_found": p5_found, "p5_turns": p5_turns}
ORACLES = {
    "p5_found": r"""
WITH m AS (SELECT DISTINCT row_id, conv_id, message_id, reply_to_id, msg_type, from_name, from_id, text FROM chat_messages WHERE conv_id IS NOT NULL),
t AS (SELECT *, CASE WHEN ltrim(text) LIKE '[%' AND json_valid(text) THEN
    array_to_string(list_transform(CAST(json_extract(text, '$[*]') AS JSON[]), lambda x: coalesce(CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') ELSE json_extract_string(x, '$.text') END, '')), '')
    ELSE text END AS body FROM m),
s AS (SELECT conv_id, coalesce(msg_type = 'message' AND regexp_matches(body, '[^\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\p{C}]'), false) AS speaks,
    coalesce(p.duty, n.duty) AS duty
  FROM t LEFT JOIN participants p ON p.from_id = t.from_id LEFT JOIN participants n ON t.from_id IS NULL AND n.display_name = t.from_name),
v AS (SELECT conv_id, bool_or(speaks) AS said, bool_or(speaks AND coalesce(duty = 'asker', false)) AS asker, bool_or(speaks AND coalesce(duty = 'helper', false)) AS helper FROM s GROUP BY 1),
b AS (SELECT DISTINCT conv_id FROM m r WHERE reply_to_id IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM m q WHERE q.conv_id = r.conv_id AND q.message_id = r.reply_to_id AND r.reply_to_id < r.message_id))
SELECT * FROM (SELECT conv_id, CASE WHEN NOT said THEN 'empty' WHEN conv_id IN (SELECT conv_id FROM b) THEN 'broken' WHEN NOT (asker AND helper) THEN 'unanswered' END AS fault FROM v) WHERE fault IS NOT NULL""",
}
