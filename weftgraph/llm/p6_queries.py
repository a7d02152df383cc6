"""Queries of problem 6 (splitting)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.splitting import LIMIT, OVERLAP, broken_chunk_counts, oversized_kinds, split_items
from weftgraph.sources.tables import table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "turns", ("turn_id", "text")).where(F.col("turn_id").isNotNull())
    return rows


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that the splitter cuts, with the natural place that suffices, and files whose chunk numbers do not agree."""
    over = _turns(spark, sf_dir).where(F.length("text") > LIMIT).dropDuplicates(["turn_id"])
    turns = oversized_kinds(split_items(over, "turn_id", "text"), "turn_id").select(F.lit("turn").alias("item_kind"), F.col("turn_id").cast("string").alias("item_key"), F.col("kind").alias("verdict"))
    files = broken_chunk_counts(table(spark, sf_dir, "checkpoints", ("cp_key", "file_path", "chunk_index", "total_chunks"))).where(~F.col("ok"))
    return turns.unionByName(files.select(F.lit("file").alias("item_kind"), F.col("file_path").alias("item_key"), F.lit("chunks").alias("verdict")))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every turn with its place in the conversation."""
    rows = table(spark, sf_dir, "turns").where(F.col("turn_id").isNotNull())
    once = rows.dropDuplicates(["turn_id"])
    cut = split_items(once.select("turn_id", "text"), "turn_id", "text")
    place = rows.select("turn_id", "source_path", "conversation", "turn_no").dropDuplicates(["turn_id"])
    return cut.join(place, "turn_id")


def p6_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each turn add up to, the overlaps left out, and whether each is in the limit and behind the one before."""
    once = _turns(spark, sf_dir).dropDuplicates(["turn_id"])
    sums = split_items(once, "turn_id", "text").groupBy("turn_id").agg(
        (F.sum(F.length("piece")) - OVERLAP * (F.count(F.lit(1)) - 1)).alias("n_chars"), F.max(F.length("piece") > LIMIT).alias("over"), F.max("end").cast("long").alias("ends_at"), F.max("n_pieces").cast("long").alias("n_pieces"), F.count_distinct("end").alias("n_ends")
    )
    return sums.select("turn_id", "n_chars", "over", "ends_at", (F.col("n_pieces") == F.col("n_ends")).alias("all_there"))


_FOUND = r"""
WITH big AS (SELECT turn_id, any_value(text) AS t FROM turns WHERE length(text) > 4000 GROUP BY 1),
m AS (SELECT turn_id,
  list_max(list_transform(string_split_regex(t, '(?:\r?\n[^\S\r\n]*(?:\r\n|\n|\r)|\r[^\S\r\n]+(?:\r\n|\n|\r)|\r\r\n?)(?:[^\S\r\n]*(?:\r\n|\n|\r))*'), lambda x: length(x))) AS p,
  list_max(list_transform(string_split_regex(t, '(?:\r\n|\r|\n)+'), lambda x: length(x))) AS l,
  list_max(list_transform(string_split_regex(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), '\x01|(?:\r\n|\r|\n)+'), lambda x: length(x))) AS s,
  list_max(list_transform(string_split_regex(t, '\s+'), lambda x: length(x))) AS w
  FROM big),
f AS (SELECT DISTINCT cp_key, file_path, chunk_index, total_chunks FROM checkpoints WHERE file_path IS NOT NULL),
g AS (SELECT file_path FROM f GROUP BY 1 HAVING NOT coalesce(
  count(total_chunks) = count(*) AND min(total_chunks) = max(total_chunks) AND count(chunk_index) = count(*)
  AND count(DISTINCT chunk_index) = count(*) AND min(chunk_index) = 1 AND max(chunk_index) = max(total_chunks) AND count(*) = max(total_chunks), false))
SELECT 'turn' AS item_kind, turn_id::VARCHAR AS item_key,
  CASE WHEN p <= 4000 THEN 'paragraph' WHEN l <= 4000 THEN 'line' WHEN s <= 4000 THEN 'sentence' WHEN w <= 4000 THEN 'space' ELSE 'none' END AS verdict FROM m
UNION ALL SELECT 'file', file_path, 'chunks' FROM g
"""

QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces, "p6_covered": p6_covered}
_COVERED = r"""
WITH t AS (SELECT turn_id, any_value(text) AS t FROM turns WHERE turn_id IS NOT NULL AND text IS NOT NULL GROUP BY 1)
SELECT turn_id, length(t) AS n_chars, false AS over, length(t) AS ends_at, true AS all_there FROM t
WHERE regexp_matches(t, '[^\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')"""
ORACLES = {"p6_found": _FOUND, "p6_covered": _COVERED}
