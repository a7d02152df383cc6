"""Queries of problem 7 (containers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.packing import CAPACITY, pack, token_pieces
from weftgraph.sources.tables import table


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_pieces(table(spark, sf_dir, "documents", ("doc_id", "text")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the packing cuts, with the pieces it places."""
    placed = pack(_pieces(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("min_pieces"))
    return placed.where("min_pieces > 1")


def p7_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece with its container."""
    return pack(_pieces(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers by how full they are, in tenths, and the share of the space left unused."""
    bins = p7_bins(spark, sf_dir).groupBy("bin_id").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    return bins.groupBy(F.floor(F.col("used") * 10 / CAPACITY).cast("int").alias("tenth")).agg(F.count(F.lit(1)).alias("n_bins"), F.sum("items").alias("n_items"), (1 - F.sum("used") / (F.count(F.lit(1)) * CAPACITY)).alias("unused"))


def p7_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the packing made of each document: its tokens, its pieces and whether all its containers keep to the capacity."""
    bins = p7_bins(spark, sf_dir)
    used = bins.groupBy("bin_id").agg(F.sum("tokens").alias("used"))
    placed = bins.join(used, "bin_id").groupBy("doc_id")
    return placed.agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_pieces"), F.max(F.col("used") > CAPACITY).alias("overfull"))


QUERIES = {"p7_found": p7_found, "p7_placed": p7_placed, "p7_bins": p7_bins, "p7_fill": p7_fill}
_TOKENS = r"""
WITH d AS (SELECT doc_id, max(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'))) AS tokens FROM documents GROUP BY 1)
"""
ORACLES = {
    "p7_found": _TOKENS + "SELECT doc_id, ceil(tokens / 1024)::INTEGER AS min_pieces FROM d WHERE tokens > 1024",
    "p7_placed": _TOKENS + "SELECT doc_id, tokens::BIGINT AS tokens, ceil(tokens / 1024)::BIGINT AS n_pieces, false AS overfull FROM d WHERE tokens > 0",
}
