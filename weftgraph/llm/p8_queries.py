"""Queries of problem 8 (mixing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.mixing import actual_shares, emitted, mixed, sized_documents, source_rates
from weftgraph.sources.tables import table


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = sized_documents(table(spark, sf_dir, "documents", ("doc_id", "source", "text")))
    return sized, source_rates(sized, table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted sources that have no tokens or would need more repeats than allowed."""
    return _parts(spark, sf_dir)[1].where("short").select("source")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and capped repetition rate of every target source."""
    return _parts(spark, sf_dir)[1].select("source", "tokens", F.round("rate", 6).alias("rate"), "short")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix, one row per emitted copy."""
    return emitted(mixed(*_parts(spark, sf_dir)))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the mix."""
    sized, rates = _parts(spark, sf_dir)
    return actual_shares(mixed(sized, rates), rates)


def p8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source of the mix how many of its documents are emitted at least floor(rate) times, and whether none more than once more."""
    sized, rates = _parts(spark, sf_dir)
    whole = rates.where("rate >= 1").select(F.lower(F.trim("source")).alias("source"), F.floor("rate").alias("least"))
    mix = mixed(sized.where("tokens > 0"), rates).join(whole, "source")
    return mix.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.min(F.col("copies").between(F.col("least"), F.col("least") + 1)).alias("as_asked"))


_RATES = r"""
WITH d AS (
  SELECT doc_id, nullif(lower(trim(any_value(source), ' ')), '') AS source,
         len(regexp_extract_all(coalesce(any_value(text), ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')) AS tokens
  FROM documents GROUP BY doc_id),
s AS (SELECT source, sum(tokens) AS tokens FROM d GROUP BY 1),
r AS (
  SELECT m.source, coalesce(s.tokens, 0)::BIGINT AS tokens, m.target_weight, m.max_repeats,
         m.target_weight / (SELECT sum(target_weight) FROM mix_targets) * (SELECT sum(tokens) FROM d) AS wanted
  FROM mix_targets m LEFT JOIN s ON s.source = lower(trim(m.source, ' ')))
"""
_SHORT = "target_weight > 0 AND (tokens = 0 OR coalesce(wanted > max_repeats * tokens, false))"

QUERIES = {"p8_found": p8_found, "p8_rates": p8_rates, "p8_mix": p8_mix, "p8_copies": p8_copies, "p8_shares": p8_shares}
ORACLES = {
    "p8_found": _RATES + f"SELECT source FROM r WHERE {_SHORT}",
    "p8_rates": _RATES + f"SELECT source, tokens, round(CASE WHEN tokens > 0 THEN least(wanted / tokens, coalesce(max_repeats::DOUBLE, wanted / tokens)) ELSE 0.0 END, 6) AS rate, ({_SHORT}) AS short FROM r",
    "p8_copies": _RATES
    + """SELECT r.source, count(*) AS n_documents, true AS as_asked FROM r JOIN d ON d.source = lower(trim(r.source, ' '))
WHERE r.tokens > 0 AND d.tokens > 0 AND least(wanted / r.tokens, coalesce(max_repeats::DOUBLE, wanted / r.tokens)) >= 1 GROUP BY 1""",
}
