"""Queries on time and trust, over the facts of the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import temporal
from weftgraph.plans.common import FACTS, user_facts
from weftgraph.sources.tables import table

MOMENT = "2024-01-15 00:00:00"


def interval_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = user_facts(spark, sf_dir)
    state = temporal.state_at(F.col("valid_at"), F.col("invalid_at"), F.lit(MOMENT).cast("timestamp"))
    return facts.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def entity_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.entity_intervals(user_facts(spark, sf_dir))
    return out.select("name", F.unix_micros("start").alias("start_us"), F.coalesce(F.unix_micros("end"), F.lit(-1)).alias("end_us"))


def asof_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that held at each midnight of the stream."""
    facts = user_facts(spark, sf_dir)
    days = table(spark, sf_dir, "events", ("ts",)).select(F.to_timestamp(F.to_date("ts")).alias("t")).distinct()
    out = temporal.as_of(facts.select(F.col("valid_at").alias("start"), F.col("invalid_at").alias("end")), days)
    return out.select(F.date_format("t", "yyyy-MM-dd").alias("day"), "active")


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.first_seen(user_facts(spark, sf_dir)).select("name", F.unix_micros("first_seen").alias("first_us"))


def axis_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.axis_coverage(user_facts(spark, sf_dir))
    return out.select("n", "with_start", "with_end", F.unix_micros("low").alias("low_us"), F.unix_micros("high").alias("high_us"))


def trust_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = temporal.observation_trust(F.col("invalid_at"), F.col("grounded"), F.col("source_adapter"))
    return user_facts(spark, sf_dir).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def node_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.node_trust(user_facts(spark, sf_dir))
    return out.withColumn("confidence", F.round("confidence", 6))


def edge_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust of accepted and rejected matches as edges."""
    rows = table(spark, sf_dir, "merge_decisions", ("merge_decision_id", "cosine", "adjudicated", "adjudicator_verdict", "verdict")).distinct()
    faith = F.when(F.col("adjudicator_verdict"), "supported").when(~F.col("adjudicator_verdict"), "unsupported").when(F.col("cosine") < 0.75, "uncertain")
    state = temporal.relation_trust(faith, F.when(F.col("cosine") > 0.9, F.lit(True)), F.col("verdict") == "accept")
    return rows.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def ttl_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached failures (errors) that a cache of six hours would fetch again at the moment."""
    events = table(spark, sf_dir, "events", ("event_id", "ts", "event_type")).where(F.col("ts") <= MOMENT)
    gone = temporal.expired(F.col("ts"), F.lit(MOMENT).cast("timestamp"), 6, F.col("event_type") == "error")
    return events.groupBy("event_type").agg(F.count_if(gone).alias("expired"), F.count(F.lit(1)).alias("n"))


def cost_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and cost per extraction model, with a price list of partial names."""
    rows = table(spark, sf_dir, "checkpoints", ("cp_key", "model_id", "kg_json")).distinct()
    prices = spark.createDataFrame([("extract", 0.001), ("extract-wide", 0.004), ("extract-sm", 0.0005)], "key string, price double")
    out = temporal.cost_ledger(rows.where("model_id IS NOT NULL").select(F.col("model_id").alias("model"), F.length("kg_json").alias("tokens")), prices)
    return out.withColumn("cost", F.round("cost", 6))


def cost_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user made before the user had spent more than 100."""
    events = table(spark, sf_dir, "events", ("event_id", "user_id", "value")).withColumn("value", F.round("value", 2).cast("decimal(12,2)"))
    kept = temporal.within_budget(events, ["user_id"], ["event_id"], "value", 100)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


_TRUST = "CASE WHEN invalid_at IS NOT NULL THEN 'superseded' WHEN grounded = false THEN 'ungrounded' WHEN source_adapter LIKE 'cv-%' OR source_adapter LIKE 'pdf:tesseract%' THEN 'tool-derived' WHEN grounded THEN 'grounded' ELSE 'unknown' END"
QUERIES = {f.__name__: f for f in (interval_state, entity_interval, asof_active, first_seen, axis_coverage, trust_states, node_trust, edge_trust, ttl_expiry, cost_ledger, cost_cap)}
ORACLES = {
    "interval_state": FACTS + f"SELECT CASE WHEN TIMESTAMP '{MOMENT}' < valid_at THEN 'future' WHEN TIMESTAMP '{MOMENT}' >= invalid_at THEN 'superseded' ELSE 'active' END AS state, count(*) AS n FROM obs GROUP BY 1",
    "entity_interval": FACTS + "SELECT name, epoch_us(min(valid_at)) AS start_us, coalesce(CASE WHEN count(*) = count(invalid_at) THEN epoch_us(max(invalid_at)) END, -1) AS end_us FROM obs GROUP BY 1",
    "asof_active": FACTS + ", d AS (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS t FROM events) SELECT strftime(t, '%Y-%m-%d') AS day, (SELECT count(*) FROM obs WHERE valid_at <= t) - (SELECT count(*) FROM obs WHERE invalid_at <= t) AS active FROM d",
    "first_seen": FACTS + "SELECT name, epoch_us(min(valid_at)) AS first_us FROM obs GROUP BY 1",
    "axis_coverage": FACTS + "SELECT count(*) AS n, count(valid_at) AS with_start, count(invalid_at) AS with_end, epoch_us(min(valid_at)) AS low_us, epoch_us(max(coalesce(invalid_at, valid_at))) AS high_us FROM obs",
    "trust_states": FACTS + f"SELECT {_TRUST} AS state, count(*) AS n FROM obs GROUP BY 1",
    "node_trust": FACTS + f", t AS (SELECT *, {_TRUST} AS state FROM obs), s AS (SELECT *, CASE state WHEN 'ungrounded' THEN 6 WHEN 'superseded' THEN 4 WHEN 'tool-derived' THEN 3 WHEN 'grounded' THEN 2 ELSE 1 END AS v FROM t) SELECT name, arg_max(state, row(v, -ord)) AS state, round(avg(coalesce(confidence, grounding_score)), 6) AS confidence FROM s GROUP BY 1",
    "edge_trust": "SELECT CASE WHEN adjudicator_verdict THEN 'grounded' WHEN adjudicator_verdict = false THEN 'ungrounded' WHEN cosine < 0.75 THEN 'uncertain' WHEN cosine > 0.9 THEN 'grounded' WHEN verdict <> 'accept' THEN 'uncertain' ELSE 'unknown' END AS state, count(*) AS n FROM (SELECT DISTINCT merge_decision_id, cosine, adjudicated, adjudicator_verdict, verdict FROM merge_decisions) GROUP BY 1",
    "ttl_expiry": f"SELECT event_type, count(*) FILTER (event_type = 'error' AND floor(epoch(TIMESTAMP '{MOMENT}')) - floor(epoch(ts)) > 21600) AS expired, count(*) AS n FROM events WHERE ts <= TIMESTAMP '{MOMENT}' GROUP BY 1",
    "cost_ledger": "SELECT model_id AS model, count(*) AS calls, sum(length(kg_json))::BIGINT AS tokens, round(sum(length(kg_json)) * CASE WHEN contains(model_id, 'extract-wide') THEN 0.004 WHEN contains(model_id, 'extract-sm') THEN 0.0005 WHEN contains(model_id, 'extract') THEN 0.001 ELSE 0.0 END, 6)::DOUBLE AS cost FROM (SELECT DISTINCT cp_key, model_id, kg_json FROM checkpoints) WHERE model_id IS NOT NULL GROUP BY 1",
    "cost_cap": "SELECT user_id, count(*) AS n FROM (SELECT user_id, coalesce(sum(round(value, 2)::DECIMAL(12, 2)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM events) WHERE s <= 100 GROUP BY 1",
}
