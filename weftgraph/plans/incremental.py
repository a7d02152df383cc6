"""Queries of resume, lineage and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import incremental
from weftgraph.sources.tables import table


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks still to do: expected of every file by its largest total, minus the finished ones."""
    rows = table(spark, sf_dir, "checkpoints", ("file_path", "chunk_index", "total_chunks")).where("file_path IS NOT NULL AND total_chunks > 0")
    files = rows.groupBy("file_path").agg(F.max("total_chunks").alias("n"))
    expected = files.select("file_path", F.explode(F.sequence(F.lit(1), "n")).alias("chunk_index")).withColumn("key", F.concat_ws("#", "file_path", "chunk_index"))
    done = rows.select(F.concat_ws("#", "file_path", "chunk_index").alias("key"))
    return incremental.not_done(expected, done, "key").select("file_path", "chunk_index")


def latest_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record written of every file."""
    rows = table(spark, sf_dir, "checkpoints", ("file_path", "cp_key", "written_at")).where("file_path IS NOT NULL AND written_at IS NOT NULL").distinct()
    return incremental.latest(rows, "file_path", ["written_at", "cp_key"]).select("file_path", "cp_key")


def file_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "checkpoints", ("file_path", "chunk_index", "total_chunks")).where("file_path IS NOT NULL")
    out = incremental.reciprocal_progress(rows, "file_path", "chunk_index", "total_chunks")
    return out.select("file_path", "done", F.coalesce("total", F.lit(0)).alias("total"), F.round("share", 6).alias("share"))


def entity_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions, runs and surface forms of canonical names."""
    rows = table(spark, sf_dir, "merge_decisions", ("merge_decision_id", "run_id", "canonical", "surface_forms")).where("canonical IS NOT NULL AND run_id IS NOT NULL").distinct()
    events = rows.select(F.col("canonical").alias("name"), F.col("run_id").alias("chunk"), F.explode("surface_forms").alias("form"))
    return incremental.entity_trace(events).select("name", "mentions", "chunks", F.array_join("forms", "|").alias("forms"))


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.stage_counts(table(spark, sf_dir, "merge_decisions", ("merge_decision_id", "match_method")).distinct(), "match_method")


def cumulative_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events before and after the month's middle as two runs of a ledger."""
    events = table(spark, sf_dir, "events", ("ts", "event_type", "value"))
    part = lambda c: events.where(c).groupBy(F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.floor("value")).alias("tokens"), F.sum(F.round("value", 2).cast("decimal(12,2)")).cast("decimal(18,2)").alias("cost"))
    middle = "2024-01-15 00:00:00"
    out = incremental.merged_ledger(part(F.col("ts") < middle), part(F.col("ts") >= middle))
    return out.select("model", "calls", "tokens", F.col("cost").cast("double").alias("cost"))


def entity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the entity-disjoint sides."""
    names = table(spark, sf_dir, "merge_decisions", ("canonical",)).where("canonical IS NOT NULL").distinct()
    return incremental.entity_split(names, "canonical").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (resume_antijoin, latest_checkpoints, file_progress, entity_trace, stage_counts, cumulative_ledger, entity_split)}
ORACLES = {
    "resume_antijoin": "WITH r AS (SELECT file_path, chunk_index, total_chunks FROM checkpoints WHERE file_path IS NOT NULL AND total_chunks > 0), f AS (SELECT file_path, max(total_chunks) AS n FROM r GROUP BY 1), e AS (SELECT file_path, unnest(range(1, n + 1))::INTEGER AS chunk_index FROM f) SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.file_path = e.file_path AND r.chunk_index = e.chunk_index)",
    "latest_checkpoints": "SELECT file_path, arg_max(cp_key, row(written_at, cp_key)) AS cp_key FROM checkpoints WHERE file_path IS NOT NULL AND written_at IS NOT NULL GROUP BY 1",
    "file_progress": "SELECT file_path, count(DISTINCT chunk_index) AS done, coalesce(max(total_chunks), 0) AS total, round(CASE WHEN max(total_chunks) <> 0 THEN count(DISTINCT chunk_index) / max(total_chunks) ELSE 0.0 END, 6) AS share FROM checkpoints WHERE file_path IS NOT NULL GROUP BY 1",
    "entity_trace": "SELECT name, count(*) AS mentions, count(DISTINCT run_id) AS chunks, array_to_string(list_sort(list(DISTINCT form)), '|') AS forms FROM (SELECT canonical AS name, run_id, unnest(surface_forms) AS form FROM (SELECT DISTINCT merge_decision_id, run_id, canonical, surface_forms FROM merge_decisions WHERE canonical IS NOT NULL AND run_id IS NOT NULL)) GROUP BY 1",
    "stage_counts": "SELECT match_method, count(*) AS n FROM (SELECT DISTINCT merge_decision_id, match_method FROM merge_decisions) GROUP BY 1",
    "cumulative_ledger": "SELECT event_type AS model, count(*) AS calls, sum(floor(value))::BIGINT AS tokens, sum(round(value, 2)::DECIMAL(12, 2))::DOUBLE AS cost FROM events GROUP BY 1",
}
