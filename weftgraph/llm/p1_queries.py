"""Queries of problem 1 (transcripts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm.transcripts import found_dirt, speaker_turns
from weftgraph.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of dirt of every transcript row."""
    return found_dirt(table(spark, sf_dir, "recua_turns", ("row_id", "speaker", "corrected", "start_s", "end_s")))


def p1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean speaker turns of every recording."""
    return speaker_turns(table(spark, sf_dir, "recua_turns"))


QUERIES = {"p1_found": p1_found, "p1_turns": p1_turns}
ORACLES: dict[str, str] = {}
