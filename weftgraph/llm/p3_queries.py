"""Queries of problem 3 (groups of matched names)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.groups import canonical_groups
from weftgraph.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each linked name of a run with the smallest name of its group."""
    rows = table(spark, sf_dir, "merge_decisions", ("run_id", "merge_target", "verdict", "canonical", "surface_forms"))
    accepted = rows.where((F.col("merge_target") == "entity") & (F.col("verdict") == "accept"))
    forms = F.coalesce(F.col("surface_forms"), F.array().cast("array<string>"))
    linked = accepted.select("run_id", F.concat(F.array("canonical"), forms).alias("names"))
    return canonical_groups(linked, "run_id", "names").withColumnRenamed("name", "entity_name")


def p3_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by size of group: how many groups of each size a run has."""
    sizes = p3_found(spark, sf_dir).groupBy("run_id", "group_name").agg(F.count(F.lit(1)).alias("names"))
    return sizes.groupBy("run_id", "names").agg(F.count(F.lit(1)).alias("n_groups"))


_GROUPS = """
WITH RECURSIVE acc AS (
  SELECT run_id, list_distinct(list_filter(list_prepend(canonical, coalesce(surface_forms, [])), lambda x: x IS NOT NULL)) AS n
  FROM merge_decisions WHERE merge_target = 'entity' AND verdict = 'accept' AND run_id IS NOT NULL),
hub AS (SELECT run_id, n[1] AS a, unnest(n) AS b FROM acc WHERE len(n) > 1),
edge AS (SELECT DISTINCT run_id, a, b FROM hub WHERE a <> b UNION SELECT DISTINCT run_id, b, a FROM hub WHERE a <> b),
walk(run_id, entity_name, reached) AS (
  SELECT DISTINCT run_id, a, a FROM edge
  UNION SELECT w.run_id, w.entity_name, e.b FROM walk w JOIN edge e ON e.run_id = w.run_id AND e.a = w.reached),
found AS (SELECT run_id, entity_name, min(reached) AS group_name FROM walk GROUP BY 1, 2)
"""

QUERIES = {"p3_found": p3_found, "p3_group_sizes": p3_group_sizes}
ORACLES = {
    "p3_found": _GROUPS + "SELECT run_id, entity_name, group_name FROM found",
    "p3_group_sizes": _GROUPS + "SELECT run_id, names, count(*) AS n_groups FROM (SELECT run_id, group_name, count(*) AS names FROM found GROUP BY 1, 2) GROUP BY 1, 2",
}
