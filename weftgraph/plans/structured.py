"""Queries on the graph of the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import graph
from weftgraph.plans.common import STRUCT, struct_graph
from weftgraph.sources.relational import Table, entities
from weftgraph.sources.tables import table


def struct_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return struct_graph(spark, sf_dir)[0]


def struct_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return struct_graph(spark, sf_dir)[1]


def struct_fk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return struct_graph(spark, sf_dir)[2].select("src", "dst", F.array_join("relation_type", ",").alias("relation_type"))


def struct_graph_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    ents, _, rels = struct_graph(spark, sf_dir)
    return graph.health(ents, rels)


def struct_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ents, _, rels = struct_graph(spark, sf_dir)
    return graph.degrees(ents, rels)


def struct_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.type_counts(struct_graph(spark, sf_dir)[0])


def struct_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members per connected component of the customer and supplier graph without orders."""
    ents, _, rels = struct_graph(spark, sf_dir)
    kept, edges = graph.hide_types(ents, rels, ["orders"])
    return graph.connected_components(edges, kept).groupBy("component").agg(F.count(F.lit(1)).alias("members"))


def struct_keyless_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table without a key, named by a hash of their cells: how many rows and names there are."""
    rows = table(spark, sf_dir, "lineitem")
    return entities([Table("lineitem", rows)]).agg(F.count(F.lit(1)).alias("n_names"))


_STATE = STRUCT + """, ends AS (SELECT src AS name FROM rels UNION ALL SELECT dst FROM rels)
"""
QUERIES = {f.__name__: f for f in (struct_entities, struct_observations, struct_fk_edges, struct_graph_health, struct_degree, struct_type_counts, struct_components, struct_keyless_rows)}
ORACLES = {
    "struct_entities": STRUCT + "SELECT * FROM ents",
    "struct_observations": STRUCT + "SELECT * FROM obs",
    "struct_fk_edges": STRUCT + "SELECT src, dst, array_to_string(relation_type, ',') AS relation_type FROM rels",
    "struct_graph_health": STRUCT + """SELECT (SELECT count(*) FROM ents) AS entity_count, (SELECT count(DISTINCT entity_type) FROM ents) AS entity_type_count, count(*) AS relation_count,
  count(DISTINCT relation_type[1]) AS relation_type_count, sum((src = dst)::INT)::BIGINT AS self_loop_count, 0::BIGINT AS bidirectional_pair_count,
  0::BIGINT AS dangling_endpoint_count, 1.0::DOUBLE AS referential_integrity, (count(*) - count(DISTINCT (src, dst, relation_type)))::BIGINT AS parallel_edge_count FROM rels""",
    "struct_degree": _STATE + "SELECT e.name, count(x.name) AS degree, true AS known FROM ents e LEFT JOIN ends x USING (name) GROUP BY 1",
    "struct_type_counts": STRUCT + "SELECT entity_type, count(*) AS n FROM ents GROUP BY 1",
    "struct_components": STRUCT + """, down AS (SELECT 'region#' || r_regionkey AS name, 'region#' || r_regionkey AS root FROM region
  UNION ALL SELECT 'nation#' || n_nationkey, 'region#' || n_regionkey FROM nation
  UNION ALL SELECT 'customer#' || c_custkey, 'region#' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier#' || s_suppkey, 'region#' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part#' || p_partkey, 'part#' || p_partkey FROM part)
SELECT min(name) AS component, count(*) AS members FROM down GROUP BY root""",
    "struct_keyless_rows": "SELECT count(*) AS n_names FROM (SELECT DISTINCT * FROM lineitem)",
}
