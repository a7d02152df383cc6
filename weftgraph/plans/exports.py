"""Queries of the export formats, on the graph of the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.export import graph_formats as formats
from weftgraph.sources.graphs import graph_of_lines
from weftgraph.plans.common import FACTS, STRUCT, struct_graph, user_facts

NOW = "2025-01-01T00:00:00Z"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names are ordered by hash, relations likewise: any fixed order will do for the formats."""
    ents, obs, rels = struct_graph(spark, sf_dir)
    return ents.withColumn("ord", F.col("name")), obs, rels.withColumn("ord", F.xxhash64("src", "dst"))


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, obs, rels = _graph(spark, sf_dir)
    return formats.kb_triples(obs, rels)


def kb_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triples(spark, sf_dir)


def kblam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.kblam(_triples(spark, sf_dir))


def lora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training chats of user facts whose grounding score is missing or at least 0.5."""
    facts = user_facts(spark, sf_dir).select("name", "ord", "text", "grounding_score")
    nothing = spark.createDataFrame([], "src string, dst string, relation_type array<string>, ord long")
    return formats.lora(formats.kb_triples(facts, nothing, 0.5))


def jsonl_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.jsonl(*_graph(spark, sf_dir)[:2], _graph(spark, sf_dir)[2].withColumn("ord", F.col("src"))).select("kind", "line")


def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph as the lines of one JSON document."""
    return formats.json_document(*_graph(spark, sf_dir)[:2], _graph(spark, sf_dir)[2].withColumn("ord", F.col("src"))).select("part", "line")


def graph_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's line file read back: entities, observations and edges by type."""
    lines = formats.jsonl(*_graph(spark, sf_dir)[:2], _graph(spark, sf_dir)[2].withColumn("ord", F.col("src"))).select("line")
    back = graph_of_lines(lines)
    counted = lambda df, what, c: df.groupBy(F.lit(what).alias("what"), c.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    ents = counted(back.entities, "entity", F.col("entity_type"))
    obs = counted(back.observations, "observation", F.regexp_extract("text", "^([^:]*):", 1))
    return ents.unionByName(obs).unionByName(counted(back.relations, "relation", F.array_join("relation_type", ",")))


def mcp_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.mcp_relations(_graph(spark, sf_dir)[2]).select("line")


def mcp_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that come back from their lines, by predicate."""
    back = formats.from_mcp(formats.mcp_relations(_graph(spark, sf_dir)[2]))
    return back.groupBy(F.array_join("relation_type", ",").alias("relation_type")).agg(F.count(F.lit(1)).alias("n"))


def graphiti_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.graphiti_nodes(*_graph(spark, sf_dir), NOW)


def graphiti_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.graphiti_edges(_graph(spark, sf_dir)[2])


def dot_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    ents, _, rels = _graph(spark, sf_dir)
    return formats.dot_lines(ents, rels.withColumn("ord", F.col("src")), "entity_type").where("part <> 2").select("part", "line")


def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per nation, region, supplier and part, with its facts and relations."""
    ents, obs, rels = _graph(spark, sf_dir)
    return formats.markdown_pages(ents.where("entity_type <> 'orders'"), obs, rels.withColumn("ord", F.col("src")))


_KB = STRUCT + """, t AS (SELECT name, 'description' AS property, string_agg(text, '; ' ORDER BY ord) AS value FROM obs GROUP BY 1
  UNION ALL SELECT src, relation_type[1], dst FROM rels)
"""
_UUID = "substr(sha1({0}), 1, 8) || '-' || substr(sha1({0}), 9, 4) || '-' || substr(sha1({0}), 13, 4) || '-' || substr(sha1({0}), 17, 4) || '-' || substr(sha1({0}), 21, 12)"
_u = lambda x: "(" + _UUID.format(x) + ")"
_Q, _A = "'What is the ' || property || ' of ' || name || '?'", "'The ' || property || ' of ' || name || ' is ' || value || '.'"
QUERIES = {f.__name__: f for f in (kb_triples, kblam, lora, jsonl_export, json_document, graph_loader, mcp_jsonl, mcp_round_trip, graphiti_nodes, graphiti_edges, dot_export, markdown_pages)}
ORACLES = {
    "kb_triples": _KB + "SELECT * FROM t",
    "kblam": _KB + f"SELECT name, property AS description_type, value AS description, {_Q} AS Q, {_A} AS A, 'The ' || property || ' of ' || name AS key_string FROM t",
    "lora": FACTS + f""", f AS (SELECT name, text, min(ord) AS o FROM obs WHERE grounding_score IS NULL OR grounding_score >= 0.5 GROUP BY 1, 2), t AS (SELECT name, 'description' AS property, string_agg(text, '; ' ORDER BY o) AS value FROM f GROUP BY 1)
SELECT name, property, '{{"messages":[{{"role":"user","content":"' || {_Q} || '"}},{{"role":"assistant","content":"' || {_A} || '"}}]}}' AS line FROM t""",
    "jsonl_export": STRUCT + """, o AS (SELECT name, string_agg('"' || text || '"', ',' ORDER BY ord) AS l FROM obs GROUP BY 1)
SELECT 0 AS kind, '{"type":"entity","name":"' || name || '","entityType":"' || entity_type || '","observations":[' || coalesce(l, '') || ']}' AS line FROM ents LEFT JOIN o USING (name)
UNION ALL SELECT 1, '{"type":"relation","from":"' || src || '","to":"' || dst || '","relationType":["' || relation_type[1] || '"]}' FROM rels""",
    "mcp_jsonl": STRUCT + """SELECT '{"type":"relation","from":"' || src || '","to":"' || dst || '","relationType":"' || relation_type[1] || '"}' AS line FROM rels""",
    "graph_loader": STRUCT + "SELECT 'entity' AS what, entity_type AS kind, count(*) AS n FROM ents GROUP BY 2 UNION ALL SELECT 'observation', split_part(text, ':', 1), count(*) FROM obs GROUP BY 2 UNION ALL SELECT 'relation', relation_type[1], count(*) FROM rels GROUP BY 2",
    "json_document": STRUCT + """, o AS (SELECT name, string_agg('"' || text || '"', ',' ORDER BY ord) AS l FROM obs GROUP BY 1),
e AS (SELECT name AS ord, '{"name":"' || name || '","entityType":"' || entity_type || '","observations":[' || coalesce(l, '') || ']}' AS line FROM ents LEFT JOIN o USING (name)),
r AS (SELECT src AS ord, '{"from":"' || src || '","to":"' || dst || '","relationType":["' || relation_type[1] || '"]}' AS line FROM rels)
SELECT 0 AS part, '{"entities":[' AS line UNION ALL SELECT 2, '],"relations":[' UNION ALL SELECT 4, ']}'
UNION ALL SELECT 1, line || CASE WHEN row_number() OVER (ORDER BY ord DESC, line DESC) = 1 THEN '' ELSE ',' END FROM e
UNION ALL SELECT 3, line || CASE WHEN row_number() OVER (ORDER BY ord DESC, line DESC) = 1 THEN '' ELSE ',' END FROM r""",
    "mcp_round_trip": STRUCT + "SELECT relation_type[1] AS relation_type, count(*) AS n FROM rels GROUP BY 1",
    "graphiti_nodes": STRUCT + f", o AS (SELECT name, string_agg(text, ' ' ORDER BY ord) AS s FROM obs GROUP BY 1) SELECT {_u('name')} AS uuid, name, coalesce(s, '') AS summary, entity_type AS label, '{NOW}' AS created_at FROM ents LEFT JOIN o USING (name)",
    "graphiti_edges": STRUCT + ", e AS (SELECT src, dst, relation_type[1] AS t FROM rels) SELECT " + _u("src || '|' || t || '|' || dst") + " AS uuid, upper(t) AS name, src || ' ' || t || ' ' || dst AS fact, " + _u("src") + " AS source_node_uuid, " + _u("dst") + " AS target_node_uuid FROM e",
    "dot_export": STRUCT + """SELECT 1 AS part, '  "' || name || '" [label="' || name || '\\n' || entity_type || '"];' AS line FROM ents UNION ALL SELECT 3, '  "' || src || '" -> "' || dst || '" [label="' || relation_type[1] || '"];' FROM rels""",
    "markdown_pages": STRUCT + """, e AS (SELECT name, entity_type FROM ents WHERE entity_type <> 'orders'), o AS (SELECT name, string_agg('- ' || text, chr(10) ORDER BY ord) AS l FROM obs GROUP BY 1),
x AS (SELECT src AS name, 0 AS way, src AS o, '- **' || relation_type[1] || '** → ' || dst AS l FROM rels UNION ALL SELECT dst, 1, src, '- ' || src || ' **' || relation_type[1] || '** →' FROM rels), y AS (SELECT name, string_agg(l, chr(10) ORDER BY way, o, l) AS l FROM x GROUP BY 1)
SELECT replace(name, '#', '-') || '.md' AS path, '# ' || name || chr(10) || chr(10) || '- **Type:** ' || entity_type || coalesce(chr(10) || chr(10) || '## Facts' || chr(10) || chr(10) || o.l, '') || coalesce(chr(10) || chr(10) || '## Relations' || chr(10) || chr(10) || y.l, '') || chr(10) AS content FROM e LEFT JOIN o USING (name) LEFT JOIN y USING (name)""",
}
