"""Queries of graph quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import graph, quality
from weftgraph.plans.common import FACTS, STRUCT, struct_graph, user_facts
from weftgraph.plans.resolve import _M, chunk_mentions
from weftgraph.sources.tables import table


def semantic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.semantic_scores(*struct_graph(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def entity_name_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part", ("p_partkey", "p_name"))
    return rows.select("p_partkey", quality.name_score(F.col("p_name")).alias("score"))


def observation_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return struct_graph(spark, sf_dir)[1].groupBy(quality.specific(F.col("text")).alias("specific")).agg(F.count(F.lit(1)).alias("n"))


def domain_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many identifiers of the documents occur in the names of parts."""
    names = table(spark, sf_dir, "part", ("p_name",)).select(F.col("p_name").alias("name")).distinct()
    return quality.domain_coverage(names, table(spark, sf_dir, "documents", ("text",)), "text").withColumn("coverage", F.round("coverage", 6))


def claim_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of chunks against the paths of their files."""
    m = chunk_mentions(spark, sf_dir).select("name", F.concat_ws(" ", "name", "entity_type").alias("text"), F.concat_ws(" ", "file", "entity_type").alias("source"))
    out = quality.grounding_scores(m)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def factual_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("text") == "view", "a public page").when(F.col("text") == "signup", "a private page").otherwise(F.col("text"))
    return quality.factual_consistency(user_facts(spark, sf_dir).withColumn("text", said)).select(F.col("pairs").cast("long").alias("pairs"), F.col("conflicts").cast("long").alias("conflicts"), F.round("consistency", 6).alias("consistency"))


def naming_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.naming_consistency(chunk_mentions(spark, sf_dir)).select(F.round("naming_consistency", 6).alias("naming_consistency"))


def type_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.type_consistency(chunk_mentions(spark, sf_dir)).select(F.round("type_consistency", 6).alias("type_consistency"))


def cross_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = chunk_mentions(spark, sf_dir)
    return quality.cross_consistency(m.where("ord % 2 = 0"), m.where("ord % 2 = 1")).select(F.round("cross_consistency", 6).alias("cross_consistency"))


def composite_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite of the graph of the relational tables."""
    ents, obs, rels = struct_graph(spark, sf_dir)
    structure, semantic = graph.structure(ents, rels), quality.semantic_scores(ents, obs, rels)
    claims = obs.join(ents, "name").select("name", "text", F.concat_ws(" ", "entity_type", "locator", "name").alias("source"))
    ground, fact = quality.grounding_scores(claims), quality.factual_consistency(obs)
    row = structure.withColumns({c: semantic.select(c).scalar() for c in semantic.columns} | {c: ground.select(c).scalar() for c in ground.columns})
    row = row.withColumns({"consistency": fact.select("consistency").scalar(), "naming_consistency": quality.naming_consistency(ents).scalar(), "type_consistency": quality.type_consistency(ents).scalar(), "cross_consistency": F.lit(1.0), "coverage": F.lit(1.0), "observations_per_entity": obs.agg(F.count(F.lit(1)).cast("double")).scalar() / F.col("entity_count")})
    return quality.composite(row).select(F.round("overall", 4).alias("overall"), F.round("structural", 4).alias("structural"), F.round("semantic", 4).alias("semantic"), F.round("factual", 4).alias("factual"), F.round("consistent", 4).alias("consistent"), "advice")


_NAME = "least(CASE WHEN regexp_matches({0}, '^[a-z][a-z0-9_]*[a-z0-9]$') THEN 0.3 ELSE 0.0 END + CASE WHEN length({0}) > 3 AND {0} NOT IN ('data', 'item', 'value', 'object') THEN 0.4 ELSE 0.0 END + CASE WHEN contains({0}, '_') OR regexp_matches({0}, '[A-Z]') THEN 0.3 ELSE 0.0 END, 1.0)"
_SPECIFIC = "lower(text) NOT IN (" + ", ".join(f"'{t}'" for t in quality.TRIVIAL) + ") AND (length(text) > 10 OR regexp_matches(text, '[0-9]') OR contains(text, 'implements') OR contains(text, 'uses') OR contains(text, 'version') OR contains(text, 'located'))"
_PATTERN = "CASE WHEN regexp_matches(name, '^[a-z][a-z0-9_]*$') THEN 's' WHEN regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') THEN 'c' WHEN regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') THEN 'p' ELSE 'o' END"
QUERIES = {f.__name__: f for f in (semantic_scores, entity_name_quality, observation_specificity, domain_coverage, claim_grounding, factual_consistency, naming_consistency, type_consistency, cross_consistency, composite_quality)}
ORACLES = {
    "semantic_scores": STRUCT + f"SELECT round((SELECT avg({_NAME.format('name')}) FROM ents), 6) AS name_quality, round((SELECT avg((contains(entity_type, '_') OR length(entity_type) > 6)::INT) FROM ents), 6) AS type_appropriateness, round((SELECT avg(({_SPECIFIC})::INT) FROM obs), 6) AS specificity, 0.0::DOUBLE AS relation_validity",
    "entity_name_quality": f"SELECT p_partkey, ({_NAME.format('p_name')})::DOUBLE AS score FROM part",
    "observation_specificity": STRUCT + f"SELECT ({_SPECIFIC}) AS specific, count(*) AS n FROM obs GROUP BY 1",
    "domain_coverage": "WITH t AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*')) AS w FROM documents) WHERE length(w) > 3), n AS (SELECT DISTINCT lower(p_name) AS name FROM part), c AS (SELECT w, EXISTS (SELECT 1 FROM n WHERE contains(n.name, lower(w))) AS hit FROM t) SELECT count(*) AS terms, count(*) FILTER (hit) AS covered, round(avg(hit::INT), 6) AS coverage FROM c",
    "claim_grounding": _M + ", c AS (SELECT name, concat_ws(' ', name, entity_type) AS text, lower(concat_ws(' ', file, entity_type)) AS source FROM m), s AS (SELECT contains(source, lower(name)) AS has, (SELECT CASE WHEN count(*) = 0 THEN 1.0 ELSE avg(contains(source, w)::INT) END FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS w) WHERE length(w) > 3) AS k FROM c) SELECT round(avg((NOT (has AND k >= 0.5))::INT), 6) AS hallucination, round(avg(has::INT), 6) AS grounding FROM s",
    "factual_consistency": FACTS + ", n AS (SELECT name, count(*) AS a, count(*) FILTER (text = 'view') AS v, count(*) FILTER (text = 'signup') AS s FROM obs GROUP BY 1) SELECT sum(a * (a - 1) / 2)::BIGINT AS pairs, sum(v * s)::BIGINT AS conflicts, round(1 - sum(v * s) / sum(a * (a - 1) / 2), 6) AS consistency FROM n",
    "naming_consistency": _M + f", p AS (SELECT {_PATTERN} AS k, count(*) AS n FROM m GROUP BY 1) SELECT round(max(n) / sum(n), 6) AS naming_consistency FROM p",
    "type_consistency": _M + ", p AS (SELECT lower(string_split_regex(name, '[_-]')[1]) AS k, count(*) AS n, count(DISTINCT entity_type) AS t FROM m GROUP BY 1) SELECT round(avg((t = 1)::INT), 6) AS type_consistency FROM p WHERE n > 1",
    "cross_consistency": _M + ", k AS (SELECT name, list(DISTINCT entity_type) AS t FROM m WHERE ord % 2 = 1 GROUP BY 1) SELECT round(coalesce(avg(list_contains(t, entity_type)::INT), 1.0), 6) AS cross_consistency FROM m JOIN k USING (name) WHERE ord % 2 = 0",
}
