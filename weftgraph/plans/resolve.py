"""Queries of entity resolution, on the names of merge decisions and the entities of checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import graph, hierarchy, resolve
from weftgraph.sources.tables import table


def chunk_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of the entities extracted from each finished chunk: (name, entity_type, file, ord)."""
    rows = table(spark, sf_dir, "checkpoints", ("cp_key", "file_path", "kg_json")).distinct()
    parsed = F.from_json("kg_json", "entities array<struct<name:string, entityType:string>>")
    exploded = rows.select("cp_key", F.coalesce("file_path", F.lit("unknown")).alias("file"), F.posexplode(parsed["entities"]).alias("pos", "e"))
    return exploded.select(F.col("e.name").alias("name"), F.col("e.entityType").alias("entity_type"), "file", F.conv(F.substring("cp_key", 1, 12), 16, 10).cast("long").alias("h"), "pos").select("name", "entity_type", "file", (F.col("h") * 100 + F.col("pos")).alias("ord"))


def exact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve.exact_merge(chunk_mentions(spark, sf_dir))
    return out.select("norm", "name", "entity_type", "n_mentions", F.array_join("files", "|").alias("files"))


def elected_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.elected_types(chunk_mentions(spark, sf_dir), "name")


def rename_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge decisions as edges whose ends take their canonical spelling, counted once per run."""
    rows = table(spark, sf_dir, "merge_decisions", ("run_id", "canonical", "surface_forms", "seq")).where("canonical IS NOT NULL")
    names = rows.select(F.col("canonical").alias("name"), F.lit("concept").alias("entity_type"), F.col("run_id").alias("file"), F.xxhash64("canonical").alias("ord"))
    merged = resolve.exact_merge(names.distinct())
    edges = rows.select(F.col("canonical").alias("src"), F.explode("surface_forms").alias("dst")).withColumn("relation_type", F.array(F.lit("same_as")))
    renamed = resolve.rename_ends(edges, resolve.rename_map(names, merged))
    return graph.dedup_relations(renamed, []).agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src").alias("n_src"))


def fuzzy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of chunks folded by similarity."""
    return resolve.fuzzy_merge(chunk_mentions(spark, sf_dir)).where("surface <> canonical").select("surface", "canonical", F.round("sim", 6).alias("sim"))


def folded_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types seen per user, once each, with the first event."""
    obs = table(spark, sf_dir, "events", ("event_id", "user_id", "event_type")).select(F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("text"), F.col("event_id").alias("ord"))
    return resolve.fold_observations(obs)


def merge_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the policy says of each decided pair, against the recorded verdict."""
    rows = table(spark, sf_dir, "merge_decisions", ("merge_decision_id", "canonical", "surface_forms", "cosine", "verdict")).distinct()
    pairs = rows.where("canonical IS NOT NULL").select("canonical", F.explode("surface_forms").alias("form"), "cosine", "verdict")
    policy = resolve.merge_policy(F.col("cosine"), F.col("canonical"), F.col("form"))
    return pairs.groupBy(policy.alias("policy"), "verdict").agg(F.count(F.lit(1)).alias("n"))


def inspect_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty least certain accepted merges of entities with several surface forms, suspects marked."""
    rows = table(spark, sf_dir, "merge_decisions", ("merge_decision_id", "merge_target", "verdict", "canonical", "surface_forms", "cosine")).distinct()
    kept = rows.where((F.col("verdict") == "accept") & (F.col("merge_target") == "entity") & F.col("cosine").isNotNull())
    size = F.size("surface_forms") + F.when(F.col("canonical").isNotNull(), 1).otherwise(0)
    return kept.withColumn("members", size).where("members > 1").orderBy("cosine", F.col("members").desc(), "merge_decision_id").limit(20).select("merge_decision_id", "cosine", "members", (F.col("cosine") < 0.8).alias("suspect"))


def chain_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the chains of surface form to canonical name end in every run."""
    rows = table(spark, sf_dir, "merge_decisions", ("run_id", "canonical", "surface_forms", "verdict")).where((F.col("verdict") == "accept") & F.col("canonical").isNotNull())
    links = rows.select("run_id", F.explode("surface_forms").alias("form"), "canonical")
    keyed = links.select(F.concat_ws("␟", "run_id", "form").alias("child"), F.concat_ws("␟", "run_id", "canonical").alias("parent")).where("child <> parent")
    return graph.resolve_chain(keyed, "child", "parent")


def _merged(spark: SparkSession, sf_dir: str) -> hierarchy.Merged:
    """The graphs of all chunks merged: their entities, edges from each mention to the next, and from a chunk's first to its file."""
    from pyspark.sql import Window as W

    mentions = chunk_mentions(spark, sf_dir).withColumn("graph_id", F.floor(F.col("ord") / 100)).where("name IS NOT NULL")
    of_chunk = W.partitionBy("graph_id").orderBy("ord")  # a chunk is one model answer, so its mentions are few
    steps = mentions.withColumns({"next": F.lead("name").over(of_chunk), "k": F.row_number().over(of_chunk)})
    follow = steps.where("next IS NOT NULL").select("graph_id", F.col("name").alias("src"), F.col("next").alias("dst"), F.array(F.lit("precedes")).alias("relation_type"), "ord")
    parts = steps.where("k = 1").select("graph_id", F.col("name").alias("src"), F.col("file").alias("dst"), F.array(F.lit("part_of")).alias("relation_type"), "ord")
    return hierarchy.hierarchical_merge(mentions, follow.unionByName(parts))


def hierarchical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of all chunk graphs merged within their files and then across them."""
    return _merged(spark, sf_dir).entities.select("name", "entity_type", F.array_join("files", "|").alias("files"), "n_mentions")


def hierarchical_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).relations.select("src", "dst", F.array_join("relation_type", ",").alias("relation_type"))


def merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, edges, edges across files and edges dropped because an end is no entity."""
    return _merged(spark, sf_dir).stats


_M = "WITH r AS (SELECT DISTINCT cp_key, coalesce(file_path, 'unknown') AS file, kg_json FROM checkpoints), u AS (SELECT cp_key, file, unnest(CAST(json_extract(kg_json, '$.entities[*]') AS JSON[])) AS e, generate_subscripts(CAST(json_extract(kg_json, '$.entities[*]') AS JSON[]), 1) - 1 AS pos FROM r), m AS (SELECT json_extract_string(e, '$.name') AS name, json_extract_string(e, '$.entityType') AS entity_type, file, ('0x' || substr(cp_key, 1, 12))::BIGINT * 100 + pos AS ord FROM u)\n"
_ELECT = "SELECT {k}, entity_type, count(*) AS n, min(ord) AS f FROM {t} GROUP BY 1, 2"
_NORM = r"trim(regexp_replace(lower({0}), '[_\-\x{{2010}}-\x{{2015}}\s\x{{A0}}\x{{FEFF}}]+', ' ', 'g'))"
QUERIES = {f.__name__: f for f in (exact_merge, elected_types, rename_ends, fuzzy_merge, folded_observations, merge_policy, inspect_merges, chain_roots, hierarchical_entities, hierarchical_relations, merge_stats)}
_H = _M + ", h AS (SELECT name, entity_type, file, ord, ord // 100 AS gid, entity_type IN ('file', 'document', 'config') AS art, " + _NORM.format("name") + """ AS norm FROM m WHERE name IS NOT NULL),
w AS (SELECT h.*, arg_min(name, ord) OVER (PARTITION BY file, norm) AS within FROM h),
i AS (SELECT *, CASE WHEN coalesce(art, false) THEN within || '␟' || file ELSE '␟' || norm END AS identity FROM w),
d AS (SELECT identity, min(ord) AS first, arg_min(within, ord) AS within, arg_min(CASE WHEN art THEN file END, ord) AS file FROM i GROUP BY 1),
o AS (SELECT identity, CASE WHEN row_number() OVER (PARTITION BY within ORDER BY first, identity) = 1 THEN within WHEN file IS NOT NULL THEN within || ' [' || file || ']' ELSE within || '#2' END AS out FROM d),
l AS (SELECT i.*, o.out FROM i JOIN o USING (identity)),
e AS (SELECT gid, name AS src, lead(name) OVER (PARTITION BY gid ORDER BY ord) AS dst, 'precedes' AS t, file, ord FROM l UNION ALL SELECT gid, arg_min(name, ord), any_value(file), 'part_of', any_value(file), min(ord) FROM l GROUP BY gid),
f AS (SELECT file, name, arg_max(within, ord) AS win, arg_max(out, ord) AS wout FROM l GROUP BY 1, 2),
g AS (SELECT name, arg_max(out, ord) AS aout FROM l WHERE NOT coalesce(art, false) GROUP BY 1),
r1 AS (SELECT e.file, e.t, min(e.ord) AS ord, coalesce(a.win, e.src) AS si, coalesce(b.win, e.dst) AS di, coalesce(a.wout, x.aout, e.src) AS so, coalesce(b.wout, y.aout, e.dst) AS do_
  FROM e LEFT JOIN f a ON a.file = e.file AND a.name = e.src LEFT JOIN f b ON b.file = e.file AND b.name = e.dst LEFT JOIN g x ON x.name = e.src LEFT JOIN g y ON y.name = e.dst WHERE e.dst IS NOT NULL GROUP BY ALL),
r2 AS (SELECT file, si, di, t, arg_min(so, ord) AS src, arg_min(do_, ord) AS dst FROM r1 WHERE si <> di GROUP BY 1, 2, 3, 4),
n AS (SELECT out AS name, arg_min(file, ord) AS home, list_sort(list(DISTINCT file)) AS files, count(*) AS n_mentions FROM l GROUP BY 1),
r3 AS (SELECT r2.src, r2.dst, t, a.home AS ah, b.home AS bh FROM r2 LEFT JOIN n a ON a.name = r2.src LEFT JOIN n b ON b.name = r2.dst WHERE r2.src <> r2.dst),
r4 AS (SELECT src, dst, t, bool_or(ah <> bh) AS crosses FROM r3 WHERE ah IS NOT NULL AND bh IS NOT NULL GROUP BY 1, 2, 3),
v AS (SELECT out, entity_type, count(*) AS n, min(ord) AS f FROM l GROUP BY 1, 2),
t AS (SELECT out AS name, arg_max(entity_type, row(coalesce(entity_type <> 'other' AND entity_type <> '', false), n, -f)) AS entity_type FROM v GROUP BY 1)
"""
ORACLES = {
    "exact_merge": _M + ", k AS (SELECT *, " + _NORM.format("name") + " || CASE WHEN entity_type IN ('file', 'document', 'config') THEN '␟' || file ELSE '' END AS norm FROM m WHERE name IS NOT NULL), c AS (" + _ELECT.format(k="norm", t="k") + "), t AS (SELECT norm, arg_max(entity_type, row(coalesce(entity_type <> 'other', false), n, -f)) AS entity_type FROM c GROUP BY 1) SELECT k.norm, arg_min(name, ord) AS name, any_value(t.entity_type) AS entity_type, count(*) AS n_mentions, coalesce(array_to_string(list_sort(list(DISTINCT file) FILTER (file <> 'unknown')), '|'), 'unknown') AS files FROM k JOIN t ON t.norm = k.norm GROUP BY 1",
    "elected_types": _M + ", c AS (" + _ELECT.format(k="name", t="m") + ") SELECT name, arg_max(entity_type, row(coalesce(entity_type <> 'other', false), n, -f)) AS entity_type FROM c GROUP BY 1",
    "folded_observations": "SELECT user_id::VARCHAR AS name, event_type AS text, min(event_id) AS ord FROM events GROUP BY 1, 2",
    "merge_policy": r"""SELECT CASE WHEN regexp_extract_all(canonical, '\d+') <> regexp_extract_all(form, '\d+') OR cosine IS NULL OR cosine < 0.72 THEN 'reject' WHEN cosine >= 0.88 THEN 'merge' ELSE 'ask' END AS policy, verdict, count(*) AS n FROM (SELECT canonical, unnest(surface_forms) AS form, cosine, verdict FROM (SELECT DISTINCT merge_decision_id, canonical, surface_forms, cosine, verdict FROM merge_decisions) WHERE canonical IS NOT NULL) GROUP BY 1, 2""",
    "inspect_merges": "SELECT merge_decision_id, cosine, members, cosine < 0.8 AS suspect FROM (SELECT DISTINCT merge_decision_id, cosine, len(surface_forms) + (canonical IS NOT NULL)::INT AS members FROM merge_decisions WHERE verdict = 'accept' AND merge_target = 'entity' AND cosine IS NOT NULL) WHERE members > 1 ORDER BY cosine, members DESC, merge_decision_id LIMIT 20",
    "hierarchical_entities": _H + "SELECT n.name, coalesce(entity_type, 'other') AS entity_type, array_to_string(CASE WHEN len(files) > 1 THEN list_filter(files, lambda x: x <> 'unknown') ELSE files END, '|') AS files, n_mentions FROM n JOIN t USING (name)",
    "hierarchical_relations": _H + "SELECT src, dst, t AS relation_type FROM r4",
    "merge_stats": _H + "SELECT count(*) AS relations, count(*) FILTER (crosses) AS cross_file_edges, (SELECT count(*) FROM r3 WHERE ah IS NULL OR bh IS NULL) AS dropped_dangling_edges, (SELECT count(*) FROM n) AS entities FROM r4",
}
