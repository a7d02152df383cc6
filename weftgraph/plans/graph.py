"""Queries on the trade graph: deduplication, filters, integrity, counts, neighbours, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import verbalise
from weftgraph.operators import canonical, graph
from weftgraph.plans.common import TRADE, trade_graph
from weftgraph.sources.tables import table

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _types(df: DataFrame) -> DataFrame:
    return df.withColumn("relation_type", F.array_join("relation_type", ","))


def relation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _types(graph.dedup_relations(trade_graph(spark, sf_dir)[1], ORDER))


def _distinct(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ents, rels = trade_graph(spark, sf_dir)
    return ents, graph.dedup_relations(rels.select("src", "dst", "relation_type"), [])


def relation_filter_redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _types(graph.filter_catch_all(_distinct(spark, sf_dir)[1], "redundant"))


def relation_filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _types(graph.filter_catch_all(_distinct(spark, sf_dir)[1], "all"))


def integrity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ents, rels = _distinct(spark, sf_dir)
    return _types(graph.integrity_gate(rels, ents))


def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw edges with an unknown end, by which ends are known."""
    ents, rels = trade_graph(spark, sf_dir)
    return graph.dangling(rels, ents).groupBy("src_known", "dst_known").agg(F.count(F.lit(1)).alias("n"))


def stub_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ents, rels = _distinct(spark, sf_dir)
    external = spark.createDataFrame([("NATION-12",)], "name string")
    return graph.with_stubs(ents, rels, external)


def trade_graph_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.health(*trade_graph(spark, sf_dir))


def trade_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(*trade_graph(spark, sf_dir))


def edge_label_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.relation_type_counts(trade_graph(spark, sf_dir)[1], "(untyped)")


def bidirectional_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bidirectional_pairs(trade_graph(spark, sf_dir)[1])


def vocabulary_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ents, rels = trade_graph(spark, sf_dir)
    fit = graph.vocabulary_fit(ents, rels)
    return fit.select(*[F.round(c, 6).alias(c) for c in fit.columns])


def coerced_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rels = trade_graph(spark, sf_dir)[1]
    allowed = graph.allowed_vocabulary(["uses"], glossary=["supplies"], mode="strict")
    return graph.relation_type_counts(rels.select(graph.coerce_vocabulary(F.col("relation_type"), allowed).alias("relation_type")))


def trade_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ents, rels = trade_graph(spark, sf_dir)
    return graph.neighbours(rels, ents)


def hidden_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _types(graph.hide_types(*_distinct(spark, sf_dir), ["other", "region_0"])[1])


def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ents, _ = trade_graph(spark, sf_dir)
    hits = [graph.find_entity(ents, q, "ord").select(F.lit(q).alias("query"), "name") for q in ("nation_2", "N_1", "absent")]
    return hits[0].unionByName(hits[1]).unionByName(hits[2])


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of nations that trade within six places of each other and have an entity."""
    ents, rels = _distinct(spark, sf_dir)
    return graph.connected_components(graph.integrity_gate(rels, ents), ents)


def graph_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    ents, rels = _distinct(spark, sf_dir)
    out = graph.structure(ents, rels)
    return out.select(*[F.round(c, 6).alias(c) if c in ("density", "relations_per_entity") else F.col(c) for c in out.columns])


def verbalised_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rels = _distinct(spark, sf_dir)[1]
    return rels.select("src", "dst", verbalise(F.col("src"), F.col("relation_type"), F.col("dst")).alias("sentence"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations clustered by region."""
    nation = table(spark, sf_dir, "nation", ("n_name", "n_regionkey"))
    return nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("cluster"))


def _region_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    ents, rels = trade_graph(spark, sf_dir)
    return canonical.entity_renames(ents, _regions(spark, sf_dir), rels)


def canonical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's nations folded into the one with the most edges."""
    ents = trade_graph(spark, sf_dir)[0].withColumn("files", F.array(F.concat(F.lit("n"), F.col("ord") % 3)))
    return canonical.fold_entities(ents, _region_renames(spark, sf_dir)).select("name", "entity_type", F.array_join("files", "|").alias("files"))


def canonical_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges between those, with the labels of one spelling group under the most frequent label."""
    rels = trade_graph(spark, sf_dir)[1]
    labels = rels.select(F.explode("relation_type").alias("label")).distinct().withColumn("cluster", F.lower(F.trim("label")))
    named = canonical.rename_labels(rels, canonical.label_renames(rels, labels))
    return _types(canonical.rename_relations(named, _region_renames(spark, sf_dir), ORDER)).select("src", "dst", "relation_type")


def merge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was folded into which canonical name."""
    return canonical.merge_log(_region_renames(spark, sf_dir), "region").withColumn("surface_forms", F.array_join("surface_forms", "|"))


_EDGES = TRADE + ", d AS (SELECT DISTINCT src, dst, types FROM folded WHERE src <> dst)\n"
_TYPED = "len(list_filter(types, lambda t: t <> 'related_to')) > 0"
QUERIES = {
    f.__name__: f
    for f in (relation_dedup, relation_filter_redundant, relation_filter_all, integrity_gate, dangling_edges, stub_entities, trade_graph_health, trade_degree, edge_label_freq, bidirectional_pairs, vocabulary_fit, coerced_vocabulary, trade_neighbours, hidden_types, entity_search, connected_components, graph_structure, verbalised_relations, canonical_entities, canonical_relations, merge_log)
}
_CANON = TRADE + """, x AS (SELECT src AS name FROM rels UNION ALL SELECT dst FROM rels), g AS (SELECT e.name, n_regionkey AS k, count(x.name) AS n FROM ents e JOIN nation ON n_name = e.name LEFT JOIN x ON x.name = e.name GROUP BY 1, 2),
c AS (SELECT name AS member, first_value(name) OVER (PARTITION BY k ORDER BY n DESC, name) AS canonical FROM g)
"""
_SAY = "src, dst, array_to_string(types, ',') AS relation_type"
ORACLES = {
    "relation_dedup": TRADE + "SELECT src, dst, array_to_string(types, ',') AS relation_type, f.l_orderkey, f.l_linenumber, f.l_partkey, f.l_suppkey FROM (SELECT src, dst, types, min(row(l_orderkey, l_linenumber, l_partkey, l_suppkey)::STRUCT(l_orderkey BIGINT, l_linenumber INTEGER, l_partkey BIGINT, l_suppkey BIGINT)) AS f FROM folded WHERE src <> dst GROUP BY 1, 2, 3)",
    "relation_filter_redundant": _EDGES + f"SELECT {_SAY} FROM d WHERE {_TYPED} OR NOT EXISTS (SELECT 1 FROM (SELECT src AS a, dst AS b FROM d WHERE {_TYPED}) t WHERE (a = src AND b = dst) OR (a = dst AND b = src))",
    "relation_filter_all": _EDGES + f"SELECT {_SAY} FROM d WHERE {_TYPED}",
    "integrity_gate": _EDGES + f"SELECT {_SAY} FROM d WHERE src IN (SELECT name FROM ents) AND dst IN (SELECT name FROM ents)",
    "dangling_edges": TRADE + "SELECT * FROM (SELECT src IN (SELECT name FROM ents) AS src_known, dst IN (SELECT name FROM ents) AS dst_known, count(*) AS n FROM rels GROUP BY 1, 2) WHERE NOT (src_known AND dst_known)",
    "stub_entities": _EDGES + "SELECT name, entity_type FROM ents UNION ALL SELECT DISTINCT e, 'external' FROM (SELECT src AS e FROM d UNION SELECT dst FROM d) WHERE e = 'NATION-12'",
    "trade_graph_health": TRADE + """SELECT (SELECT count(*) FROM ents) AS entity_count, (SELECT count(DISTINCT entity_type) FROM ents) AS entity_type_count, count(*) AS relation_count,
  (SELECT count(DISTINCT t) FROM (SELECT unnest(relation_type) AS t FROM rels) WHERE t <> '') AS relation_type_count, sum((src = dst)::INT)::BIGINT AS self_loop_count,
  (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM rels) a JOIN (SELECT DISTINCT src, dst FROM rels) b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst) AS bidirectional_pair_count,
  sum((src NOT IN (SELECT name FROM ents) OR dst NOT IN (SELECT name FROM ents))::INT)::BIGINT AS dangling_endpoint_count,
  1 - sum((src NOT IN (SELECT name FROM ents) OR dst NOT IN (SELECT name FROM ents))::INT)::DOUBLE / count(*) AS referential_integrity,
  (count(*) - count(DISTINCT (src, dst, types)))::BIGINT AS parallel_edge_count FROM folded""",
    "trade_degree": TRADE + ", x AS (SELECT src AS name FROM rels UNION ALL SELECT dst FROM rels), c AS (SELECT name, count(*) AS n FROM x GROUP BY 1) SELECT coalesce(e.name, c.name) AS name, coalesce(n, 0) AS degree, e.name IS NOT NULL AS known FROM ents e FULL JOIN c USING (name)",
    "edge_label_freq": TRADE + "SELECT t AS relation_type, count(*) AS n FROM (SELECT unnest(relation_type) AS t FROM rels) GROUP BY 1",
    "bidirectional_pairs": TRADE + "SELECT DISTINCT a.src AS a, a.dst AS b FROM rels a WHERE a.src < a.dst AND (a.dst, a.src) IN (SELECT (src, dst) FROM rels)".replace("(a.dst, a.src) IN (SELECT (src, dst) FROM rels)", "EXISTS (SELECT 1 FROM rels b WHERE b.src = a.dst AND b.dst = a.src)"),
    "vocabulary_fit": TRADE + "SELECT round(avg((relation_type = ['related_to'])::INT), 6) AS all_catch_all, round(avg(list_contains(relation_type, 'related_to')::INT), 6) AS any_catch_all, (SELECT round(avg((entity_type = 'other')::INT), 6) FROM ents) AS other_entities FROM rels",
    "coerced_vocabulary": TRADE + "SELECT CASE WHEN t = 'supplies' THEN t ELSE 'related_to' END AS relation_type, count(*) AS n FROM (SELECT unnest(relation_type) AS t FROM rels) GROUP BY 1",
    "trade_neighbours": TRADE + "SELECT focus, neighbour, count(*) AS n_edges FROM (SELECT src AS focus, dst AS neighbour FROM rels UNION ALL SELECT dst, src FROM rels) WHERE focus <> neighbour AND focus IN (SELECT name FROM ents) GROUP BY 1, 2",
    "hidden_types": _EDGES + f", s AS (SELECT name FROM ents WHERE entity_type NOT IN ('other', 'region_0')) SELECT {_SAY} FROM d WHERE src IN (SELECT name FROM s) AND dst IN (SELECT name FROM s)",
    "entity_search": TRADE + "SELECT 'nation_2' AS query, 'NATION_2' AS name UNION ALL (SELECT 'N_1', name FROM ents WHERE contains(lower(name), 'n_1') ORDER BY ord LIMIT 1)",
    "connected_components": _EDGES.replace("WITH ents", "WITH RECURSIVE ents") + ", g AS (SELECT DISTINCT src AS a, dst AS b FROM d WHERE src IN (SELECT name FROM ents) AND dst IN (SELECT name FROM ents)), u AS (SELECT a, b FROM g UNION SELECT b, a FROM g), w(name, r) AS (SELECT name, name FROM ents UNION SELECT w.name, u.b FROM w JOIN u ON u.a = w.r) SELECT name, min(r) AS component FROM w GROUP BY 1",
    "graph_structure": _EDGES.replace("WITH ents", "WITH RECURSIVE ents") + ", g AS (SELECT DISTINCT src AS a, dst AS b FROM d WHERE src IN (SELECT name FROM ents) AND dst IN (SELECT name FROM ents)), u AS (SELECT a, b FROM g UNION SELECT b, a FROM g), w(name, r) AS (SELECT name, name FROM ents UNION SELECT w.name, u.b FROM w JOIN u ON u.a = w.r), c AS (SELECT name, min(r) AS component FROM w GROUP BY 1), n AS (SELECT count(*) AS n FROM ents), m AS (SELECT count(*) AS m FROM d) SELECT n AS entity_count, m AS relation_count, (SELECT count(DISTINCT component) FROM c) AS connected_components, (SELECT count(*) FROM ents WHERE name NOT IN (SELECT src FROM d UNION SELECT dst FROM d)) AS isolated_entities, round(m / (n * (n - 1)), 6) AS density, round(m / n, 6) AS relations_per_entity FROM n, m",
    "verbalised_relations": _EDGES + "SELECT src, dst, concat_ws(' ', src, array_to_string(list_transform(types, lambda t: replace(t, '_', ' ')), ' and '), dst) AS sentence FROM d",
    "canonical_entities": _CANON + "SELECT c.canonical AS name, max(e.entity_type) FILTER (e.name = c.canonical) AS entity_type, array_to_string(list_sort(list(DISTINCT 'n' || (e.ord % 3))), '|') AS files FROM ents e JOIN c ON c.member = e.name GROUP BY 1",
    "canonical_relations": _CANON + "SELECT DISTINCT coalesce(a.canonical, src) AS src, coalesce(b.canonical, dst) AS dst, array_to_string(types, ',') AS relation_type FROM folded LEFT JOIN c a ON a.member = src LEFT JOIN c b ON b.member = dst WHERE coalesce(a.canonical, src) <> coalesce(b.canonical, dst)",
    "merge_log": _CANON + "SELECT canonical, string_agg(member, '|' ORDER BY member) AS surface_forms, count(*) AS member_count, 'region' AS method, 1.0::DOUBLE AS min_sim, 1.0::DOUBLE AS max_sim FROM c GROUP BY 1 HAVING count(*) > 1",
}
