"""Queries of similarity by characters and words, glossaries, triples, verdicts and link following."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import similarity, text
from weftgraph.operators import corpus, evaluate, graph, links, resolve
from weftgraph.plans.common import STRUCT, TRADE, struct_graph, trade_graph
from weftgraph.plans.resolve import _M, chunk_mentions
from weftgraph.sources.tables import table


def trigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike each part's name and type are by their character trigrams."""
    parts = table(spark, sf_dir, "part", ("p_partkey", "p_name", "p_type"))
    grams = lambda c: similarity.char_ngrams(F.col(c))
    return parts.select("p_partkey", F.round(similarity.jaccard(grams("p_name"), grams("p_type")), 6).alias("jaccard"))


def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the smaller word set that a turn's corrected text and its raw engine text have in common."""
    turns = table(spark, sf_dir, "recua_turns", ("row_id", "corrected", "parakeet")).where("corrected IS NOT NULL AND parakeet IS NOT NULL").distinct()
    words = lambda c: F.filter(F.split(F.lower(F.col(c)), "[^a-z0-9]+"), lambda w: w != "")
    return turns.select("row_id", F.round(similarity.overlap_coefficient(words("corrected"), words("parakeet")), 6).alias("overlap"))


def affirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by type that read as an affirmative verdict."""
    rows = table(spark, sf_dir, "chat_messages", ("row_id", "msg_type", "text")).where("text IS NOT NULL").distinct()
    return rows.groupBy("msg_type", text.verdict_yes(F.col("text")).alias("yes")).agg(F.count(F.lit(1)).alias("n"))


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entity types met in the chunks, and the first names as relation candidates, at most so many of each."""
    m = chunk_mentions(spark, sf_dir)
    types = m.select(F.lit("type").alias("kind"), "ord", F.col("entity_type").alias("term"))
    return corpus.glossary_terms(types.unionByName(m.select(F.lit("relation").alias("kind"), "ord", F.lower("name").alias("term"))))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the graph of the relational tables as triples, counted by predicate and parent table."""
    out = evaluate.graph_triples(struct_graph(spark, sf_dir)[2], [])
    return out.groupBy("p", F.split_part("o", F.lit("#"), F.lit(1)).alias("parent")).agg(F.count(F.lit(1)).alias("n"))


def cluster_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name that stands for each region: its nation of highest degree."""
    ents, rels = trade_graph(spark, sf_dir)
    members = table(spark, sf_dir, "nation", ("n_name", "n_regionkey")).select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("cluster"))
    return resolve.canonical_names(members, graph.degrees(ents, rels))


def reached_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by the number of foreign keys that lead to them from the orders, followed without limit."""
    ents, _, rels = struct_graph(spark, sf_dir)
    start = ents.where("entity_type = 'orders'").select("name")
    return links.followed(rels.select("src", "dst"), start, 0).groupBy("depth", F.split_part("name", F.lit("#"), F.lit(1)).alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


_GRAMS = "list_distinct(CASE WHEN length({0}) < 3 THEN [lower({0})] ELSE list_transform(range(1, length({0}) - 1), lambda i: substr(lower({0}), i, 3)) END)"
_WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''))"
QUERIES = {f.__name__: f for f in (trigram_jaccard, word_overlap, affirmed, glossary, triples, cluster_names, reached_entities)}
ORACLES = {
    "trigram_jaccard": f"WITH g AS (SELECT p_partkey, {_GRAMS.format('p_name')} AS a, {_GRAMS.format('p_type')} AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM g",
    "word_overlap": f"WITH g AS (SELECT DISTINCT row_id, {_WORDS.format('corrected')} AS a, {_WORDS.format('parakeet')} AS b FROM recua_turns WHERE corrected IS NOT NULL AND parakeet IS NOT NULL) SELECT row_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / least(len(a), len(b)) END, 6) AS overlap FROM g",
    "affirmed": r"SELECT msg_type, regexp_matches(lower(trim(text, ' ')), '^(yes|true)|(^|\s)1(\s|$|[.,])') AS yes, count(*) AS n FROM (SELECT DISTINCT row_id, msg_type, text FROM chat_messages WHERE text IS NOT NULL) GROUP BY 1, 2",
    "glossary": _M + ", t AS (SELECT 'type' AS kind, ord, entity_type AS term FROM m UNION ALL SELECT 'relation', ord, lower(name) FROM m), f AS (SELECT kind, term, min(ord) AS ord FROM t WHERE term IS NOT NULL AND term <> '' AND NOT (kind = 'relation' AND starts_with(term, 'has_')) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ord)::INTEGER AS k FROM f) SELECT kind, term, ord FROM k WHERE k <= CASE WHEN kind = 'relation' THEN 15 ELSE 20 END",
    "triples": STRUCT + "SELECT relation_type[1] AS p, split_part(dst, '#', 1) AS parent, count(*) AS n FROM rels GROUP BY 1, 2",
    "cluster_names": TRADE + ", x AS (SELECT src AS name FROM rels UNION ALL SELECT dst FROM rels), g AS (SELECT n_name AS name, n_regionkey AS cluster, count(x.name) AS n FROM nation LEFT JOIN x ON x.name = n_name GROUP BY 1, 2) SELECT cluster, arg_max(name, row(n, -cluster)) AS canonical FROM (SELECT DISTINCT ON (cluster) cluster, name, n FROM g ORDER BY cluster, n DESC, name) GROUP BY 1",
    "reached_entities": STRUCT.replace("WITH ents", "WITH RECURSIVE ents") + ", w(name, depth) AS (SELECT name, 0 FROM ents WHERE entity_type = 'orders' UNION SELECT r.dst, w.depth + 1 FROM w JOIN rels r ON r.src = w.name), d AS (SELECT name, min(depth) AS depth FROM w GROUP BY 1) SELECT depth, split_part(name, '#', 1) AS entity_type, count(*) AS n FROM d GROUP BY 1, 2",
}
