"""Queries on embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import vectors as vs
from weftgraph.sources.tables import table

SIMILAR = 0.35


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vs.unit_vectors(table(spark, sf_dir, "embeddings", ("vec_id", "embedding")).dropDuplicates(["vec_id"]), "vec_id", "embedding")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vs.similar_pairs(_vectors(spark, sf_dir), SIMILAR)


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("sim", F.round("sim", 6))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors for every vector whose id is divisible by 20."""
    v = _vectors(spark, sf_dir)
    return vs.top_neighbours(v, v.where("id % 20 = 0"), 5).withColumn("sim", F.round("sim", 6))


def symmetric_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return vs.symmetric_blocks(vs.top_neighbours(v, v, 5)).withColumn("sim", F.round("sim", 6))


def similarity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vs.histogram(_pairs(spark, sf_dir))


def single_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vs.single_linkage(_pairs(spark, sf_dir), _vectors(spark, sf_dir))


def complete_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vs.complete_linkage(vs.similar_pairs(_vectors(spark, sf_dir), 0.45), _vectors(spark, sf_dir))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters and collapsed vectors at each of three thresholds."""
    pairs, ids, out = _pairs(spark, sf_dir), _vectors(spark, sf_dir), None
    for t in (0.4, 0.45, 0.5):
        c = vs.single_linkage(pairs.where(F.col("sim") >= t), ids).agg(F.lit(t).alias("threshold"), F.count_distinct("cluster").alias("clusters"), (F.count(F.lit(1)) - F.count_distinct("cluster")).alias("collapsed"))
        out = c if out is None else out.unionByName(c)
    return out


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity within and across labels of the similar pairs, and what parts the two best."""
    labels = table(spark, sf_dir, "embeddings", ("vec_id", "label"))
    p = _pairs(spark, sf_dir).join(labels.select(F.col("vec_id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("vec_id").alias("b"), F.col("label").alias("lb")), "b")
    return p.groupBy((F.col("la") == F.col("lb")).alias("same")).agg(F.round(F.avg("sim"), 6).alias("mean"), F.round(F.var_pop("sim"), 6).alias("variance"), F.count(F.lit(1)).alias("n"))


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal-rank fusion of vector similarity and nearness of ids."""
    v = _vectors(spark, sf_dir)
    near = vs.top_neighbours(v, v.where("id % 20 = 0"), 5)
    scored = near.select("query", "id", F.round("sim", 6).alias("s1"), (-F.abs(F.col("query") - F.col("id"))).cast("double").alias("s2"))
    return vs.fused_ranks(scored).withColumn("rrf", F.round("rrf", 9))


def vector_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten vectors most relevant to vector 0 or named by a term."""
    v = _vectors(spark, sf_dir).withColumn("name", F.concat(F.lit("vector "), F.col("id")))
    query = v.where("id = 0").select(F.col("vec").alias("query_vec"), F.array(F.lit("vector 11")).alias("terms"))
    return vs.retrieval(v, query)


def grounding_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query vector the labels of its three nearest nodes, as one text in rank order."""
    v = _vectors(spark, sf_dir)
    near = vs.top_neighbours(v, v.where("id % 20 = 0"), 3)
    triples = table(spark, sf_dir, "embeddings", ("vec_id", "label")).select(F.col("vec_id").alias("node"), F.concat(F.lit("node is "), F.col("label")).alias("triple"))
    return vs.grounding_triples(near, triples)


_V = "WITH v AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)\n"
_P = _V + ", p AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS sim, a.label AS la, b.label AS lb FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.35)\n"
_T = _V + ", s AS (SELECT q.id AS query, x.id, list_cosine_similarity(q.e, x.e) AS sim, x.label FROM v q JOIN v x ON q.id <> x.id WHERE q.id % 20 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM s)\n"
QUERIES = {f.__name__: f for f in (cosine_pairs, cosine_topk, symmetric_blocking, similarity_histogram, single_linkage, complete_linkage, threshold_sweep, label_means, rank_fusion, vector_retrieval, grounding_context)}
ORACLES = {
    "cosine_pairs": _P + "SELECT a, b, round(sim, 6) AS sim FROM p",
    "cosine_topk": _T + "SELECT query, id, round(sim, 6) AS sim, rank FROM t WHERE rank <= 5",
    "symmetric_blocking": _T.replace(" WHERE q.id % 20 = 0", "") + "SELECT least(query, id) AS a, greatest(query, id) AS b, round(max(sim), 6) AS sim FROM t WHERE rank <= 5 GROUP BY 1, 2",
    "similarity_histogram": _P + "SELECT least(greatest(floor(sim * 20), 0), 19)::INTEGER AS bucket, count(*) AS n FROM p GROUP BY 1",
    "label_means": _P + "SELECT la = lb AS same, round(avg(sim), 6) AS mean, round(var_pop(sim), 6) AS variance, count(*) AS n FROM p GROUP BY 1",
    "rank_fusion": _T + ", f AS (SELECT query, id, round(sim, 6) AS s1, -abs(query - id)::DOUBLE AS s2 FROM t WHERE rank <= 5), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s1 DESC, id) AS r1, row_number() OVER (PARTITION BY query ORDER BY s2 DESC, id) AS r2 FROM f) SELECT *, round(1 / (r1 + 60) + 1 / (r2 + 60), 9) AS rrf FROM r",
    "vector_retrieval": _V + ", s AS (SELECT x.id, 'vector ' || x.id AS name, contains('vector ' || x.id, 'vector 11') AS n, list_cosine_similarity(q.e, x.e) AS sim FROM v x, (SELECT e FROM v WHERE id = 0) q) SELECT id, name, round(CASE WHEN n THEN greatest(1.0, sim) ELSE sim END, 6) AS score FROM s WHERE n OR sim > 0.3 ORDER BY score DESC, id LIMIT 10",
    "grounding_context": _T + ", g AS (SELECT query, 'node is ' || label AS triple, min(rank) AS r FROM t WHERE rank <= 3 GROUP BY 1, 2) SELECT query, string_agg(triple, '. ' ORDER BY r, triple) AS context FROM g GROUP BY 1",
}
