"""Queries of extraction quality: what a transcript engine heard against the corrected text, and rough against final graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import evaluate, vectors
from weftgraph.sources.tables import table


def _triples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold: accepted matches as triples per run. Extracted: all matches that a cosine of 0.85 would accept."""
    rows = table(spark, sf_dir, "merge_decisions", ("merge_decision_id", "run_id", "merge_target", "verdict", "canonical", "surface_forms", "match_method", "cosine")).distinct()
    said = rows.where("canonical IS NOT NULL AND merge_target = 'entity'").select("run_id", F.col("canonical").alias("s"), F.coalesce("match_method", F.lit("none")).alias("p"), F.explode("surface_forms").alias("o"), "verdict", "cosine")
    return said.where("cosine >= 0.85").select("run_id", "s", "p", "o"), said.where("verdict = 'accept'").select("run_id", "s", "p", "o")


def exact_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_levels(*_triples(spark, sf_dir), ["run_id"])


def micro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.micro(exact_prf(spark, sf_dir), ["level"])
    return out.select("level", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def per_domain_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triple level per match method."""
    e, g = _triples(spark, sf_dir)
    out = evaluate.with_scores(evaluate.multiset_counts(evaluate.parts(e, "triple", ["p"]), evaluate.parts(g, "triple", ["p"]), ["p"]))
    return out.select(F.col("p").alias("method"), "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def ign_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triple level without what the nightly run had already seen, on both sides."""
    e, g = _triples(spark, sf_dir)
    seen = g.where("run_id = 'run-nightly-main'")
    e, g = evaluate.without_seen(e, seen), evaluate.without_seen(g, seen)
    counts = evaluate.multiset_counts(evaluate.parts(e, "triple", ["run_id"]), evaluate.parts(g, "triple", ["run_id"]), ["run_id"])
    out = evaluate.micro(counts.withColumn("level", F.lit("triple")), ["level"])
    return out.select("level", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


def semantic_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-fit matches of embeddings of even ids against those of odd ones, per label."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("sample"), F.col("vec_id").cast("string").alias("part"), F.col("embedding").cast("array<double>").alias("vec"), F.col("vec_id").alias("ord"))
    return evaluate.with_scores(evaluate.semantic_counts(v.where("ord % 2 = 0"), v.where("ord % 2 = 1"), 0.35))


def best_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose nearest vector is clear of the second."""
    v = vectors.unit_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    near = vectors.top_neighbours(v, v.where("id % 20 = 0"), 2).withColumn("sim", F.round("sim", 6))
    return evaluate.best_match(near, "query", "id", "sim", 0.3, 0.02)


def similarity_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the cosines of accepted decisions stand apart from those of the others."""
    rows = table(spark, sf_dir, "merge_decisions", ("merge_decision_id", "cosine", "verdict")).where("cosine IS NOT NULL AND verdict IS NOT NULL").distinct()
    out = evaluate.separation(rows.withColumn("hit", F.col("verdict") == "accept"), "cosine", "hit")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def similarity_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the recorded cosine of a match tells accepted from rejected ones."""
    rows = table(spark, sf_dir, "merge_decisions", ("merge_decision_id", "cosine", "verdict")).distinct().where("cosine IS NOT NULL")
    out = evaluate.rank_auc(rows.select("cosine", (F.col("verdict") == "accept").alias("good")), "cosine", "good")
    return out.select(F.round("auc", 6).alias("auc"))


def node_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity names found, as triples of themselves."""
    e, g = _triples(spark, sf_dir)
    self_ = lambda d: evaluate.parts(d, "entity", ["run_id"]).select("run_id", F.concat_ws("|", "part", "part", "part").alias("part"))
    return evaluate.micro(evaluate.multiset_counts(self_(e), self_(g), ["run_id"]).withColumn("level", F.lit("node")), ["level"]).select("level", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


_KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9\\s]', '', 'g'))"
_T = """WITH r AS (SELECT DISTINCT merge_decision_id, run_id, merge_target, verdict, canonical, surface_forms, match_method, cosine FROM merge_decisions),
a AS (SELECT run_id, canonical AS s, coalesce(match_method, 'none') AS p, unnest(surface_forms) AS o, verdict, cosine FROM r WHERE canonical IS NOT NULL AND merge_target = 'entity'),
e AS (SELECT run_id, s, p, o FROM a WHERE cosine >= 0.85), g AS (SELECT run_id, s, p, o FROM a WHERE verdict = 'accept')
"""


def _parts(t: str, level: str, key: str) -> str:
    k = _KEY.format
    if level == "triple":
        return f"SELECT {key} AS k, {k('s')} || '|' || {k('p')} || '|' || {k('o')} AS part FROM {t}"
    if level == "relation":
        return f"SELECT {key} AS k, {k('p')} AS part FROM {t}"
    return f"SELECT k, {k('x')} AS part FROM (SELECT DISTINCT {key} AS k, x FROM (SELECT {key}, unnest([s, o]) AS x FROM {t}))"


def _counts(level: str, key: str, e: str = "e", g: str = "g") -> str:
    return f"SELECT k, '{level}' AS level, sum(least(e, g))::BIGINT AS tp, (sum(e) - sum(least(e, g)))::BIGINT AS fp, (sum(g) - sum(least(e, g)))::BIGINT AS fn FROM (SELECT k, part, sum(e) AS e, sum(g) AS g FROM (SELECT k, part, 1 AS e, 0 AS g FROM ({_parts(e, level, key)}) UNION ALL SELECT k, part, 0, 1 FROM ({_parts(g, level, key)})) GROUP BY 1, 2) GROUP BY 1"


_ALL = " UNION ALL ".join(_counts(level, "run_id") for level in ("entity", "relation", "triple"))
_PRF = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS re"
_F1 = "round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS f1"
QUERIES = {f.__name__: f for f in (exact_prf, micro_prf, per_domain_prf, ign_prf, semantic_prf, best_alignment, similarity_auc, similarity_separation, node_capture)}
ORACLES = {
    "exact_prf": _T + f"SELECT k AS run_id, level, tp, fp, fn FROM ({_ALL})",
    "micro_prf": _T + f", c AS (SELECT level, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM ({_ALL}) GROUP BY 1), v AS (SELECT *, {_PRF} FROM c) SELECT level, tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, {_F1} FROM v",
    "per_domain_prf": _T + f", c AS ({_counts('triple', 'p')}), v AS (SELECT *, {_PRF} FROM c) SELECT k AS method, tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, {_F1} FROM v",
    "ign_prf": _T + ", s AS (SELECT DISTINCT lower(trim(s)) || '|' || lower(trim(p)) || '|' || lower(trim(o)) AS k FROM g WHERE run_id = 'run-nightly-main'), e2 AS (SELECT * FROM e WHERE lower(trim(s)) || '|' || lower(trim(p)) || '|' || lower(trim(o)) NOT IN (SELECT k FROM s)), g2 AS (SELECT * FROM g WHERE lower(trim(s)) || '|' || lower(trim(p)) || '|' || lower(trim(o)) NOT IN (SELECT k FROM s))" + f", c AS (SELECT level, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM ({_counts('triple', 'run_id', 'e2', 'g2')}) GROUP BY 1), v AS (SELECT *, {_PRF} FROM c) SELECT level, tp, fp, fn, {_F1} FROM v",
    "best_alignment": "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.id AS query, x.id, round(list_cosine_similarity(q.e, x.e), 6) AS sim FROM v q JOIN v x ON q.id <> x.id WHERE q.id % 20 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS r, lead(sim) OVER (PARTITION BY query ORDER BY sim DESC, id) AS nxt FROM s) SELECT query, id FROM t WHERE r = 1 AND sim >= 0.3 AND sim - nxt >= 0.02",
    "similarity_separation": """WITH d AS (SELECT DISTINCT merge_decision_id, cosine AS s, verdict = 'accept' AS hit FROM merge_decisions WHERE cosine IS NOT NULL AND verdict IS NOT NULL),
m AS (SELECT avg(s) FILTER (hit) AS mp, avg(s) FILTER (NOT hit) AS mn, var_pop(s) FILTER (hit) AS vp, var_pop(s) FILTER (NOT hit) AS vn, count(*) FILTER (hit) AS np, count(*) FILTER (NOT hit) AS nn FROM d),
o AS (SELECT s, hit, row_number() OVER (PARTITION BY hit ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY hit) AS n FROM d),
t AS (SELECT DISTINCT s FROM d), j AS (SELECT t.s, (SELECT count(*) FROM d WHERE hit AND d.s >= t.s) / np - (SELECT count(*) FROM d WHERE NOT hit AND d.s >= t.s) / nn AS j FROM t, m)
SELECT round(mp, 6) AS mean_positive, round(mn, 6) AS mean_negative, round(vp, 6) AS var_positive, round(vn, 6) AS var_negative,
  round((SELECT s FROM o WHERE hit AND i = floor(0.05 * n)), 6) AS q_positive, round((SELECT s FROM o WHERE NOT hit AND i = floor(0.05 * n)), 6) AS q_negative,
  round((mp - mn) / sqrt((vp + vn) / 2 + 1e-9), 6) AS d_prime, round((SELECT arg_max(s, row(round(j, 12), -s)) FROM j), 6) AS threshold, round((SELECT max(j) FROM j), 6) AS youden_j FROM m""",
    "similarity_auc": "WITH d AS (SELECT DISTINCT merge_decision_id, cosine, verdict FROM merge_decisions WHERE cosine IS NOT NULL), p AS (SELECT cosine AS s, count(*) FILTER (verdict = 'accept') AS p, count(*) FILTER (verdict <> 'accept') AS n FROM d GROUP BY 1), w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM p) SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM w",
    "node_capture": _T + f", c AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM ({_counts('entity', 'run_id')})), v AS (SELECT *, {_PRF} FROM c) SELECT 'node' AS level, tp, fp, fn, {_F1} FROM v",
}
