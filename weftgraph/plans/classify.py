"""Queries on content classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import classify, corpus
from weftgraph.sources.tables import table

#: the class that a document's source stands for, as a gold label
GOLD = {"code-comments": "source_code", "chat-export": "conversation", "meeting-audio": "conversation", "mail-archive": "email", "html-crawl": "web_page", "paper-notes": "scientific", "wiki-dump": "technical_docs", "field-reports": "report", "glossary": "glossary"}


def _distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ("doc_id", "text"))
    return classify.class_distribution(docs, "doc_id", "text")


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distribution(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


def domain_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the gate abstains, picks one class or several."""
    return classify.domain_gate(_distribution(spark, sf_dir), "doc_id").groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = corpus.class_profile(_distribution(spark, sf_dir), 0.1)
    return out.withColumn("mean_confidence", F.round("mean_confidence", 6))


def chunk_class_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of an origin from those of its documents."""
    docs = table(spark, sf_dir, "documents", ("doc_id", "origin"))
    sizes = docs.groupBy("origin").agg(F.count(F.lit(1)).alias("chunks"))
    joined = _distribution(spark, sf_dir).where("confidence > 0.1").join(docs, "doc_id").join(sizes, "origin")
    return classify.merged_chunks(joined, "origin", F.col("chunks")).withColumn("confidence", F.round("confidence", 6))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.create_map(*[F.lit(x) for kv in GOLD.items() for x in kv])
    docs = table(spark, sf_dir, "documents", ("doc_id", "source")).select("doc_id", F.try_element_at(gold, F.lower(F.trim("source"))).alias("gold")).where("gold IS NOT NULL")
    gate = classify.domain_gate(_distribution(spark, sf_dir), "doc_id", 0.13, 0.0)
    return docs.join(gate, "doc_id").select("gold", F.when(F.col("decision") != "abstain", F.col("class")).alias("pred"))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.confusion(_predicted(spark, sf_dir))


def class_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = corpus.accuracy_by_class(_predicted(spark, sf_dir))
    return out.select("class", "gold", "predicted", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def classifier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = corpus.accuracy_summary(_predicted(spark, sf_dir))
    return out.select("total", "predicted", "correct", *[F.round(c, 6).alias(c) for c in ("accuracy", "coverage", "macro_f1")])


def routing_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions against the gold class: exactly right, abstained."""
    p = _predicted(spark, sf_dir)
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("exact"), F.count_if(F.col("pred").isNull()).alias("abstained"))


def cascade_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest 50 ties decided by a stand-in for a judge: the first class by name."""
    judge = lambda asked: asked.select("doc_id", F.least("a", "b").alias("pick"))
    out = classify.cascade(_distribution(spark, sf_dir), "doc_id", 0.01, 50, judge)
    return out.where("confidence = 0").groupBy("class").agg(F.count(F.lit(1)).alias("lost"))


def _sql() -> str:
    one = lambda table: " + ".join(f"ln(1 + len(regexp_extract_all(t, '{p.replace('(?dm)', '(?m)')}'))) * {w}" for p, w in table)
    cols = ", ".join(f"({one(table)}) AS {name}" for name, table in classify.CUES.items())
    names = list(classify.CUES)
    total = " + ".join(names)
    scored = ", ".join(f"{n} - (({total}) - {n}) * 0.15 AS {n}" for n in names)
    rows = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS class, {n} AS s FROM b" for n in names)
    return f"""WITH r AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS MATERIALIZED (SELECT doc_id, {cols} FROM r), b AS (SELECT doc_id, {scored} FROM a), l AS ({rows}),
x AS (SELECT *, exp((s - max(s) OVER (PARTITION BY doc_id)) / 2.0) AS e FROM l), p AS MATERIALIZED (SELECT doc_id, class, e / sum(e) OVER (PARTITION BY doc_id) AS confidence FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, class) AS n FROM p), g AS (SELECT doc_id, max(CASE WHEN n = 1 THEN class END) AS class, max(CASE WHEN n = 1 THEN confidence END) AS c1, max(CASE WHEN n = 2 THEN confidence END) AS c2 FROM k GROUP BY 1)
"""


_BASE = _sql()
_GOLD = "CASE lower(trim(source, ' ')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GOLD.items()) + " END"
_PRED = _BASE + f", q AS (SELECT {_GOLD} AS gold, CASE WHEN c1 >= 0.13 THEN class END AS pred FROM documents JOIN g USING (doc_id)), z AS (SELECT * FROM q WHERE gold IS NOT NULL)\n"
QUERIES = {f.__name__: f for f in (class_scores, domain_gate, class_profile, chunk_class_merge, confusion_matrix, class_accuracy, classifier_summary, routing_eval, cascade_classes)}
ORACLES = {
    "class_scores": _BASE + "SELECT doc_id, class, round(confidence, 6) AS confidence FROM p",
    "domain_gate": _BASE + "SELECT CASE WHEN c1 < 0.25 THEN 'abstain' WHEN c1 - c2 < 0.15 THEN 'multi' ELSE 'single' END AS decision, count(*) AS n FROM g GROUP BY 1",
    "class_profile": _BASE + "SELECT class, round(avg(confidence), 6) AS mean_confidence, count(*) AS files FROM p WHERE confidence > 0.1 GROUP BY 1",
    "chunk_class_merge": _BASE + ", o AS (SELECT origin, count(*) AS chunks FROM documents GROUP BY 1) SELECT d.origin, class, round(sum(confidence) / max(chunks), 6) AS confidence FROM p JOIN documents d USING (doc_id) JOIN o ON o.origin = d.origin WHERE confidence > 0.1 GROUP BY 1, 2",
    "confusion_matrix": _PRED + "SELECT gold, coalesce(pred, '(none)') AS pred, count(*) AS n FROM z GROUP BY 1, 2",
    "class_accuracy": _PRED + """, c AS (SELECT class, sum(g)::BIGINT AS gold, sum(p)::BIGINT AS predicted, sum(tp)::BIGINT AS tp FROM (SELECT gold AS class, 1 AS g, 0 AS p, coalesce((gold = pred)::INT, 0) AS tp FROM z UNION ALL SELECT pred, 0, 1, 0 FROM z WHERE pred IS NOT NULL) GROUP BY 1),
v AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS pr, CASE WHEN gold > 0 THEN tp / gold ELSE 0.0 END AS re FROM c)
SELECT class, gold, predicted, tp, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS f1 FROM v""",
    "classifier_summary": _PRED + """, gk AS (SELECT DISTINCT gold AS c FROM z), gt AS (SELECT c, count(*) FILTER (gold = c AND pred = c) AS tp, count(*) FILTER (gold = c) AS g, count(*) FILTER (pred = c) AS p FROM gk, z GROUP BY 1),
gf AS (SELECT CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * (tp / p) * (tp / g) / (tp / p + tp / g) END AS f1 FROM gt)
SELECT count(*) AS total, count(pred) AS predicted, count(*) FILTER (gold = pred) AS correct, round(count(*) FILTER (gold = pred) / count(*), 6) AS accuracy, round(count(pred) / count(*), 6) AS coverage, round((SELECT avg(f1) FROM gf), 6) AS macro_f1 FROM z""",
    "routing_eval": _PRED + "SELECT count(*) AS n, count(*) FILTER (gold = pred) AS exact, count(*) FILTER (pred IS NULL) AS abstained FROM z",
}
