"""Queries of problem 9 (shared spans)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.spans import document_pairs, shared_spans
from weftgraph.sources.tables import table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with an identical run of at least 200 characters."""
    return document_pairs(table(spark, sf_dir, "documents", ("doc_id", "text")))


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared stretches of every document."""
    return shared_spans(table(spark, sf_dir, "documents", ("doc_id", "text")))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document how many of its characters occur elsewhere in shared runs."""
    documents = table(spark, sf_dir, "documents", ("doc_id", "text"))
    spans = shared_spans(documents).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("begin")).alias("shared_chars"), F.count(F.lit(1)).alias("n_spans"))
    sizes = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")).distinct()
    joined = sizes.join(spans, "doc_id", "left")
    shared = F.coalesce("shared_chars", F.lit(0))
    return joined.select("doc_id", "n_chars", shared.alias("shared_chars"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce(F.try_divide(shared, F.col("n_chars")), F.lit(0.0)).alias("share"))


QUERIES = {"p9_found": p9_found, "p9_spans": p9_spans, "p9_shares": p9_shares}
# Every window of 200 characters of every text, by its hash.
_WINDOWS = r"""
WITH d AS (SELECT doc_id, any_value(text) AS t FROM documents WHERE length(text) >= 200 AND doc_id IS NOT NULL GROUP BY 1),
w AS (SELECT doc_id, i, hash(substr(t, i, 200)) AS h FROM (SELECT doc_id, t, unnest(range(1, length(t) - 198)) AS i FROM d)),
k AS (SELECT DISTINCT doc_id, h FROM w),
m AS (SELECT h FROM k GROUP BY 1 HAVING count(*) > 1),
p AS (SELECT DISTINCT w.doc_id, w.i FROM w JOIN m ON w.h = m.h),
q AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM p),
g AS (SELECT doc_id, i, sum(CASE WHEN before >= i - 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM q),
s AS (SELECT doc_id, min(i) - 1 AS "begin", max(i) + 199 AS "end" FROM g GROUP BY doc_id, span)
"""

ORACLES = {
    "p9_found": _WINDOWS + "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN m ON a.h = m.h JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p9_spans": _WINDOWS + 'SELECT doc_id, "begin", "end" FROM s',
    "p9_shares": _WINDOWS
    + """, z AS (SELECT doc_id, sum("end" - "begin")::BIGINT AS shared_chars, count(*) AS n_spans FROM s GROUP BY 1),
n AS (SELECT DISTINCT doc_id, coalesce(length(text), 0) AS n_chars FROM documents)
SELECT n.doc_id, n_chars, coalesce(shared_chars, 0)::BIGINT AS shared_chars, coalesce(n_spans, 0) AS n_spans, CASE WHEN n_chars > 0 THEN coalesce(shared_chars, 0) / n_chars ELSE 0.0 END AS share FROM n LEFT JOIN z ON z.doc_id = n.doc_id""",
}
