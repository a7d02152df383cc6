"""Queries on turns, chunks, segments and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import packing, seams
from weftgraph.sources import documents
from weftgraph.sources.tables import table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "turns").dropDuplicates(["turn_id"])


def turn_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed turns: lines and lengths of every pack."""
    return packing.pack_turns(_turns(spark, sf_dir)).select("source_path", "conversation", "pack_no", "n_lines", F.length("content").alias("chars"), "speaker")


def speaker_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by how many speakers they have."""
    t = _turns(spark, sf_dir).groupBy("source_path", F.coalesce("conversation", F.lit(-1)).alias("conversation")).agg(F.count_distinct("speaker").alias("speakers"), F.count(F.lit(1)).alias("turns"))
    return t.groupBy("speakers").agg(F.count(F.lit(1)).alias("conversations"), F.sum("turns").alias("turns"))


def turn_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).select("turn_id", "source_path", F.coalesce("turn_no", F.lit(0)).alias("turn_no"))
    return packing.reindexed(t, ["source_path"], ["turn_no", "turn_id"]).select("turn_id", "idx", "total")


def running_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each turn begins in its source if texts are laid end to end with an overlap of 100."""
    t = _turns(spark, sf_dir).where("text IS NOT NULL").select("turn_id", "source_path", F.coalesce("turn_no", F.lit(0)).alias("turn_no"), F.col("text").alias("content"))
    return packing.running_offsets(packing.reindexed(t, ["source_path"], ["turn_no", "turn_id"]), "source_path").select("turn_id", "start", "end")


def recursive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document."""
    return packing.split_texts(table(spark, sf_dir, "documents", ("doc_id", "text")), "doc_id", "text").select("doc_id", "idx", "total", F.length("content").alias("chars"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "recua_turns", ("row_id", "recording_id", "start_s", "end_s", "speaker")).where("recording_id IS NOT NULL AND start_s < end_s").dropDuplicates(["row_id"])
    return rows.select("recording_id", F.col("row_id").alias("seg"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), "speaker")


def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.closed_gaps(_segments(spark, sf_dir), "recording_id", 0.3)


def silence_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.silences(_segments(spark, sf_dir), "recording_id")


def segment_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments without a proper label with the labelled turn that overlaps them most."""
    s = _segments(spark, sf_dir)
    good = F.coalesce(F.col("speaker").rlike(r"^SPEAKER_[0-9]{2}$"), F.lit(False))
    return packing.overlap_join(s.where(~good), s.where(good).withColumnRenamed("seg", "turn"), "recording_id").select("recording_id", "seg", "turn", F.round("overlap", 4).alias("overlap"))


def domain_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three documents of every source."""
    docs = table(spark, sf_dir, "documents", ("doc_id", "source")).where("source IS NOT NULL")
    return packing.capped_per_group(docs, ["source"], ["doc_id"], 3)


def reader_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the checkpoints by the reader that takes them."""
    rows = table(spark, sf_dir, "checkpoints", ("file_path",)).where("file_path IS NOT NULL").distinct()
    return rows.groupBy(documents.reader_of(F.col("file_path")).alias("reader")).agg(F.count(F.lit(1)).alias("n"))


def directory_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "checkpoints", ("file_path",)).where("file_path IS NOT NULL").distinct()
    return documents.directory_tree(rows.select(F.col("file_path").alias("path"))).select("parent", "name", "is_dir")


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read from their markup."""
    rows = table(spark, sf_dir, "html_results", ("page_id", "html")).where("html IS NOT NULL").dropDuplicates(["page_id"])
    return documents.html_pages(rows, "page_id", "html").select("page_id", "title", "words", "minutes", "links", "paragraphs")


def rule_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and neighbouring pairs that the default extractor finds in each source of documents."""
    docs = table(spark, sf_dir, "documents", ("doc_id", "text", "source"))
    chunks = docs.select(F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"))
    e = seams.rule_entities(chunks).groupBy("chunk_id").agg(F.count_distinct("name").alias("names"))
    r = seams.rule_relations(chunks).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("pairs"))
    return e.join(r, "chunk_id", "left").select(F.col("chunk_id").alias("source"), "names", F.coalesce("pairs", F.lit(0)).alias("pairs"))


_T = "WITH t AS (SELECT turn_id, any_value(source_path) AS source_path, any_value(conversation) AS conversation, coalesce(any_value(turn_no), 0) AS turn_no, any_value(speaker) AS speaker, any_value(text) AS text FROM turns GROUP BY 1)\n"
_S = "WITH s AS (SELECT row_id AS seg, any_value(recording_id) AS recording_id, any_value(start_s) AS start, any_value(end_s) AS \"end\", any_value(speaker) AS speaker FROM recua_turns WHERE recording_id IS NOT NULL AND start_s < end_s GROUP BY 1)\n"
QUERIES = {f.__name__: f for f in (turn_pack, speaker_purity, turn_reindex, running_offset, recursive_split, merged_segments, silence_intervals, segment_speakers, domain_cap, reader_dispatch, directory_tree, html_pages, rule_extraction)}
ORACLES = {
    "speaker_purity": _T + ", c AS (SELECT source_path, coalesce(conversation, -1) AS c, count(DISTINCT speaker) AS speakers, count(*) AS turns FROM t GROUP BY 1, 2) SELECT speakers, count(*) AS conversations, sum(turns)::BIGINT AS turns FROM c GROUP BY 1",
    "turn_reindex": _T + "SELECT turn_id, row_number() OVER (PARTITION BY source_path ORDER BY turn_no, turn_id) AS idx, count(*) OVER (PARTITION BY source_path) AS total FROM t",
    "running_offset": _T + ", i AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY turn_no, turn_id) AS idx FROM t WHERE text IS NOT NULL), o AS (SELECT turn_id, length(text) AS n, (coalesce(sum(length(text)) OVER (PARTITION BY source_path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - greatest(idx - 2, 0) * 100)::BIGINT AS start FROM i) SELECT turn_id, start, start + n AS \"end\" FROM o",
    "merged_segments": _S + ", n AS (SELECT *, CASE WHEN start - lag(\"end\") OVER w <= 0.3 THEN 0 ELSE 1 END AS x FROM s WINDOW w AS (PARTITION BY recording_id ORDER BY start, \"end\")), i AS (SELECT *, sum(x) OVER (PARTITION BY recording_id ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS i FROM n) SELECT recording_id, min(start) AS start, arg_max(\"end\", row(start, \"end\")) AS \"end\" FROM i GROUP BY recording_id, i",
    "silence_intervals": _S + ", n AS (SELECT recording_id, max(\"end\") OVER (PARTITION BY recording_id ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, start AS b FROM s) SELECT recording_id, a AS start, b AS \"end\" FROM n WHERE a < b",
    "segment_speakers": _S + ", g AS (SELECT * FROM s WHERE regexp_full_match(speaker, 'SPEAKER_[0-9]{2}')), o AS (SELECT x.recording_id, x.seg, g.seg AS turn, least(x.\"end\", g.\"end\") - greatest(x.start, g.start) AS v, g.start AS gs FROM s x JOIN g ON g.recording_id = x.recording_id AND x.start < g.\"end\" AND g.start < x.\"end\" WHERE NOT coalesce(regexp_full_match(x.speaker, 'SPEAKER_[0-9]{2}'), false)) SELECT recording_id, seg, arg_max(turn, row(v, -gs, -turn)) AS turn, round(max(v), 4) AS overlap FROM o GROUP BY 1, 2",
    "domain_cap": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IS NOT NULL) WHERE k <= 3",
    "reader_dispatch": r"SELECT CASE WHEN regexp_matches(p, '(?i)\.(md|markdown|mdx)$') THEN 'markdown' WHEN regexp_matches(p, '(?i)\.(html?|xhtml)$') THEN 'html' WHEN regexp_matches(p, '(?i)\.(tex|latex)$') THEN 'latex' WHEN regexp_matches(p, '(?i)\.ipynb$') THEN 'notebook' WHEN regexp_matches(p, '(?i)\.epub$') THEN 'epub' WHEN regexp_matches(p, '(?i)\.jsonl?$') THEN 'json' WHEN regexp_matches(p, '(?i)\.(eml|mbox)$') THEN 'mail' WHEN regexp_matches(p, '(?i)\.(srt|vtt)$') THEN 'subtitle' WHEN regexp_matches(p, '(?i)\.(txt|py|csv|ts|js)$') THEN 'text' ELSE 'skip' END AS reader, count(*) AS n FROM (SELECT DISTINCT file_path AS p FROM checkpoints WHERE file_path IS NOT NULL) GROUP BY 1",
    "directory_tree": "WITH p AS (SELECT DISTINCT string_split(file_path, '/') AS p FROM checkpoints WHERE file_path IS NOT NULL), e AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM p) SELECT DISTINCT array_to_string(p[1:i - 1], '/') AS parent, p[i] AS name, i < len(p) AS is_dir FROM e",
}
