"""Queries on prose: terms, names, references, grounding of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import references as refs
from weftgraph.functions import text as tx
from weftgraph.operators import corpus
from weftgraph.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents", ("doc_id", "text", *more)).where(F.col("text").isNotNull())


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 most frequent terms of the corpus."""
    return corpus.top_terms(corpus.term_counts(_docs(spark, sf_dir), "text"), 200)


def proper_noun_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.explode(tx.proper_nouns(F.col("text"))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def entity_name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal name, digit signature, naming pattern, slug and type name of every canonical name."""
    names = table(spark, sf_dir, "merge_decisions", ("canonical",)).where(F.col("canonical").isNotNull()).distinct()
    c = F.col("canonical")
    return names.select("canonical", tx.normal_name(c).alias("normal"), tx.digit_signature(c).alias("digits"), tx.naming_pattern(c).alias("pattern"), tx.slug(c).alias("slug"), tx.snake_type(c).alias("snake"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(tx.sentences(F.col("text"))).alias("n_sentences"))


def keyword_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each raw transcript (claim) against its corrected text (source), and whether it is grounded."""
    rows = table(spark, sf_dir, "recua_turns", ("row_id", "corrected", "parakeet")).where("corrected IS NOT NULL AND parakeet IS NOT NULL").distinct()
    score = tx.keyword_score(F.col("parakeet"), F.col("corrected"))
    return rows.select("row_id", F.round(score, 6).alias("score"), (score >= 0.5).alias("grounded"))


def hallucination_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of claims per language whose speaker's words are not grounded in the corrected text."""
    rows = table(spark, sf_dir, "recua_turns", ("row_id", "corrected", "whisper", "lang")).where("corrected IS NOT NULL AND whisper IS NOT NULL").distinct()
    score = tx.keyword_score(F.col("whisper"), F.col("corrected"))
    return rows.groupBy("lang").agg(F.round(F.avg((score < 0.9).cast("double")), 6).alias("ungrounded"), F.count(F.lit(1)).alias("claims"))


def cooccurrence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run, matched names whose span (the canonical name) holds every surface form."""
    rows = table(spark, sf_dir, "merge_decisions", ("merge_decision_id", "run_id", "canonical", "surface_forms")).distinct()
    pair = rows.select("run_id", "canonical", F.explode("surface_forms").alias("form"))
    kept = pair.where(tx.endpoints_in(F.col("canonical"), F.col("form"), F.col("form")))
    return kept.groupBy("run_id").agg(F.count(F.lit(1)).alias("kept"))


def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets of Markdown files."""
    rows = table(spark, sf_dir, "md_contents", ("content_id", "text")).where("text IS NOT NULL").distinct()
    return rows.select("content_id", F.explode(refs.links(F.col("text"))).alias("target"))


def external_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of Markdown files to other hosts, with whether a gate lets them through."""
    rows = table(spark, sf_dir, "md_contents", ("content_id", "text")).where("text IS NOT NULL").distinct()
    urls = rows.select(F.explode(F.regexp_extract_all("text", F.lit(r"https?://[a-z.]+/[a-z0-9/-]+"), F.lit(0))).alias("url"))
    out = urls.where(refs.is_external(F.col("url"))).select(refs.host_of(F.col("url")).alias("host"), refs.url_allowed(F.col("url"), ["example"], ["https://berzet.example/"]).alias("allowed"))
    return out.groupBy("host", "allowed").agg(F.count(F.lit(1)).alias("n"))


def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, paragraph and link counts, words and reading time of every page."""
    h = F.col("html")
    words = F.size(F.filter(F.split(F.regexp_replace("clean_text", r"\s+", " "), " "), lambda w: w != ""))
    rows = table(spark, sf_dir, "html_results", ("page_id", "html", "clean_text")).where("html IS NOT NULL AND clean_text IS NOT NULL").distinct()
    return rows.select("page_id", F.regexp_extract(h, r"(?i)<title>([^<]*)</title>", 1).alias("title"), F.regexp_count(h, F.lit(r"(?i)<p[ >]")).alias("paragraphs"), F.regexp_count(h, F.lit(r"(?i)<a ")).alias("links"), words.alias("words"), F.ceil(words / 200).cast("int").alias("minutes"))


def locator_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locators of chunks and rows, parsed."""
    rows = table(spark, sf_dir, "checkpoints", ("cp_key", "chunk_index")).distinct()
    text = F.when(F.col("chunk_index") % 2 == 0, F.concat(F.lit("p."), F.col("chunk_index"))).when(F.col("chunk_index") % 3 == 0, F.concat(F.lit("table:t/row:"), F.col("chunk_index"))).otherwise("gps")
    return rows.select("cp_key", refs.locator(text).alias("l")).select("cp_key", "l.kind", F.coalesce("l.page", F.lit(0)).alias("page"), F.coalesce("l.table", F.lit("")).alias("table"), F.coalesce("l.key", F.lit("")).alias("key"))


def checkpoint_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resume key of every finished chunk: SHA-1 of where it came from and what made it."""
    rows = table(spark, sf_dir, "checkpoints", ("cp_key", "file_path", "chunk_index", "model_id", "prompt_version")).distinct()
    return rows.select("cp_key", F.sha1(F.concat_ws(" ", "file_path", F.col("chunk_index").cast("string"), "model_id", "prompt_version")).alias("key"))


_WORDS = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_OPENERS = "|".join(tx.LEADING_WORDS)
_PROPER = rf"list_filter(list_transform(regexp_extract_all(text, '\b[A-Z][A-Za-z0-9''’]+(?:[ \t\n\f\r\x0B]+[A-Z][A-Za-z0-9''’]+){{1,3}}\b'), lambda r: regexp_replace(regexp_replace(r, '(?i)^(?:(?:{_OPENERS})\s+)+', ''), '[ \t\n\f\r\x0B]+', ' ', 'g')), lambda r: contains(r, ' '))"
QUERIES = {f.__name__: f for f in (term_frequency, proper_noun_runs, entity_name_forms, sentence_counts, keyword_grounding, hallucination_share, cooccurrence_gate, document_links, external_hosts, page_meta, locator_parse, checkpoint_keys)}
_SCORE = r"(SELECT CASE WHEN count(*) = 0 THEN 1.0 ELSE sum(contains(lower(corrected), w)::INT) / count(*) END FROM (SELECT unnest(string_split_regex(lower({0}), '[\s\x{{A0}}\x{{FEFF}}]+')) AS w) WHERE length(w) > 3)"
ORACLES = {
    "term_frequency": rf"""WITH w AS (SELECT unnest(list_concat({_PROPER}, list_filter(regexp_extract_all(lower(text), '[a-z0-9](?:[a-z0-9''’_-]*[a-z0-9])?'), lambda x: length(x) >= 3 AND NOT regexp_matches(x, '^[0-9]+$') AND x NOT IN ({_WORDS})))) AS term FROM documents WHERE text IS NOT NULL)
SELECT term, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, term LIMIT 200""",
    "proper_noun_runs": f"SELECT name, count(*) AS n FROM (SELECT unnest({_PROPER}) AS name FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "entity_name_forms": r"""SELECT canonical, trim(regexp_replace(lower(canonical), '[_\-\x{2010}-\x{2015}\s\x{A0}\x{FEFF}]+', ' ', 'g')) AS normal, array_to_string(regexp_extract_all(canonical, '\d+'), ',') AS digits,
  CASE WHEN regexp_matches(canonical, '^[a-z][a-z0-9_]*$') THEN 'snake_case' WHEN regexp_matches(canonical, '^[a-z][a-zA-Z0-9]*$') THEN 'camelCase' WHEN regexp_matches(canonical, '^[A-Z][a-zA-Z0-9]*$') THEN 'PascalCase' ELSE 'other' END AS pattern,
  coalesce(nullif(substr(regexp_replace(regexp_replace(lower(canonical), '[^a-z0-9_]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'entity') AS slug, regexp_replace(regexp_replace(lower(trim(canonical)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS snake
  FROM (SELECT DISTINCT canonical FROM merge_decisions WHERE canonical IS NOT NULL)""",
    "keyword_grounding": "SELECT row_id, round(s, 6) AS score, s >= 0.5 AS grounded FROM (SELECT row_id, " + _SCORE.format("parakeet") + " AS s FROM (SELECT DISTINCT row_id, corrected, parakeet FROM recua_turns WHERE corrected IS NOT NULL AND parakeet IS NOT NULL))",
    "hallucination_share": "SELECT lang, round(avg((s < 0.9)::INT), 6) AS ungrounded, count(*) AS claims FROM (SELECT lang, " + _SCORE.format("whisper") + " AS s FROM (SELECT DISTINCT row_id, corrected, whisper, lang FROM recua_turns WHERE corrected IS NOT NULL AND whisper IS NOT NULL)) GROUP BY 1",
    "cooccurrence_gate": "SELECT run_id, count(*) AS kept FROM (SELECT run_id, canonical, unnest(surface_forms) AS form FROM (SELECT DISTINCT merge_decision_id, run_id, canonical, surface_forms FROM merge_decisions)) WHERE canonical IS NULL OR contains(lower(canonical), lower(form)) GROUP BY 1",
    "external_hosts": r"""SELECT host, host NOT IN ('berzet.example') AS allowed, count(*) AS n FROM (SELECT regexp_extract(u, 'https?://([^/]+)', 1) AS host FROM (SELECT unnest(regexp_extract_all(text, 'https?://[a-z.]+/[a-z0-9/-]+')) AS u FROM (SELECT DISTINCT content_id, text FROM md_contents WHERE text IS NOT NULL))) GROUP BY 1, 2""",
    "page_meta": r"""SELECT page_id, regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<p[ >]')) AS paragraphs, len(regexp_extract_all(html, '(?i)<a ')) AS links,
  len(list_filter(string_split_regex(clean_text, '\s+'), lambda w: w <> '')) AS words, ceil(len(list_filter(string_split_regex(clean_text, '\s+'), lambda w: w <> '')) / 200)::INT AS minutes FROM (SELECT DISTINCT page_id, html, clean_text FROM html_results WHERE html IS NOT NULL AND clean_text IS NOT NULL)""",
    "locator_parse": """SELECT cp_key, CASE WHEN chunk_index % 2 = 0 THEN 'page' WHEN chunk_index % 3 = 0 THEN 'row' ELSE 'gps' END AS kind, CASE WHEN chunk_index % 2 = 0 THEN coalesce(chunk_index, 0) ELSE 0 END AS page,
  CASE WHEN chunk_index % 2 <> 0 AND chunk_index % 3 = 0 THEN 't' ELSE '' END AS "table", CASE WHEN chunk_index % 2 <> 0 AND chunk_index % 3 = 0 THEN chunk_index::VARCHAR ELSE '' END AS key FROM (SELECT DISTINCT cp_key, chunk_index FROM checkpoints)""",
    "checkpoint_keys": "SELECT cp_key, sha1(concat_ws(' ', file_path, chunk_index::VARCHAR, model_id, prompt_version)) AS key FROM (SELECT DISTINCT cp_key, file_path, chunk_index, model_id, prompt_version FROM checkpoints)",
}


def reference_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and citations between Markdown files."""
    from weftgraph.operators.links import reference_graph as build

    return build(table(spark, sf_dir, "md_contents", ("file_path", "text")), "file_path", "text")


QUERIES["reference_graph"] = reference_graph
