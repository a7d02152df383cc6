"""Loaders of relation-extraction corpora: samples of (sample_id, text) and gold triples (sample_id, s, p, o)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _span(tokens, a, b):
    return F.array_join(F.slice(tokens, a + 1, b - a + 1), " ")


def token_spans(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines with sentence tokens and relations of four token positions and a type."""
    rows = spark.read.schema("doc_key string, sentence array<string>, relations array<array<string>>").json(path)
    rel = rows.select("doc_key", "sentence", F.explode("relations").alias("r"))
    n = lambda i: F.get("r", i).try_cast("int")
    triples = rel.select(F.col("doc_key").alias("sample_id"), _span(F.col("sentence"), n(0), n(1)).alias("s"), F.get("r", 4).alias("p"), _span(F.col("sentence"), n(2), n(3)).alias("o"))
    return rows.select(F.col("doc_key").alias("sample_id"), F.array_join("sentence", " ").alias("text")), triples


def document_clusters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A JSON array of documents with mention clusters; a cluster is named by its longest mention."""
    rows = spark.read.option("multiLine", True).schema("title string, sents array<array<string>>, vertexSet array<array<struct<name:string>>>, labels array<struct<r:string, h:int, t:int>>").json(path)
    longest = F.transform("vertexSet", lambda c: F.reduce(F.transform(c, lambda m: m["name"]), F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best)))
    named = rows.select(F.col("title").alias("sample_id"), F.array_join(F.flatten("sents"), " ").alias("text"), longest.alias("v"), "labels")
    triples = named.select("sample_id", "v", F.explode("labels").alias("l")).select("sample_id", F.get("v", F.col("l.h")).alias("s"), F.col("l.r").alias("p"), F.get("v", F.col("l.t")).alias("o"))
    return named.select("sample_id", "text"), triples


def clause_output(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines whose output is ``predicate: subject, object; ...``."""
    rows = spark.read.schema("input string, output string").json(path).withColumn("sample_id", F.sha1("input"))
    clause = rows.select("sample_id", F.explode(F.split("output", r";\s*")).alias("c"))
    part = lambda i: F.trim(F.regexp_extract("c", r"^([^:]+):\s*(.*?),\s*(.*)$", i))
    return rows.select("sample_id", F.col("input").alias("text")), clause.where(part(1) != "").select("sample_id", part(2).alias("s"), part(1).alias("p"), part(3).alias("o"))


def three_tables(spark: SparkSession, abstracts: str, entities: str, relations: str) -> tuple[DataFrame, DataFrame]:
    """Tab-separated abstracts, entities and relations whose arguments name entities of the same abstract."""
    read = lambda p, s: spark.read.schema(s).option("sep", "\t").csv(p)
    texts = read(abstracts, "sample_id string, title string, abstract string")
    ents = read(entities, "sample_id string, id string, type string, a int, b int, name string").select("sample_id", "id", "name")
    rels = read(relations, "sample_id string, p string, x string, y string").select("sample_id", "p", F.regexp_replace("x", "^Arg1:", "").alias("x"), F.regexp_replace("y", "^Arg2:", "").alias("y"))
    s, o = ents.select("sample_id", F.col("id").alias("x"), F.col("name").alias("s")), ents.select("sample_id", F.col("id").alias("y"), F.col("name").alias("o"))
    return texts.select("sample_id", F.concat_ws(" ", "title", "abstract").alias("text")), rels.join(s, ["sample_id", "x"]).join(o, ["sample_id", "y"]).select("sample_id", "s", "p", "o")


def annotated_passages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents with passages, annotations of identifiers (several parted by commas) and relations between identifiers."""
    schema = "documents array<struct<id:string, passages:array<struct<text:string, annotations:array<struct<infons:struct<identifier:string>, text:string>>>>, relations:array<struct<infons:struct<entity1:string, entity2:string, type:string>>>>>"
    docs = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("documents").alias("d")).select("d.*")
    marks = docs.select("id", F.explode("passages").alias("p")).select("id", F.explode("p.annotations").alias("a")).select("id", F.explode(F.split("a.infons.identifier", "[,;]")).alias("key"), F.col("a.text").alias("name"))
    names = marks.groupBy("id", "key").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("name"))
    rels = docs.select("id", F.explode("relations").alias("r")).select("id", F.col("r.infons.entity1").alias("x"), F.col("r.infons.type").alias("p"), F.col("r.infons.entity2").alias("y"))
    s, o = names.select("id", F.col("key").alias("x"), F.col("name").alias("s")), names.select("id", F.col("key").alias("y"), F.col("name").alias("o"))
    return docs.select(F.col("id").alias("sample_id"), F.array_join(F.transform("passages", lambda p: p["text"]), " ").alias("text")), rels.join(s, ["id", "x"]).join(o, ["id", "y"]).select(F.col("id").alias("sample_id"), "s", "p", "o")


def marked_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines of sentences with <e1> and <e2>; a label ending in (e2,e1) turns the pair round."""
    rows = spark.read.schema("sentence string, relation string").json(path).withColumn("sample_id", F.sha1("sentence"))
    e = lambda i: F.trim(F.regexp_extract("sentence", rf"<e{i}>(.*?)</e{i}>", 1))
    back = F.col("relation").endswith("(e2,e1)")
    triples = rows.select("sample_id", F.when(back, e(2)).otherwise(e(1)).alias("s"), F.regexp_replace("relation", r"\(e\d,e\d\)$", "").alias("p"), F.when(back, e(1)).otherwise(e(2)).alias("o"))
    return rows.select("sample_id", F.regexp_replace("sentence", r"</?e[12]>", "").alias("text")), triples


def grouped_sentences(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines of sentences of documents with relations as (subject, predicate, object)."""
    rows = spark.read.schema("doc_id string, sentence string, rel array<array<string>>").json(path)
    texts = rows.groupBy(F.col("doc_id").alias("sample_id")).agg(F.array_join(F.collect_list("sentence"), " ").alias("text"))
    r = rows.select(F.col("doc_id").alias("sample_id"), F.explode("rel").alias("r"))
    return texts, r.select("sample_id", F.get("r", 0).alias("s"), F.get("r", 1).alias("p"), F.get("r", 2).alias("o"))


def aligned_graphs(graphs: DataFrame, least: float = 0.5) -> DataFrame:
    """(sample_id, tool) whose entities occur in the essay: graphs (sample_id, tool, text, entities) below the share go."""
    hit = F.aggregate("entities", F.lit(0), lambda n, e: n + F.when(F.contains(F.lower("text"), F.lower(e)), 1).otherwise(0))
    share = F.coalesce(F.try_divide(hit, F.size("entities")), F.lit(0.0))
    return graphs.withColumn("overlap", share).where(F.col("overlap") >= least)


LOADERS = {"token-spans": token_spans, "clusters": document_clusters, "clauses": clause_output, "three-tables": three_tables, "passages": annotated_passages, "marked-pairs": marked_pairs, "sentences": grouped_sentences}
