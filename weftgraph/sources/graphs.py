"""Stored graphs back to entities, observations and relations, whatever notation their lines or documents have.

Accepted are line files with ``type`` (entity or relation), and JSON documents of one graph or a list of graphs.
Observations may be texts or objects, relation types a list or a text with commas. Defined results: lines and documents
that do not parse are left out, a missing name is empty, a missing type ``unknown``; an empty input gives empty tables.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Graph(NamedTuple):
    """Entities (name, entity_type, files, chunk, total_chunks), observations (name, ord, text, valid_at, source) and relations."""

    entities: DataFrame
    observations: DataFrame
    relations: DataFrame


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _normalised(entities: DataFrame, relations: DataFrame) -> Graph:
    """Variants ``v`` of entities and relations to the three tables."""
    e = F.col("v")
    named = entities.select("v", F.coalesce(_text(e, "$.name"), F.lit("")).alias("name"))
    ents = named.select(
        "name", F.coalesce(_text(e, "$.entityType"), F.lit("unknown")).alias("entity_type"), F.coalesce(F.try_variant_get(e, "$.files", "array<string>"), F.array().cast("array<string>")).alias("files"),
        F.try_variant_get(e, "$.chunk", "int").alias("chunk"), F.try_variant_get(e, "$.totalChunks", "int").alias("total_chunks"),
    )
    o = F.col("o")
    obs = named.select("name", F.posexplode(_list(e, "$.observations")).alias("ord", "o")).select(
        "name", "ord", F.when(_is_text(o), F.try_variant_get(o, "$", "string")).otherwise(_text(o, "$.text")).alias("text"), _text(o, "$.validAt").alias("valid_at"), _text(o, "$.source").alias("source")
    )
    written = F.filter(F.transform(F.split(_text(e, "$.relationType"), ","), lambda t: F.trim(t)), lambda t: t != "")
    types = F.coalesce(F.try_variant_get(e, "$.relationType", "array<string>"), F.when(_is_text(F.try_variant_get(e, "$.relationType", "variant")), written), F.array().cast("array<string>"))
    rels = relations.select(
        F.coalesce(_text(e, "$.from"), F.lit("")).alias("src"), F.coalesce(_text(e, "$.to"), F.lit("")).alias("dst"), types.alias("relation_type"), _text(e, "$.sourceSpan").alias("source_span"), _text(e, "$.validAt").alias("valid_at"), _text(e, "$.source").alias("source"),
        F.try_variant_get(e, "$.grounded", "boolean").alias("grounded"), F.try_variant_get(e, "$.groundingScore", "double").alias("grounding_score"), F.try_variant_get(e, "$.resolved", "boolean").alias("resolved"), _text(e, "$.faithfulness").alias("faithfulness"),
    )
    return Graph(ents, obs, rels)


def graph_of_lines(lines: DataFrame, line: str = "line") -> Graph:
    """The graph of a line file, one JSON object a line; lines of other types are left out."""
    parsed = lines.select(F.try_parse_json(F.trim(line)).alias("v")).where("v IS NOT NULL").withColumn("t", _text(F.col("v"), "$.type"))
    return _normalised(parsed.where("t = 'entity'").select("v"), parsed.where("t = 'relation'").select("v"))


def graph_of_documents(documents: DataFrame, text: str = "text") -> Graph:
    """The graph of whole JSON documents: one object with ``entities`` and ``relations``, or a list of such."""
    parsed = documents.select(F.try_parse_json(F.col(text)).alias("d")).where("d IS NOT NULL")
    graphs = parsed.select(F.explode(F.coalesce(F.try_variant_get("d", "$", "array<variant>"), F.array("d"))).alias("g"))
    part = lambda name: graphs.select(F.explode(_list(F.col("g"), f"$.{name}")).alias("v"))
    return _normalised(part("entities"), part("relations"))


def load_graph(spark, path: str) -> Graph:
    """The graph of a file: ``.jsonl`` and ``.mcp-jsonl`` by lines, ``.json`` whole; drawings (``.dot``) cannot be read back."""
    if path.lower().endswith(".dot"):
        raise ValueError("a drawing cannot be read back into a graph; export json or jsonl instead")
    if path.lower().endswith(("jsonl",)):
        return graph_of_lines(spark.read.text(path), "value")
    return graph_of_documents(spark.read.text(path, wholetext=True), "value")
