"""Graphs to export formats, as DataFrames of lines or rows.

Inputs: entities(name, entity_type, ord), observations(name, ord, text, ...), relations(src, dst, relation_type, ord).
Order is that of ``ord``, which callers carry; nothing relies on row order. Names in JSON are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.text import hashed_uuid, slug, upper_snake


def kb_triples(observations: DataFrame, relations: DataFrame, min_score: float | None = None) -> DataFrame:
    """(name, property, value): one description per entity, one value per (entity, predicate), parts distinct in order."""
    obs = observations
    if min_score is not None:
        obs = obs.where(F.col("grounding_score").isNull() | (F.col("grounding_score") >= min_score))
    said = obs.select("name", F.lit("description").alias("property"), F.col("ord").cast("long").alias("ord"), F.trim("text").alias("value"))
    linked = relations.select(F.col("src").alias("name"), F.explode("relation_type").alias("property"), F.col("ord").cast("long").alias("ord"), F.trim("dst").alias("value")).where("property <> ''")
    # First mention per value before the lists are built: what a group gathers is its distinct values only.
    first = said.unionByName(linked).where("value <> ''").groupBy("name", "property", "value").agg(F.min("ord").alias("ord"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"])
    joined = F.when(F.col("property") == "description", F.array_join(values, "; ")).otherwise(F.array_join(values, ", "))
    return first.groupBy("name", "property").agg(joined.alias("value"))


def kblam(triples: DataFrame) -> DataFrame:
    n, p, v = F.col("name"), F.col("property"), F.col("value")
    key = F.concat(F.lit("The "), p, F.lit(" of "), n)
    return triples.select("name", p.alias("description_type"), v.alias("description"), F.concat(F.lit("What is the "), p, F.lit(" of "), n, F.lit("?")).alias("Q"), F.concat(key, F.lit(" is "), v, F.lit(".")).alias("A"), key.alias("key_string"))


def lora(triples: DataFrame) -> DataFrame:
    """One chat example per triple, as a JSON line."""
    qa = kblam(triples)
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return qa.select("name", F.col("description_type").alias("property"), F.to_json(F.struct(F.array(message("user", "Q"), message("assistant", "A")).alias("messages"))).alias("line"))


def jsonl(entities: DataFrame, observations: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, ord, line): entity lines, then relation lines, ``type`` first."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    gathered = observations.groupBy("name").agg(texts.alias("observations"))
    e = entities.join(gathered, "name", "left").select(F.lit(0).alias("kind"), "ord", F.to_json(F.struct(F.lit("entity").alias("type"), "name", F.col("entity_type").alias("entityType"), F.coalesce("observations", F.array().cast("array<string>")).alias("observations"))).alias("line"))
    r = relations.select(F.lit(1).alias("kind"), "ord", F.to_json(F.struct(F.lit("relation").alias("type"), F.col("src").alias("from"), F.col("dst").alias("to"), F.col("relation_type").alias("relationType"))).alias("line"))
    return e.unionByName(r)


def json_document(entities: DataFrame, observations: DataFrame, relations: DataFrame) -> DataFrame:
    """(part, ord, line): lines that, in this order, are one JSON document of the whole graph; no row holds more than one node."""
    lines = jsonl(entities, observations, relations).withColumn("line", F.regexp_replace("line", r'^\{"type":"(?:entity|relation)",', "{"))
    last = lines.groupBy("kind").agg(F.max(F.struct("ord", "line")).alias("last"))
    body = lines.join(last, "kind").select((2 * F.col("kind") + 1).alias("part"), F.col("ord").cast("string").alias("ord"), F.when(F.struct("ord", "line") == F.col("last"), F.col("line")).otherwise(F.concat("line", F.lit(","))).alias("line"))
    frame = entities.sparkSession.createDataFrame([(0, "", '{"entities":['), (2, "", '],"relations":['), (4, "", "]}")], "part int, ord string, line string")
    return frame.unionByName(body)


def mcp_relations(relations: DataFrame) -> DataFrame:
    """Relation lines with types joined by commas; provenance only where set."""
    extra = [F.col(c) for c in ("resolved", "faithfulness") if c in relations.columns]
    return relations.select("ord", F.to_json(F.struct(F.lit("relation").alias("type"), F.col("src").alias("from"), F.col("dst").alias("to"), F.array_join("relation_type", ",").alias("relationType"), *extra)).alias("line"))


def from_mcp(lines: DataFrame) -> DataFrame:
    """Relation lines back to (src, dst, relation_type); lines that do not parse are dropped."""
    parsed = F.from_json("line", "type string, `from` string, `to` string, relationType string")
    rows = lines.select(parsed.alias("r")).where("r.type = 'relation' AND r.`from` IS NOT NULL")
    return rows.select(F.col("r.from").alias("src"), F.col("r.to").alias("dst"), F.filter(F.transform(F.split("r.relationType", ","), lambda t: F.trim(t)), lambda t: t != "").alias("relation_type"))


def graphiti_nodes(entities: DataFrame, observations: DataFrame, relations: DataFrame, now: str) -> DataFrame:
    """(uuid, name, summary, label, created_at) of entities and of ends that no entity has."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    created = F.min("created_at") if "created_at" in observations.columns else F.lit(None).cast("string")
    ten = observations.withColumn("k", F.row_number().over(W.partitionBy("name").orderBy("ord")))
    summary = ten.where("k <= 10").groupBy("name").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("summary"))
    times = observations.groupBy("name").agg(created.alias("created"))
    ends = relations.where(F.size("relation_type") > 0).select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    ghosts = ends.join(entities.select("name"), "name", "left_anti").select("name", F.lit(None).cast("string").alias("entity_type"))
    nodes = entities.select("name", "entity_type").unionByName(ghosts).join(summary, "name", "left").join(times, "name", "left")
    return nodes.select(hashed_uuid(F.col("name")).alias("uuid"), "name", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("entity_type", F.lit("")).alias("label"), F.coalesce("created", F.lit(now)).alias("created_at"))


def graphiti_edges(relations: DataFrame) -> DataFrame:
    """One edge per predicate: (uuid, name, fact, source_node_uuid, target_node_uuid)."""
    e = relations.select("src", "dst", F.explode("relation_type").alias("t")).where("t <> ''")
    s, t, d = F.col("src"), F.col("t"), F.col("dst")
    return e.select(hashed_uuid(F.concat_ws("|", s, t, d)).alias("uuid"), upper_snake(t).alias("name"), F.concat_ws(" ", s, t, d).alias("fact"), hashed_uuid(s).alias("source_node_uuid"), hashed_uuid(d).alias("target_node_uuid"))


def dot_lines(entities: DataFrame, relations: DataFrame, cluster: str | None = None) -> DataFrame:
    """(part, ord, line) of a DOT graph; clusters only where a group has more than one member."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '\\\\\\\\"'), F.lit('"'))
    nodes = entities.select(F.lit(1).alias("part"), "ord", F.concat(F.lit("  "), quote(F.col("name")), F.lit(' [label="'), F.regexp_replace("name", '"', "'"), F.lit("\\n"), F.col("entity_type"), F.lit('"];')).alias("line"))
    edges = relations.select(F.lit(3).alias("part"), "ord", F.concat(F.lit("  "), quote(F.col("src")), F.lit(" -> "), quote(F.col("dst")), F.lit(' [label="'), F.array_join("relation_type", ", "), F.lit('"];')).alias("line"))
    out = nodes.unionByName(edges)
    if cluster:
        members = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: quote(x["name"]))
        groups = entities.groupBy(F.col(cluster).alias("g")).agg(members.alias("m"), F.min("ord").alias("ord")).where(F.size("m") > 1)
        out = out.unionByName(groups.select(F.lit(2).alias("part"), "ord", F.concat(F.lit("  subgraph "), quote(F.concat(F.lit("cluster_"), F.col("g"))), F.lit(" { "), F.array_join("m", "; "), F.lit(" }")).alias("line")))
    return out


def short_label(text: Column, limit: int = 40) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def markdown_pages(entities: DataFrame, observations: DataFrame, relations: DataFrame) -> DataFrame:
    """(path, content): one page per entity with its facts and relations both ways; paths are unique slugs."""
    facts = observations.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("- "), F.col("text")).alias("l")))).alias("facts"))
    label = F.array_join("relation_type", ", ")
    out = relations.select(F.col("src").alias("name"), F.lit(0).alias("way"), "ord", F.concat(F.lit("- **"), label, F.lit("** → "), F.col("dst")).alias("l"))
    into = relations.where("src <> dst").select(F.col("dst").alias("name"), F.lit(1).alias("way"), "ord", F.concat(F.lit("- "), F.col("src"), F.lit(" **"), label, F.lit("** →")).alias("l"))
    links = out.unionByName(into).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("way", "ord", "l"))).alias("links"))
    block = lambda title, c: F.when(F.coalesce(F.size(c), F.lit(-1)) > 0, F.concat(F.lit(f"\n\n## {title}\n\n"), F.array_join(F.transform(c, lambda x: x["l"]), "\n"))).otherwise("")
    n = F.row_number().over(W.partitionBy("base").orderBy("ord"))
    based = entities.withColumn("base", slug(F.col("name"))).withColumn("n", n)
    path = F.concat(F.col("base"), F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(""), F.lit(".md"))
    page = F.concat(F.lit("# "), F.col("name"), F.lit("\n\n- **Type:** "), F.col("entity_type"), block("Facts", F.col("facts")), block("Relations", F.col("links")), F.lit("\n"))
    return based.join(facts, "name", "left").join(links, "name", "left").select(path.alias("path"), page.alias("content"))


FORMATS: dict[str, Callable] = {"jsonl": jsonl, "kblam": kblam, "lora": lora, "graphiti-edges": graphiti_edges, "graphiti-nodes": graphiti_nodes, "mcp-jsonl": mcp_relations, "dot": dot_lines, "openwebui": markdown_pages, "kb": kb_triples}


def exporter(name: str) -> Callable:
    """The writer of a format; unknown names are an error that lists the known ones."""
    if name not in FORMATS:
        raise ValueError(f"unsupported format {name!r}; known: {', '.join(sorted(FORMATS))}")
    return FORMATS[name]


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Text files whose lines follow ``order`` within and across files."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)
