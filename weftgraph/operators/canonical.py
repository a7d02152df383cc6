"""Clusters of names and of relation labels folded into one canonical form each.

A cluster table says which names (or labels) belong together, whoever made it (linkage over embeddings, groups of
matches, a judge). The canonical name is the one with the highest score, the canonical label the most frequent one; ties
go to the smaller text. Names without a cluster stay as they are; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph import dedup_relations, degrees


def canonical_of(members: DataFrame, score: str) -> DataFrame:
    """(member, canonical) of members (member, cluster, score): the best of each cluster, the smaller text among equals."""
    best = members.groupBy("cluster").agg(F.max(score).alias("__s"))
    top = members.join(best, "cluster").where(F.col(score) == F.col("__s")).groupBy("cluster").agg(F.min("member").alias("canonical"))
    return members.join(top, "cluster").select("member", "canonical")


def entity_renames(entities: DataFrame, clusters: DataFrame, relations: DataFrame | None = None, observations: DataFrame | None = None) -> DataFrame:
    """(member, canonical): scored by degree if ``relations`` are given, else by the number of observations."""
    if relations is not None:
        scores = degrees(entities, relations).select("name", F.col("degree").alias("score"))
    else:
        scores = observations.groupBy("name").agg(F.count(F.lit(1)).alias("score"))
    named = clusters.join(entities.select("name").distinct(), "name", "left_semi").join(scores, "name", "left")
    return canonical_of(named.select(F.col("name").alias("member"), "cluster", F.coalesce("score", F.lit(0)).alias("score")), "score")


def fold_entities(entities: DataFrame, renames: DataFrame) -> DataFrame:
    """(name, entity_type, files): the canonical entity of each cluster with the files of all its members."""
    joined = entities.join(renames, entities["name"] == renames["member"], "left").withColumn("canonical", F.coalesce("canonical", "name"))
    own = F.col("name") == F.col("canonical")
    files = F.array_sort(F.array_distinct(F.flatten(F.collect_set("files"))))
    return joined.groupBy("canonical").agg(F.max(F.when(own, F.col("entity_type"))).alias("entity_type"), files.alias("files")).withColumnRenamed("canonical", "name")


def rename_relations(relations: DataFrame, renames: DataFrame, order: list[str]) -> DataFrame:
    """Edges between canonical names, without self-loops, equal ones once (the first by ``order``)."""
    a, b = renames.select(F.col("member").alias("__s"), F.col("canonical").alias("__a")), renames.select(F.col("member").alias("__d"), F.col("canonical").alias("__b"))
    joined = relations.join(a, relations["src"] == a["__s"], "left").join(b, relations["dst"] == b["__d"], "left")
    return dedup_relations(joined.withColumns({"src": F.coalesce("__a", "src"), "dst": F.coalesce("__b", "dst")}).drop("__s", "__a", "__d", "__b"), order)


def label_renames(relations: DataFrame, clusters: DataFrame) -> DataFrame:
    """(member, canonical) of relation labels in clusters (label, cluster): the most frequent label of each."""
    counts = relations.select(F.explode("relation_type").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("score"))
    named = clusters.join(counts, "label").select(F.col("label").alias("member"), "cluster", "score")
    return canonical_of(named, "score")


def rename_labels(relations: DataFrame, renames: DataFrame) -> DataFrame:
    """Edges with canonical labels, each once in the order written; labels are few, edges are not, so the labels meet as a map.

    The map holds one entry per label of a closed vocabulary; it is aggregated to one row and read as a scalar.
    """
    table = renames.where("member <> canonical").agg(F.map_from_entries(F.collect_list(F.struct("member", "canonical"))).alias("m"))
    mapped = relations.withColumn("__m", table.scalar())
    labels = F.transform("relation_type", lambda t: F.coalesce(F.try_element_at("__m", t), t))
    return mapped.withColumn("relation_type", F.array_distinct(F.filter(labels, lambda t: t != ""))).drop("__m")


def merge_log(renames: DataFrame, method: str, pairs: DataFrame | None = None) -> DataFrame:
    """(canonical, surface_forms, member_count, method, min_sim, max_sim) of every cluster of at least two members.

    ``pairs`` (a, b, sim) are the similarities known between members; a cluster without any has 1 for both.
    """
    groups = renames.groupBy("canonical").agg(F.array_sort(F.collect_set("member")).alias("surface_forms"), F.count_distinct("member").alias("member_count")).where("member_count > 1")
    out = groups.withColumn("method", F.lit(method))
    if pairs is None:
        return out.withColumns({"min_sim": F.lit(1.0), "max_sim": F.lit(1.0)})
    a, b = renames.select(F.col("member").alias("a"), F.col("canonical").alias("ca")), renames.select(F.col("member").alias("b"), F.col("canonical").alias("cb"))
    inside = pairs.join(a, "a").join(b, "b").where("ca = cb").groupBy(F.col("ca").alias("canonical")).agg(F.min("sim").alias("lo"), F.max("sim").alias("hi"))
    return out.join(inside, "canonical", "left").withColumns({"min_sim": F.coalesce("lo", F.lit(1.0)), "max_sim": F.coalesce("hi", F.lit(1.0))}).drop("lo", "hi")
