"""Chunk graphs merged to one: by file, within each file, then across files, with two levels of renames.

Mentions are (graph_id, file, name, entity_type, ord) and edges (graph_id, src, dst, relation_type, ord); ``ord`` is the
order in which they were extracted, and decides what comes first. Everything is aggregation and equi-joins on normalised
names, files and ends, so no file or name is gathered into one task; fuzzy matches come in as a table of surface forms.

Defined results: mentions without a name are left out, a missing file is ``unknown``, ends without an entity drop their
edge unless they are known external names, which become stubs of type ``other``; an empty input gives empty tables.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.text import canonical_types, normal_name
from weftgraph.session import cut

# Types whose entities are the same only in the same file, and the catch-all type.
FILE_TYPES, OTHER = ("file", "document", "config"), "other"


class Merged(NamedTuple):
    """Entities (name, entity_type, files, n_mentions, ord), edges (src, dst, relation_type, ord) and one row of statistics."""

    entities: DataFrame
    relations: DataFrame
    stats: DataFrame


def _elected(votes: DataFrame, key: str) -> DataFrame:
    """(key, entity_type): the most frequent specific type, the first met among equals."""
    counts = votes.groupBy(key, "entity_type").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("f"))
    specific = F.coalesce((F.col("entity_type") != OTHER) & (F.col("entity_type") != ""), F.lit(False))
    return counts.groupBy(key).agg(F.coalesce(F.max_by("entity_type", F.struct(specific, F.col("n"), -F.col("f"))), F.lit(OTHER)).alias("entity_type"))


def within_files(mentions: DataFrame, surfaces: DataFrame | None = None) -> DataFrame:
    """``mentions`` with ``within``: the first name of each normalised name in its file.

    ``surfaces`` (surface, canonical) folds further names into one, as a fuzzy merge found them.
    """
    named = mentions.where("name IS NOT NULL").withColumn("file", F.coalesce("file", F.lit("unknown")))
    if surfaces is not None:
        folded = surfaces.groupBy(F.col("surface").alias("__s")).agg(F.min("canonical").alias("__c"))
        named = named.join(folded, named["name"] == F.col("__s"), "left").withColumn("__n", normal_name(F.coalesce("__c", "name"))).drop("__s", "__c")
    else:
        named = named.withColumn("__n", normal_name(F.col("name")))
    first = named.groupBy("file", "__n").agg(F.min_by("name", "ord").alias("within"))
    return named.join(first, ["file", "__n"]).withColumnRenamed("__n", "norm")


def _output_names(mentions: DataFrame) -> DataFrame:
    """``mentions`` with ``identity`` and ``out``, the unique name of the entity each belongs to.

    A name that several identities want stays with the first; file artefacts add their file, others a number.
    """
    artefact = F.col("entity_type").isin(*FILE_TYPES)
    keyed = mentions.withColumn("identity", F.when(artefact, F.concat_ws("␟", "within", "file")).otherwise(F.concat(F.lit("␟"), "norm")))
    ids = keyed.groupBy("identity").agg(F.min_by(F.struct("within", F.when(artefact, F.col("file")).alias("file")), "ord").alias("x"), F.min("ord").alias("first"))
    wanted = ids.select("identity", "x.within", "x.file", "first")
    # Only names that several identities want are ranked; a name has one identity besides its files.
    place = F.row_number().over(W.partitionBy("within").orderBy("first", "identity"))
    out = F.when(place == 1, F.col("within")).when(F.col("file").isNotNull(), F.concat("within", F.lit(" ["), "file", F.lit("]"))).otherwise(F.concat("within", F.lit("#2")))
    return keyed.join(wanted.select("identity", out.alias("out")), "identity")


def hierarchical_merge(mentions: DataFrame, edges: DataFrame, external: DataFrame | None = None, surfaces: DataFrame | None = None) -> Merged:
    """Entities and edges of all chunk graphs merged.

    An edge goes with the files of those of its ends that are entities of its own chunk graph, and is left out if none
    is. Its ends take the name of their file's entity first, then of the entity of that name anywhere. Self-loops are
    dropped, equal edges kept once; the statistics count surviving edges between entities of different first files, and
    dropped edges as often as they came from their files.
    """
    local = cut(_output_names(within_files(mentions, surfaces)))
    # Edges by file, through the ends that their own graph holds.
    ends = edges.select("graph_id", "src", "dst", canonical_types(F.col("relation_type")).alias("relation_type"), "ord")
    here = local.select("graph_id", F.col("name").alias("__e"), "file").distinct()
    sides = ends.withColumn("__e", F.explode(F.array_distinct(F.array("src", "dst"))))
    by_file = sides.join(here, ["graph_id", "__e"]).groupBy("file", "src", "dst", "relation_type").agg(F.min("ord").alias("ord"))
    # First level: the names within the file; second: the output names of its entities, then those of all files.
    in_file = local.groupBy("file", "name").agg(F.max_by(F.struct("within", "out"), "ord").alias("x")).select(F.col("file").alias("__f"), F.col("name").alias("__m"), "x.within", "x.out")
    anywhere = local.where(~F.coalesce(F.col("entity_type").isin(*FILE_TYPES), F.lit(False))).groupBy(F.col("name").alias("__m")).agg(F.max_by("out", "ord").alias("all"))

    def renamed(df: DataFrame, end: str) -> DataFrame:
        a = df.join(in_file, (df["file"] == in_file["__f"]) & (df[end] == in_file["__m"]), "left").withColumnsRenamed({"within": f"__{end}_in", "out": f"__{end}_out"}).drop("__f", "__m")
        b = a.join(anywhere, F.col(end) == anywhere["__m"], "left").drop("__m")
        return b.withColumns({f"{end}_in": F.coalesce(f"__{end}_in", end), f"{end}_out": F.coalesce(f"__{end}_out", "all", end)}).drop("all", f"__{end}_in", f"__{end}_out")

    both = renamed(renamed(by_file, "src"), "dst").where("src_in <> dst_in")
    once = both.groupBy("file", "src_in", "dst_in", "relation_type").agg(F.min(F.struct("ord", "src_out", "dst_out")).alias("x"))
    raw = once.select(F.col("x.src_out").alias("src"), F.col("x.dst_out").alias("dst"), "relation_type", F.col("x.ord").alias("ord")).where("src <> dst")
    first_file = local.groupBy(F.col("out").alias("name")).agg(F.min_by("file", "ord").alias("home"), F.array_sort(F.collect_set("file")).alias("files"), F.count(F.lit(1)).alias("n_mentions"), F.min("ord").alias("ord"))
    known = first_file.select("name", "home")
    if external is not None:
        wanted = raw.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
        stubs = cut(wanted.join(known, "name", "left_anti").join(external.select("name").distinct(), "name", "left_semi"))
        known = known.unionByName(stubs.withColumn("home", F.lit("")))
    a, b = known.select(F.col("name").alias("src"), F.col("home").alias("__a")), known.select(F.col("name").alias("dst"), F.col("home").alias("__b"))
    gated = cut(raw.join(a, "src", "left").join(b, "dst", "left").withColumn("ok", F.col("__a").isNotNull() & F.col("__b").isNotNull()))
    relations = gated.where("ok").groupBy("src", "dst", "relation_type").agg(F.min("ord").alias("ord"), F.max(F.col("__a") != F.col("__b")).alias("crosses"))
    relations = cut(relations)
    typed = _elected(local.withColumnRenamed("out", "__o"), "__o").withColumnRenamed("__o", "name")
    named_files = F.filter("files", lambda f: f != "unknown")
    entities = first_file.join(typed, "name").select("name", "entity_type", F.when(F.size(named_files) > 0, named_files).otherwise(F.col("files")).alias("files"), "n_mentions", "ord")
    if external is not None:
        entities = entities.unionByName(stubs.select("name", F.lit(OTHER).alias("entity_type"), F.array().cast("array<string>").alias("files"), F.lit(0).cast("long").alias("n_mentions"), F.lit(None).cast("long").alias("ord")))
    counts = relations.agg(F.count(F.lit(1)).alias("relations"), F.coalesce(F.sum(F.col("crosses").cast("long")), F.lit(0)).alias("cross_file_edges"))
    stats = counts.withColumns({"dropped_dangling_edges": gated.where("NOT ok").agg(F.count(F.lit(1))).scalar(), "entities": entities.agg(F.count(F.lit(1))).scalar()})
    return Merged(entities, relations.drop("crosses"), stats)
