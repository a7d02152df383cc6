"""Graph operators over entities(name, entity_type, ...) and relations(src, dst, relation_type array, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import canonical_types
from weftgraph.session import Scratch, cut

CATCH_ALL = "related_to"


def no_self_loops(relations: DataFrame) -> DataFrame:
    return relations.where(F.col("src") != F.col("dst"))


def dedup_relations(relations: DataFrame, order: list[str]) -> DataFrame:
    """One relation per (src, dst, folded types); the attributes of the first by ``order`` win. Self-loops go.

    A partial ``min_by`` keeps one candidate per key and task before the shuffle.
    """
    keyed = no_self_loops(relations).withColumn("relation_type", canonical_types(F.col("relation_type")))
    rest = [c for c in keyed.columns if c not in ("src", "dst", "relation_type")]
    if not rest:
        return keyed.distinct()
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return keyed.groupBy("src", "dst", "relation_type").agg(first.alias("__r")).select("src", "dst", "relation_type", *[F.col(f"__r.{c}") for c in rest])


def filter_catch_all(relations: DataFrame, mode: str) -> DataFrame:
    """``off``; ``redundant``: catch-all edges between nodes that a typed edge joins either way; ``all``: every one."""
    types = F.col("relation_type")
    typed = F.exists(types, lambda t: t != CATCH_ALL)
    if mode == "off":
        return relations
    if mode == "all":
        return relations.where(typed | (F.size(types) == 0))
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    joined = relations.where(typed).select(low.alias("__a"), high.alias("__b")).distinct()
    bare = relations.where(~typed & (F.size(types) > 0))
    kept = bare.join(joined, (F.least(bare["src"], bare["dst"]) == joined["__a"]) & (F.greatest(bare["src"], bare["dst"]) == joined["__b"]), "left_anti")
    return relations.where(typed | (F.size(types) == 0)).unionByName(kept)


def integrity_gate(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose two ends are known."""
    names = entities.select("name").distinct()
    return relations.join(names, relations["src"] == names["name"], "left_semi").join(names, relations["dst"] == names["name"], "left_semi")


def dangling(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with an unknown end, with which ends are known."""
    a, b = entities.select(F.col("name").alias("__a")).distinct(), entities.select(F.col("name").alias("__b")).distinct()
    joined = relations.join(a, relations["src"] == a["__a"], "left").join(b, relations["dst"] == b["__b"], "left")
    marked = joined.withColumns({"src_known": F.col("__a").isNotNull(), "dst_known": F.col("__b").isNotNull()}).drop("__a", "__b")
    return marked.where(~F.col("src_known") | ~F.col("dst_known"))


def with_stubs(entities: DataFrame, relations: DataFrame, external: DataFrame) -> DataFrame:
    """Entities plus a stub of type ``external`` for every unknown end that is a known external name."""
    ends = relations.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    missing = ends.join(entities.select("name"), "name", "left_anti").join(external.select("name"), "name", "left_semi")
    return entities.select("name", "entity_type").unionByName(missing.select("name", F.lit("external").alias("entity_type")))


def degrees(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(name, degree, known): entities without edges at 0, unknown ends counted too, a self-loop counts twice."""
    ends = relations.select(F.explode(F.array("src", "dst")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    names = entities.select("name").distinct().withColumn("known", F.lit(True))
    return names.join(ends, "name", "full_outer").select("name", F.coalesce("n", F.lit(0)).alias("degree"), F.coalesce("known", F.lit(False)).alias("known"))


def type_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


def relation_type_counts(relations: DataFrame, untyped: str | None = None) -> DataFrame:
    """Edges per type; edges without types count as ``untyped``, or not at all."""
    types = F.col("relation_type")
    if untyped:
        types = F.when(F.size(types) == 0, F.array(F.lit(untyped))).otherwise(types)
    return relations.select(F.explode(types).alias("relation_type")).groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"))


def bidirectional_pairs(relations: DataFrame) -> DataFrame:
    """Unordered pairs joined in both directions: both orders of a pair are counted in one aggregation, no self-join."""
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    ways = no_self_loops(relations).groupBy(low.alias("a"), high.alias("b")).agg(F.max(F.col("src") < F.col("dst")).alias("up"), F.max(F.col("src") > F.col("dst")).alias("down"))
    return ways.where("up AND down").select("a", "b")


def health(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of graph health: counts, self-loops, bidirectional pairs, dangling ends, integrity, parallel edges."""
    e = entities.agg(F.count(F.lit(1)).alias("entity_count"), F.count_distinct(F.nullif("entity_type", F.lit(""))).alias("entity_type_count"))
    # Edges are counted per key once; everything below reads that much smaller table.
    edges = relations.groupBy("src", "dst", "relation_type").agg(F.count(F.lit(1)).alias("n"))
    many = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    r = edges.agg(many(F.lit(True)).alias("relation_count"), many(F.col("src") == F.col("dst")).alias("self_loop_count"))
    distinct = edges.select("src", "dst", canonical_types(F.col("relation_type")).alias("t")).distinct().agg(F.count(F.lit(1)).alias("distinct_edges"))
    types = edges.select(F.explode("relation_type").alias("t")).where("t <> ''").agg(F.count_distinct("t").alias("relation_type_count"))
    loose = dangling(edges, entities).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("dangling_endpoint_count"))
    both = bidirectional_pairs(edges).agg(F.count(F.lit(1)).alias("bidirectional_pair_count"))
    row = e.withColumns({
        "relation_count": r.select("relation_count").scalar(), "self_loop_count": r.select("self_loop_count").scalar(), "relation_type_count": types.scalar(),
        "dangling_endpoint_count": loose.scalar(), "bidirectional_pair_count": both.scalar(), "distinct_edges": distinct.scalar(),
    })
    integrity = F.coalesce(1 - F.try_divide(F.col("dangling_endpoint_count").cast("double"), F.col("relation_count").cast("double")), F.lit(1.0))
    return row.select("entity_count", "entity_type_count", "relation_count", "relation_type_count", "self_loop_count", "bidirectional_pair_count", "dangling_endpoint_count", integrity.alias("referential_integrity"), (F.col("relation_count") - F.col("distinct_edges")).alias("parallel_edge_count"))


def vocabulary_fit(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Share of edges that are nothing but the catch-all, of edges with it at all, and of entities of type ``other``."""
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    types = F.col("relation_type")
    r = relations.agg(share((F.size(types) > 0) & F.forall(types, lambda t: t == CATCH_ALL)).alias("all_catch_all"), share(F.exists(types, lambda t: F.lower(t) == CATCH_ALL)).alias("any_catch_all"))
    return r.withColumn("other_entities", entities.agg(share(F.col("entity_type") == "other")).scalar())


def coerce_vocabulary(types: Column, allowed: list[str], escape: str = CATCH_ALL) -> Column:
    """Types outside the vocabulary become the escape; a null array becomes an empty one."""
    return F.transform(F.coalesce(types, F.array().cast("array<string>")), lambda t: F.when(t.isin(*allowed), t).otherwise(escape))


def allowed_vocabulary(base: list[str], domain: list[str] = (), glossary: list[str] = (), mode: str = "union", escape: str = CATCH_ALL) -> list[str] | None:
    """``open``: no limit; ``strict``: the glossary and the escape; ``union``: all of them, first mention kept."""
    if mode == "open":
        return None
    words = [*glossary, escape] if mode == "strict" and glossary else [*domain, *glossary, *base, escape]
    return list(dict.fromkeys(words))


def hide_types(entities: DataFrame, relations: DataFrame, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    shown = entities.where(~F.col("entity_type").isin(*hidden))
    return shown, integrity_gate(relations, shown)


def find_entity(entities: DataFrame, query: str, order: str) -> DataFrame:
    """The entity of exactly that name (case aside), else the first whose name holds the query."""
    low = F.lower("name")
    return entities.where(low.contains(query.lower())).orderBy(low != query.lower(), order).limit(1)


def neighbours(relations: DataFrame, focus: DataFrame) -> DataFrame:
    """(focus, neighbour, n_edges) of the focus names, self-loops aside."""
    out = relations.select(F.col("src").alias("focus"), F.col("dst").alias("neighbour")).unionByName(relations.select(F.col("dst").alias("focus"), F.col("src").alias("neighbour")))
    kept = out.where("focus <> neighbour").join(focus.select(F.col("name").alias("focus")).distinct(), "focus", "left_semi")
    return kept.groupBy("focus", "neighbour").agg(F.count(F.lit(1)).alias("n_edges"))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(name, component): the least name reachable over edges (src, dst), nulls and self-loops aside.

    Large-star and small-star rounds: every node links its larger neighbours, then its smaller ones, to the least name
    around it, until nothing changes; each round is an aggregation and a join on node names, written to the shared
    folder. Isolated ``nodes`` are their own component.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    pairs = no_self_loops(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()))
    links, seen = scratch.save(pairs.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "links-0", n=F.count(F.lit(1)))
    step, before = 0, None
    while seen["n"]:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        step += 1
        links, seen = scratch.save(small, f"links-{step}", n=F.count(F.lit(1)), mark=F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")))
        scratch.drop(f"links-{step - 1}")
        now = (seen["n"], str(seen["mark"]))
        if now == before:
            break
        before = now
    found = links.select(F.col("u").alias("name"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("name"), F.col("v").alias("component")).distinct()
    out = found.unionByName(roots).groupBy("name").agg(F.min("component").alias("component"))
    if nodes is not None:
        alone = nodes.select("name").distinct().join(out, "name", "left_anti").select("name", F.col("name").alias("component"))
        out = out.unionByName(alone)
    return out


def structure(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Density, components over known ends, entities without an edge, relations and observations per entity."""
    known = integrity_gate(relations, entities)
    parts = connected_components(known, entities).agg(F.count_distinct("component").alias("components"))
    lonely = degrees(entities, relations).where("known AND degree = 0").agg(F.count(F.lit(1)))
    n = entities.agg(F.count(F.lit(1)).alias("entity_count"))
    row = n.withColumns({"relation_count": relations.agg(F.count(F.lit(1))).scalar(), "connected_components": parts.scalar(), "isolated_entities": lonely.scalar()})
    possible = (F.col("entity_count") * (F.col("entity_count") - 1)).cast("double")
    return row.select("*", F.coalesce(F.try_divide(F.col("relation_count").cast("double"), possible), F.lit(0.0)).alias("density"), F.coalesce(F.try_divide(F.col("relation_count").cast("double"), F.col("entity_count").cast("double")), F.lit(0.0)).alias("relations_per_entity"))


def resolve_chain(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, root): the end of each chain of parents, by pointer doubling until nothing moves.

    Of several parents the smallest counts. A chain that runs into a cycle ends at the cycle's smallest member: after as
    many doublings as make up all links every pointer is within its cycle, and the least name met from there on is its.
    """
    table = cut(links.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c IS NOT NULL AND p IS NOT NULL").groupBy("c").agg(F.min("p").alias("p")).withColumn("m", F.col("p")))
    left, moving = table.count(), True
    while moving and left:
        up = table.select(F.col("c").alias("k"), F.col("p").alias("q"), F.col("m").alias("n"))
        table = cut(table.join(up, table["p"] == up["k"], "left").select("c", F.coalesce("q", "p").alias("p"), F.when(F.col("q").isNotNull(), F.least("m", "n")).otherwise(F.col("m")).alias("m"), F.coalesce(F.col("q") != F.col("p"), F.lit(False)).alias("moved")))
        moving = not table.where("moved").isEmpty()
        left //= 2
    inside = table.select(F.col("c").alias("k"), F.col("m").alias("n"))
    return table.join(inside, table["p"] == inside["k"], "left").select(F.col("c").alias(child), F.coalesce("n", "p").alias("root"))
