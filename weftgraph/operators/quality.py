"""Quality scores of a graph: names, observations, relations, grounding, consistency, the composite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import keyword_score, naming_pattern, substring_conflict

# What the scores count as trivial, meaningful or valid.
TRIVIAL = ("is a number", "is a variable", "is a concept", "is a function", "is a string", "is a value", "is a method", "exists", "is defined")
MEANINGFUL_TYPES = ("algorithm", "function", "class", "module", "database", "api_endpoint", "research_task", "chemical_compound", "protein", "gene", "equation", "neural_network", "quantum_algorithm", "experimental_technique")
VALID_RELATIONS = ("uses", "implements", "extends", "contains", "calls", "depends_on", "targets", "binds_to", "catalyzes", "measures", "processes", "configured_with", "provides_training_data", "evaluates")


def _share(c: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.avg(c.cast("double")), F.lit(empty))


def name_score(name: Column) -> Column:
    """0.3 for snake case, 0.4 for a name of some length that says something, 0.3 for a separator or a capital."""
    snake = F.when(name.rlike(r"^[a-z][a-z0-9_]*[a-z0-9]$"), 0.3).otherwise(0.0)
    says = F.when((F.length(name) > 3) & ~name.isin("data", "item", "value", "object"), 0.4).otherwise(0.0)
    marked = F.when(name.contains("_") | name.rlike("[A-Z]"), 0.3).otherwise(0.0)
    return F.least(snake + says + marked, F.lit(1.0))


def specific(text: Column) -> Column:
    told = (F.length(text) > 10) | text.rlike(r"[0-9]")
    for word in ("implements", "uses", "version", "located"):
        told = told | text.contains(word)
    return ~F.lower(text).isin(*TRIVIAL) & told


def semantic_scores(entities: DataFrame, observations: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: name quality, specificity, relation validity, type appropriateness."""
    types = F.col("entity_type")
    e = entities.agg(F.coalesce(F.avg(name_score(F.col("name"))), F.lit(0.0)).alias("name_quality"), _share(types.isin(*MEANINGFUL_TYPES) | types.contains("_") | (F.length(types) > 6)).alias("type_appropriateness"))
    o = observations.agg(_share(specific(F.col("text"))))
    r = relations.agg(_share(F.arrays_overlap("relation_type", F.array(*map(F.lit, VALID_RELATIONS)))))
    return e.withColumns({"specificity": o.scalar(), "relation_validity": r.scalar()})


def domain_coverage(entities: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """Share of the distinct identifiers over three characters that occur in some entity name.

    Names are broken into their substrings' carriers once: a term is looked up in the set of all words of all names
    first, and only what is left is searched in the names themselves.
    """
    terms = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0))).alias("t")).where(F.length("t") > 3).distinct().select(F.lower("t").alias("t"), F.lit(1).alias("n"))
    folded = terms.groupBy("t").agg(F.sum("n").alias("n"))
    names = entities.select(F.lower("name").alias("name")).distinct()
    pieces = names.select(F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(4), F.greatest(F.length("name"), F.lit(4))), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - k + 1, F.lit(1))), lambda i: F.substr("name", i, k)))))).alias("t")).distinct()
    covered = folded.join(pieces, "t", "left_semi").agg(F.sum("n"))
    return folded.agg(F.sum("n").alias("terms")).withColumn("covered", F.coalesce(covered.scalar(), F.lit(0))).withColumn("coverage", F.coalesce(F.try_divide("covered", "terms"), F.lit(0.0)))


def grounding_scores(claims: DataFrame) -> DataFrame:
    """Claims (name, text, source): share that the source does not carry, and share of names it holds."""
    names_it = F.lower("source").contains(F.lower("name"))
    held = names_it & (keyword_score(F.col("text"), F.col("source")) >= 0.5)
    return claims.agg(_share(~held).alias("hallucination"), _share(names_it, 0.0).alias("grounding"))


def factual_consistency(observations: DataFrame) -> DataFrame:
    """Share of pairs of one entity's observations without opposite words; 1 without pairs.

    Texts of an entity that are equal meet once, weighted by how often they occur.
    """
    texts = observations.groupBy("name", "text").agg(F.count(F.lit(1)).alias("n"))
    per = texts.groupBy("name").agg(F.sum("n").alias("all"))
    flags = {i: (F.lower("text").contains(a), F.lower("text").contains(b)) for i, (a, b) in enumerate((("synchronous", "asynchronous"), ("mutable", "immutable"), ("public", "private"), ("static", "dynamic")))}
    suspects = texts.where(F.array_contains(F.array(*[x | y for x, y in flags.values()]), True))
    a, b = suspects.select("name", F.col("text").alias("x"), F.col("n").alias("nx")), suspects.select(F.col("name").alias("m"), F.col("text").alias("y"), F.col("n").alias("ny"))
    met = a.join(b, (a["name"] == b["m"]) & (a["x"] <= b["y"])).where(substring_conflict(F.col("x"), F.col("y")))
    conflicts = met.agg(F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("nx") * (F.col("nx") - 1) / 2).otherwise(F.col("nx") * F.col("ny"))), F.lit(0.0)))
    pairs = per.agg(F.coalesce(F.sum(F.col("all") * (F.col("all") - 1) / 2), F.lit(0.0)).alias("pairs"))
    out = pairs.withColumn("conflicts", conflicts.scalar())
    return out.withColumn("consistency", F.coalesce(1 - F.try_divide("conflicts", "pairs"), F.lit(1.0)))


def naming_consistency(entities: DataFrame) -> DataFrame:
    per = entities.groupBy(naming_pattern(F.col("name")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.try_divide(F.max("n"), F.sum("n")), F.lit(0.0)).alias("naming_consistency"))


def type_consistency(entities: DataFrame) -> DataFrame:
    """Share of the name prefixes with several entities that have one type."""
    per = entities.groupBy(F.lower(F.get(F.split("name", "[_-]"), 0)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_type").alias("types")).where("n > 1")
    return per.agg(_share(F.col("types") == 1, 1.0).alias("type_consistency"))


def cross_consistency(current: DataFrame, existing: DataFrame) -> DataFrame:
    """Share of the known names that keep a type they had before; 1 if none is known."""
    known = existing.groupBy("name").agg(F.collect_set("entity_type").alias("types"))
    return current.join(known, "name").agg(_share(F.array_contains("types", F.col("entity_type")), 1.0).alias("cross_consistency"))


def composite(row: DataFrame) -> DataFrame:
    """Overall quality of 100 (25 structure, 30 semantics, 30 facts, 15 consistency) with recommendations."""
    c = F.col
    n = c("entity_count")
    structure = F.least(
        F.when(n.between(3, 15), 0.3).when(n > 0, 0.1).otherwise(0.0) + F.when(c("relations_per_entity").between(0.5, 2.0), 0.2).otherwise(0.0)
        + F.when(c("observations_per_entity").between(1, 5), 0.3).otherwise(0.0) + F.when((n > 0) & (c("connected_components") <= 2), 0.2).otherwise(0.0), F.lit(1.0),
    )
    semantic = c("name_quality") * 0.2 + c("specificity") * 0.3 + c("relation_validity") * 0.2 + c("coverage") * 0.2 + c("type_appropriateness") * 0.1
    factual = (1 - c("hallucination")) * 0.5 + c("grounding") * 0.3 + c("consistency") * 0.2
    consistent = c("cross_consistency") * 0.4 + c("naming_consistency") * 0.3 + c("type_consistency") * 0.3
    out = row.withColumns({"structural": structure * 25, "semantic": semantic * 30, "factual": factual * 30, "consistent": consistent * 15})
    advice = F.array(
        F.when(n == 0, "no entities: check that the input says something"), F.when(c("specificity") < 0.5, "observations are generic: ask for specific facts"), F.when(c("hallucination") > 0.3, "many claims lack a source"),
        F.when(c("naming_consistency") < 0.7, "names follow different patterns"), F.when(c("isolated_entities") > n * 0.5, "many entities have no relation"),
    )
    return out.withColumns({"overall": c("structural") + c("semantic") + c("factual") + c("consistent"), "advice": F.array_join(F.filter(advice, lambda a: a.isNotNull()), "; ")})
