"""Corpus statistics: terms, class profile, grounding of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.text import content_words, proper_nouns


def term_counts(texts: DataFrame, text: str) -> DataFrame:
    """(term, n) of content words (lower case) and proper names (as written), over the whole corpus."""
    terms = F.concat(proper_nouns(F.col(text)), content_words(F.col(text)))
    return texts.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def top_terms(counts: DataFrame, top: int = 100) -> DataFrame:
    """The ``top`` most frequent terms; ties in code-point order."""
    return counts.orderBy(F.col("n").desc(), "term").limit(top)


def class_profile(distribution: DataFrame, least: float = 0.0) -> DataFrame:
    """Mean confidence per class over the files that show the class."""
    return distribution.where(F.col("confidence") > least).groupBy("class").agg(F.avg("confidence").alias("mean_confidence"), F.count(F.lit(1)).alias("files"))


def glossary_terms(terms: DataFrame, cap_types: int = 20, cap_relations: int = 15) -> DataFrame:
    """(kind, ord, term) kept first-come, ``has_...`` relations dropped, at most so many of each kind."""
    kept = terms.where(F.col("term").isNotNull() & (F.col("term") != "")).where(~((F.col("kind") == "relation") & F.col("term").startswith("has_")))
    first = kept.groupBy("kind", "term").agg(F.min("ord").alias("ord"))
    k = F.row_number().over(W.partitionBy("kind").orderBy("ord"))
    cap = F.when(F.col("kind") == "relation", cap_relations).otherwise(cap_types)
    return first.withColumn("k", k).where(F.col("k") <= cap).drop("k")


def accuracy_by_class(predicted: DataFrame) -> DataFrame:
    """(gold, pred) rows to precision, recall and F1 per class: both sides counted in one pass over a union."""
    g = predicted.select(F.col("gold").alias("class"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col("gold") == F.col("pred")).cast("int").alias("tp"))
    p = predicted.where(F.col("pred").isNotNull()).select(F.col("pred").alias("class"), F.lit(0), F.lit(1), F.lit(0))
    n = g.union(p).groupBy("class").agg(F.sum("g").alias("gold"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision, recall = zero(F.try_divide("tp", "predicted")), zero(F.try_divide("tp", "gold"))
    out = n.withColumns({"precision": precision, "recall": recall})
    return out.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def accuracy_summary(predicted: DataFrame) -> DataFrame:
    """One row of (gold, pred) rows: how many, how many with a prediction, how many right, and the mean F1 of the gold classes."""
    macro = accuracy_by_class(predicted).where("gold > 0").agg(F.coalesce(F.avg("f1"), F.lit(0.0)))
    n = predicted.agg(F.count(F.lit(1)).alias("total"), F.count("pred").alias("predicted"), F.count_if(F.col("gold") == F.col("pred")).alias("correct"))
    share = lambda c: F.coalesce(F.try_divide(c, "total"), F.lit(0.0))
    return n.withColumns({"accuracy": share("correct"), "coverage": share("predicted"), "macro_f1": macro.scalar()})


def confusion(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("gold", F.coalesce("pred", F.lit("(none)")).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
