"""Mixing sources to target weights (problem 8).

Tokens are aggregated per source (partial sums, one small row each), a repetition rate is derived, and every document
is emitted floor(rate) times plus one hash-seeded Bernoulli copy with the fraction as probability. The only driver-free
lookup is the table of rates, one row per source.

Defined results: sources are compared trimmed and lower-cased; documents without source count in the total only;
documents repeated by id count once; a source without tokens or above its cap is reported as short; an empty corpus
gives every wanted source as short; a null weight counts as 0, a null cap as none; of a target repeated with other values
the largest weight and the smallest cap count; targets that differ in case or blanks only share their source's documents,
with the sum of their rates under the smallest cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.tokens import token_count


def sized_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, tokens), once per document; source trimmed and lower-cased, null if blank."""
    sized = documents.select("doc_id", F.lower(F.trim("source")).alias("source"), token_count(F.col("text")).alias("tokens"))
    return sized.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("d")).select(
        "doc_id", F.nullif("d.source", F.lit("")).alias("source"), F.col("d.tokens").cast("long").alias("tokens")
    )


def source_rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: its tokens, wanted tokens, repetition rate (capped) and whether it falls short."""
    per_source = sized.groupBy(F.col("source").alias("s")).agg(F.sum("tokens").alias("tokens"))
    total = per_source.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    weights = targets.groupBy("source").agg(F.max(F.coalesce("target_weight", F.lit(0.0))).alias("target_weight"), F.min("max_repeats").alias("max_repeats"))
    sum_weight = weights.agg(F.sum("target_weight")).scalar()
    joined = weights.join(per_source, F.lower(F.trim(weights["source"])) == per_source["s"], "left").withColumns({"sum_weight": sum_weight, "total": total})
    tokens = F.coalesce("tokens", F.lit(0)).cast("long")
    wanted = F.when(F.col("sum_weight") > 0, F.col("target_weight") / F.col("sum_weight") * F.col("total")).otherwise(F.lit(0.0))
    out = joined.select("source", "target_weight", "max_repeats", "sum_weight", "total", tokens.alias("tokens"), wanted.alias("wanted"))
    over = F.coalesce(F.col("wanted") > F.col("max_repeats") * F.col("tokens"), F.lit(False))
    short = (F.col("target_weight") > 0) & ((F.col("tokens") == 0) | over)
    free = F.when(F.col("tokens") > 0, F.col("wanted") / F.col("tokens")).otherwise(0.0)
    rate = F.greatest(F.lit(0.0), F.least(free, F.coalesce(F.col("max_repeats").cast("double"), free)))
    return out.withColumns({"rate": rate, "short": F.coalesce(short, F.lit(False))})


def mixed(sized: DataFrame, rates: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, tokens, copies) of every document that is emitted at least once."""
    named = rates.where("rate > 0").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("rate").alias("r"), F.min("max_repeats").cast("double").alias("cap"))
    keyed = named.select("source", F.least("r", F.coalesce("cap", "r")).alias("rate"))
    picked = sized.join(keyed, "source")
    whole = F.floor("rate")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    copies = (whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    return picked.select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")


def emitted(mix: DataFrame) -> DataFrame:
    """One row per emitted copy: (doc_id, source, tokens, copy_no)."""
    return mix.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))


def actual_shares(mix: DataFrame, rates: DataFrame) -> DataFrame:
    """Per target source: target and actual share of the emitted tokens, rate and emitted tokens."""
    out = mix.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("emitted"))
    total = out.agg(F.coalesce(F.sum("emitted"), F.lit(0))).scalar()
    joined = rates.join(out, F.lower(F.trim(rates["source"])) == out["s"], "left").withColumn("all_emitted", total)
    n = F.coalesce("emitted", F.lit(0)).cast("long")
    share = F.coalesce(F.try_divide(n, F.col("all_emitted")), F.lit(0.0))
    return joined.select("source", F.coalesce(F.try_divide("target_weight", "sum_weight"), F.lit(0.0)).alias("target_share"), "rate", n.alias("emitted_tokens"), share.alias("actual_share"))
