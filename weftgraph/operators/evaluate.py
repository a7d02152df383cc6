"""Precision, recall and F1 of extracted triples against gold ones."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.shipping import by_value
from weftgraph.functions.text import match_key, triple_key


def with_scores(counts: DataFrame) -> DataFrame:
    """tp, fp, fn to precision, recall, f1; a zero denominator gives 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = counts.withColumns({"precision": zero(F.try_divide("tp", F.col("tp") + F.col("fp"))), "recall": zero(F.try_divide("tp", F.col("tp") + F.col("fn")))})
    return out.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def multiset_counts(extracted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tp, fp, fn): equal parts match as often as both sides have them. One aggregation over a union."""
    both = extracted.select(*keys, "part", F.lit(1).alias("e"), F.lit(0).alias("g")).unionByName(gold.select(*keys, "part", F.lit(0).alias("e"), F.lit(1).alias("g")))
    per = both.groupBy(*keys, "part").agg(F.sum("e").alias("e"), F.sum("g").alias("g"))
    tp = F.sum(F.least("e", "g"))
    return per.groupBy(*keys).agg(tp.alias("tp"), (F.sum("e") - tp).alias("fp"), (F.sum("g") - tp).alias("fn"))


def parts(triples: DataFrame, level: str, keys: list[str]) -> DataFrame:
    """(keys, part) of a level: triples and relations as they come, entities distinct before they are folded."""
    if level == "triple":
        return triples.select(*keys, F.concat_ws("|", match_key(F.col("s")), match_key(F.col("p")), match_key(F.col("o"))).alias("part"))
    if level == "relation":
        return triples.select(*keys, match_key(F.col("p")).alias("part"))
    ends = triples.select(*keys, F.explode(F.array("s", "o")).alias("e")).distinct()
    return ends.select(*keys, match_key(F.col("e")).alias("part"))


def score_levels(extracted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level, tp, fp, fn) at entity, relation and triple level."""
    levels = [multiset_counts(parts(extracted, l, keys), parts(gold, l, keys), keys).withColumn("level", F.lit(l)) for l in ("entity", "relation", "triple")]
    return reduce(DataFrame.unionByName, levels)


def micro(counts: DataFrame, keys: list[str]) -> DataFrame:
    return with_scores(counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def without_seen(triples: DataFrame, seen: DataFrame) -> DataFrame:
    """Triples whose key was not in the training triples."""
    key = lambda d: d.select(triple_key(F.col("s"), F.col("p"), F.col("o")).alias("__k")).distinct()
    keyed = triples.withColumn("__k", triple_key(F.col("s"), F.col("p"), F.col("o")))
    return keyed.join(key(seen), "__k", "left_anti").drop("__k")


def _first_fit(least: float):
    def run(e: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        sample = (e if len(e) else g)["sample"].iloc[0]
        e, g = e.sort_values("ord"), g.sort_values("ord")
        free = [True] * len(g)
        gold = list(zip(g["part"], g["vec"]))
        tp = 0
        for part, vec in zip(e["part"], e["vec"]):
            for j, (other, ov) in enumerate(gold):
                if not free[j]:
                    continue
                if vec is None or ov is None:
                    hit = part == other
                else:
                    x, y = np.asarray(vec, float), np.asarray(ov, float)
                    n = np.linalg.norm(x) * np.linalg.norm(y)
                    hit = len(x) == len(y) and n > 0 and float(x @ y) / n >= least
                if hit:
                    free[j] = False
                    tp += 1
                    break
        return pd.DataFrame({"sample": [sample], "tp": [tp], "fp": [len(e) - tp], "fn": [len(g) - tp]})

    return run


def semantic_counts(extracted: DataFrame, gold: DataFrame, least: float = 0.8) -> DataFrame:
    """(sample, tp, fp, fn) by first fit in order: cosine of at least ``least``, equality where a vector is missing."""
    columns = ["sample", "part", "vec", "ord"]
    extracted, gold = (d.select(*[F.col(c).alias(c) for c in columns]) for d in (extracted, gold))  # both may come from one table
    return extracted.groupBy("sample").cogroup(gold.groupBy("sample")).applyInPandas(_first_fit(least), "sample string, tp long, fp long, fn long")


def graph_triples(relations: DataFrame, keys: list[str], escape: str | None = "related to") -> DataFrame:
    """Relations as triples, one per type; an edge without types takes the escape, or none."""
    types = F.col("relation_type")
    if escape:
        types = F.when(F.size(types) == 0, F.array(F.lit(escape))).otherwise(types)
    return relations.select(*keys, F.col("src").alias("s"), F.explode(types).alias("p"), F.col("dst").alias("o"))


def best_match(overlaps: DataFrame, key: str, candidate: str, score: str, least: float = 0.3, margin: float = 0.1) -> DataFrame:
    """(key, candidate): the best candidate if it is good enough and clear of the second."""
    two = overlaps.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("m"), candidate))), 1, 2).alias("r"))
    best, second = F.get("r", 0), F.get("r", 1)
    return two.where((-best["m"] >= least) & (-best["m"] - F.coalesce(-second["m"], F.lit(0.0)) >= margin)).select(key, best[candidate].alias(candidate))


def rank_auc(scored: DataFrame, score: str, label: str, slices: int = 1024) -> DataFrame:
    """Area under the curve from ranks, ties at their mean, of scores between -1 and 1.

    Scores are counted once per value; the negatives below each come from the totals of the slices before (a table of
    at most about twice ``slices`` rows) and a running sum within the slice.
    """
    from pyspark.sql import Window as W

    per = scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum((~F.col(label)).cast("long")).alias("n")).withColumn("slice", F.floor(F.col("s") * slices))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = per.groupBy("slice").agg(F.sum("n").alias("n")).withColumn("base", earlier(W.orderBy("slice"))).select("slice", "base")
    won = per.withColumn("inside", earlier(W.partitionBy("slice").orderBy("s"))).join(base, "slice")
    return won.agg(F.try_divide(F.sum(F.col("p") * (F.col("base") + F.col("inside") + F.col("n") / 2)), (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))


def separation(scored: DataFrame, score: str, label: str, q: float = 0.05, slices: int = 1024) -> DataFrame:
    """One row: means, variances and a quantile of both groups' scores, how far they stand apart, and the best threshold.

    The quantile is the score at place floor(q * n); the threshold has the greatest share of positives minus share of
    negatives at or above it, the least of equals. Scores (between -1 and 1) are counted once per value and numbered
    within slices of values, so no group is sorted whole. Without one of the groups its figures are null.
    """
    from pyspark.sql import Window as W

    pos, neg = F.when(F.col(label), F.col(score)), F.when(~F.col(label), F.col(score))
    moments = scored.agg(*[f(c).alias(f"{n}_{k}") for k, c in (("positive", pos), ("negative", neg)) for n, f in (("mean", F.avg), ("var", F.var_pop), ("n", F.count))])
    per = scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum((~F.col(label)).cast("long")).alias("n")).withColumn("slice", F.floor(F.col("s") * slices))
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = per.groupBy("slice").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    base = totals.select("slice", earlier("p", W.orderBy("slice")).alias("bp"), earlier("n", W.orderBy("slice")).alias("bn"))
    within = W.partitionBy("slice").orderBy("s")
    below = per.withColumns({"ip": earlier("p", within), "inn": earlier("n", within)}).join(base, "slice").select("s", "p", "n", (F.col("bp") + F.col("ip")).alias("below_p"), (F.col("bn") + F.col("inn")).alias("below_n"))
    placed = below.crossJoin(F.broadcast(moments.select("n_positive", "n_negative")))  # one row
    at = lambda k, under, total: F.max(F.when((F.col(under) <= F.least(F.floor(F.lit(q) * F.col(total)), F.col(total) - 1)) & (F.col(k) > 0), F.col("s")))
    j = F.try_divide("below_n", "n_negative") - F.try_divide("below_p", "n_positive")
    best = placed.withColumn("j", j).agg(at("p", "below_p", "n_positive").alias("q_positive"), at("n", "below_n", "n_negative").alias("q_negative"), F.max(F.struct("j", -F.col("s"))).alias("b"))
    row = moments.crossJoin(F.broadcast(best))  # one row each
    apart = (F.col("mean_positive") - F.col("mean_negative")) / F.sqrt((F.col("var_positive") + F.col("var_negative")) / 2 + 1e-9)
    return row.select("mean_positive", "mean_negative", "var_positive", "var_negative", "q_positive", "q_negative", apart.alias("d_prime"), (-F.col("b.col2")).alias("threshold"), F.col("b.j").alias("youden_j"))


by_value(__name__)
