"""Content classes of texts: weighted cues, softmax, domain gate, cascade of undecided ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.similarity import let, softmax

#: class -> (pattern, weight); a compact default, replaced by passing another table
CUES: dict[str, tuple[tuple[str, float], ...]] = {
    "source_code": ((r"(?dm)^[ \t]*(?://|#include|import |def |class )", 2.0), (r"[{};]", 0.5), (r"(?:null|return|function) ", 1.0)),
    "conversation": ((r"(?dm)^[A-Z][A-Za-z0-9_ ]{1,30}: ", 1.5), (r"(?dm)^SPEAKER_[0-9][0-9]:", 2.0), (r"\?", 0.2)),
    "email": ((r"(?dm)^(?:From|To|Subject|Cc): ", 3.0),),
    "web_page": ((r"<[a-zA-Z/][^>\n]{0,200}>", 1.0), (r"https?://", 1.0)),
    "scientific": ((r"\\(?:cite|ref|begin|frac)", 2.0), (r"\[[0-9]+\]", 1.0), (r"(?:table|figure|section) ", 0.5)),
    "technical_docs": ((r"(?dm)^#{1,4} ", 1.5), (r"```", 1.5), (r"`[^`\n]+`", 0.7)),
    "report": ((r"(?:report|review|summary|baseline)", 0.6), (r"[0-9]{3,}", 0.1)),
    "glossary": ((r"(?:glossary|term|index|alias)", 0.7),),
}


def cue_scores(text: Column, cues: dict = CUES, penalty: float = 0.15) -> Column:
    """Array of structs (class, score): log(1 + hits) * weight, minus a share of all other classes' scores.

    Every pattern is counted once; the penalty is taken from the total instead of from each other class.
    """
    own = [sum((F.log1p(F.regexp_count(text, F.lit(p)).cast("double")) * F.lit(w) for p, w in table), F.lit(0.0)) for table in cues.values()]
    names = F.array(*map(F.lit, cues))
    summed = let(F.array(*own), lambda r: F.struct(r.alias("r"), F.aggregate(r, F.lit(0.0), lambda s, x: s + x).alias("t")))
    return let(summed, lambda a: F.zip_with(names, a["r"], lambda c, x: F.struct(c.alias("class"), (x - (a["t"] - x) * penalty).alias("score"))))


def class_distribution(texts: DataFrame, key: str, text: str, temperature: float = 2.0, cues: dict = CUES) -> DataFrame:
    """(key, class, confidence), every class of every text."""
    scored = texts.select(key, F.explode(F.array(cue_scores(F.coalesce(F.col(text), F.lit("")), cues))).alias("s"))
    p = softmax(F.transform("s", lambda x: x["score"]), temperature)
    out = scored.select(key, F.arrays_zip(F.transform("s", lambda x: x["class"]).alias("class"), p.alias("confidence")).alias("z"))
    return out.select(key, F.inline("z"))


def domain_gate(distribution: DataFrame, key: str, floor: float = 0.25, margin: float = 0.15) -> DataFrame:
    """(key, decision, class): abstain below the floor, multi within the margin of the second, else single.

    Best and second come from one aggregation, not from a sort of each group.
    """
    ranked = distribution.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("m"), "class"))).alias("r"))
    best, second = F.get("r", 0), F.get("r", 1)
    decision = F.when(-best["m"] < floor, "abstain").when(-best["m"] - F.coalesce(-second["m"], F.lit(0.0)) < margin, "multi").otherwise("single")
    return ranked.select(key, decision.alias("decision"), best["class"].alias("class"))


def merged_chunks(distribution: DataFrame, key: str, chunks: Column) -> DataFrame:
    """(key, class, confidence) of files from those of their chunks: sums over all chunks, an absent class counts 0."""
    return distribution.groupBy(key, "class").agg((F.sum("confidence") / F.max(chunks)).alias("confidence"))


def cascade(distribution: DataFrame, key: str, tie: float, budget: int, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Ties of the two best classes go to ``judge`` (key, a, b -> key, pick), the closest ``budget`` of them.

    A pick counts only if it is one of the tied classes: it takes both confidences, the other 0.
    """
    w = W.partitionBy(key).orderBy(F.col("confidence").desc(), "class")
    two = distribution.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy(key).agg(F.max_by("class", -F.col("k")).alias("a"), F.max_by("class", "k").alias("b"), (F.max("confidence") - F.min("confidence")).alias("gap"))
    asked = two.where((F.col("gap") < tie) & (F.col("a") != F.col("b"))).orderBy("gap", key).limit(budget)
    picked = asked.join(judge(asked.select(key, "a", "b")), key).where("pick = a OR pick = b").select(key, "a", "b", "pick")
    joined = distribution.join(picked, key, "left")
    both = F.sum(F.when((F.col("class") == F.col("a")) | (F.col("class") == F.col("b")), F.col("confidence"))).over(W.partitionBy(key))
    tied = (F.col("class") == F.col("a")) | (F.col("class") == F.col("b"))
    value = F.when(F.col("pick").isNull() | ~tied, F.col("confidence")).when(F.col("class") == F.col("pick"), both).otherwise(0.0)
    return joined.select(key, "class", value.alias("confidence"))
