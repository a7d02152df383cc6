"""Where models plug in: typed functions with deterministic defaults, so that everything behind them can be run."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.shipping import by_value
from weftgraph.functions.text import keyword_score, proper_nouns


def hashed_vector(text: str | None, size: int = 64) -> list[float]:
    """A deterministic stand-in for an embedding: words hashed to signed places, scaled to length 1."""
    v = np.zeros(size)
    for w in (text or "").lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % size] += 1.0 if h >> 63 else -1.0
    n = float(np.linalg.norm(v))
    return (v / n if n else v).tolist()


def embed(text: Column, size: int = 64) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: hashed_vector(t, size)), "array<double>")(text)


def rule_entities(chunks: DataFrame) -> DataFrame:
    """Default extractor: (chunk_id, name, entity_type) of the proper names of each chunk."""
    return chunks.select("chunk_id", F.explode(F.array_distinct(proper_nouns(F.col("content")))).alias("name")).withColumn("entity_type", F.lit("other"))


def rule_relations(chunks: DataFrame) -> DataFrame:
    """Default extractor: neighbouring names of a chunk are related, in order."""
    names = chunks.select("chunk_id", F.array_distinct(proper_nouns(F.col("content"))).alias("n")).where(F.size("n") > 1)
    pairs = F.transform(F.sequence(F.lit(0), F.size("n") - 2), lambda i: F.struct(F.get("n", i).alias("src"), F.get("n", i + 1).alias("dst")))
    return names.select("chunk_id", F.inline(pairs)).withColumn("relation_type", F.array(F.lit("related_to")))


def keyword_checker(claim: Column, source: Column, least: float = 0.5) -> Column:
    return keyword_score(claim, source) >= least


def batched(function: Callable[[pd.Series], pd.Series], returns: str) -> Callable[[Column], Column]:
    """Any vectorised Python function as a column function; inputs should be made distinct before it."""
    return F.pandas_udf(function, returns)


@dataclass
class Pipeline:
    """Graph transforms in configured order; one that is enabled but not listed is reported, not run."""

    steps: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def run(self, graph: DataFrame, order: list[str], enabled: set[str]) -> tuple[DataFrame, list[str]]:
        unlisted = sorted(enabled - set(order))
        chosen = [self.steps[s] for s in order if s in enabled and s in self.steps]
        return reduce(lambda g, f: g.transform(f), chosen, graph), unlisted


by_value(__name__)
