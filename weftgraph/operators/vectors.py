"""Vector search and clustering of embeddings (id, vec array)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.shipping import by_value
from weftgraph.functions.similarity import cosine
from weftgraph.operators.graph import connected_components


def unit_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) scaled to length 1; null, empty and zero vectors have no direction and are left out."""
    size = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v"), size.alias("n")).where("n > 0")
    return rows.select("id", F.transform("v", lambda x: (x.cast("double") / F.col("n"))).alias("vec"))


def similar_pairs(vectors: DataFrame, least: float, block_rows: int = 512) -> DataFrame:
    """(a, b, sim), a < b, of all pairs with cosine of at least ``least``: exact, in blocks of rows.

    Rows are dealt to blocks by hash, and every pair of blocks meets in one task as a matrix product. Only what passes
    the threshold leaves the task.
    """
    n = max(1, -(-vectors.count() // block_rows))
    keyed = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    # Block i is sent to the tasks (min(i, j), max(i, j)) of every j; the side tells the two halves of a task apart.
    seats = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct(F.least("block", j).alias("p"), F.greatest("block", j).alias("q"), F.when(F.col("block") <= j, 0).otherwise(1).alias("side"))))
    seated = keyed.select("id", "vec", seats.alias("s")).select("id", "vec", "s.p", "s.q", "s.side")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        same = bool((group["p"] == group["q"]).all())
        left = group if same else group[group["side"] == 0]
        right = group if same else group[group["side"] == 1]
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "sim": []})
        x, y = np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy())
        sim = x @ y.T
        i, j = np.nonzero(sim >= least)
        a, b = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        keep = a < b if same else np.ones(len(a), bool)
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "sim": sim[i, j][keep]})

    return seated.groupBy("p", "q").applyInPandas(meet, "a long, b long, sim double")


def top_neighbours(vectors: DataFrame, queries: DataFrame, k: int, rows: int = 2048) -> DataFrame:
    """(query, id, sim, rank) of the ``k`` nearest of all vectors for each query, itself aside; exact.

    The queries are the given set, sent in blocks; each block's best k are kept per task before they are merged.
    """
    n = max(1, -(-queries.count() // rows))
    blocks = queries.select(F.col("id").alias("query"), F.col("vec").alias("q"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"))
    packed = blocks.groupBy("block").agg(F.collect_list(F.struct("query", "q")).alias("qs"))  # at most about ``rows`` queries each
    parts = vectors.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(8 * n)).cast("int"))
    tasks = parts.select("id", "vec", "part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))

    def best(key, group: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if group.empty or qs.empty:
            return pd.DataFrame({"query": [], "id": [], "sim": []})
        items = [(x["query"], x["q"]) for x in qs["qs"].iloc[0]]
        q, x = np.stack([np.asarray(v, dtype=float) for _, v in items]), np.stack(group["vec"].to_numpy())
        sim, ids = q @ x.T, group["id"].to_numpy()
        out = []
        for i, (name, _) in enumerate(items):
            s = np.where(ids == name, -np.inf, sim[i])
            order = np.lexsort((ids, -s))[:k]
            out += [(name, ids[o], s[o]) for o in order if np.isfinite(s[o])]
        return pd.DataFrame(out, columns=["query", "id", "sim"])

    copies = packed.select("qs", "block", F.explode(F.sequence(F.lit(0), F.lit(8 * n - 1))).alias("part"))
    found = tasks.groupBy("part", "block").cogroup(copies.groupBy("part", "block")).applyInPandas(best, "query long, id long, sim double")
    w = W.partitionBy("query").orderBy(F.col("sim").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def symmetric_blocks(neighbours: DataFrame) -> DataFrame:
    """Unordered pairs in which either side has the other among its best."""
    return neighbours.select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))


def single_linkage(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, cluster): components of the pairs, named by their least id."""
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return connected_components(edges, ids.select(F.col("id").alias("name"))).select(F.col("name").alias("id"), F.col("component").alias("cluster"))


def _complete(group: pd.DataFrame) -> pd.DataFrame:
    """Greedy complete linkage of one component: the tightest admissible merge first, until none is left."""
    sim: dict[tuple[int, int], float] = {}
    for a, b, s in zip(group["a"], group["b"], group["sim"]):
        sim[a, b] = sim[b, a] = s
    clusters = {i: [i] for i in sorted({*group["a"], *group["b"]})}
    between = {(a, b): s for (a, b), s in sim.items() if a < b}
    while between:
        (a, b), _ = max(between.items(), key=lambda x: (x[1], -x[0][0], -x[0][1]))
        clusters[a] += clusters.pop(b)
        for c in list(clusters):
            ab, cb = between.pop((min(a, c), max(a, c)), None), between.pop((min(b, c), max(b, c)), None)
            if c != a and ab is not None and cb is not None:
                between[min(a, c), max(a, c)] = min(ab, cb)
        between = {k: v for k, v in between.items() if b not in k}
    return pd.DataFrame([(m, k) for k, ms in clusters.items() for m in ms], columns=["id", "cluster"])


def complete_linkage(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, cluster): no two members of a cluster are less alike than the pairs' threshold.

    No such cluster crosses a component of the pairs, so every component is clustered on its own.
    """
    component = single_linkage(pairs, ids)
    held = pairs.join(component.select(F.col("id").alias("a"), "cluster"), "a")
    merged = held.groupBy("cluster").applyInPandas(lambda g: _complete(g), "id long, cluster long")
    alone = ids.select("id").join(merged.select("id"), "id", "left_anti")
    return merged.unionByName(alone.select("id", F.col("id").alias("cluster")))


def histogram(pairs: DataFrame, buckets: int = 20) -> DataFrame:
    return pairs.groupBy(F.least(F.greatest(F.floor(F.col("sim") * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def fused_ranks(scored: DataFrame, k: int = 60) -> DataFrame:
    """(query, id, s1, s2) with reciprocal-rank fusion of the two scores."""
    r = lambda c: F.row_number().over(W.partitionBy("query").orderBy(F.col(c).desc(), "id"))
    return scored.withColumns({"r1": r("s1"), "r2": r("s2")}).withColumn("rrf", 1 / (F.col("r1") + k) + 1 / (F.col("r2") + k))


def grounding_triples(nearest: DataFrame, incident: DataFrame) -> DataFrame:
    """(query, context): incident triples of the nearest nodes in rank order, each once, joined by '. '."""
    joined = nearest.join(incident, nearest["id"] == incident["node"]).groupBy("query", "triple").agg(F.min("rank").alias("rank"))
    return joined.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "triple"))), lambda x: x["triple"]), ". ").alias("context"))


def retrieval(entities: DataFrame, query: DataFrame, least: float = 0.3, limit: int = 10) -> DataFrame:
    """Entities (id, vec, name) relevant to one-row ``query`` (query_vec, terms): by name terms or vectors, best score first."""
    joined = entities.withColumns({c: query.select(c).scalar() for c in ("query_vec", "terms")})
    by_name = F.exists("terms", lambda t: F.lower("name").contains(F.lower(t)))
    sim = cosine(F.col("vec"), F.col("query_vec"))
    score = F.greatest(F.when(by_name, F.lit(1.0)), F.when(sim > least, sim))
    return joined.select("id", "name", F.round(score, 6).alias("score")).where("score IS NOT NULL").orderBy(F.col("score").desc(), "id").limit(limit)


by_value(__name__)
