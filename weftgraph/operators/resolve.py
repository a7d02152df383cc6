"""Entity resolution: exact and fuzzy merges of names, their relations and observations, supersession of facts."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.shipping import by_value
from weftgraph.functions.similarity import name_similarity
from weftgraph.functions.text import ANTONYMS, NEGATION, digit_signature, normal_name

FILE_TYPES = ("file", "document", "config")


def elected_types(mentions: DataFrame, key: str) -> DataFrame:
    """(key, entity_type) by majority of the types that are not ``other``; ties go to the first mention by ``ord``."""
    counts = mentions.groupBy(key, "entity_type").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    specific = F.coalesce(F.col("entity_type") != "other", F.lit(False))
    return counts.groupBy(key).agg(F.max_by("entity_type", F.struct(specific.alias("s"), "n", (-F.col("first")).alias("f"))).alias("entity_type"))


def exact_merge(mentions: DataFrame) -> DataFrame:
    """(norm, name, entity_type, n_mentions, files) per normal name; the first surface form by ``ord`` is the name.

    Mentions have name, entity_type, file, ord. Artefacts of files keep their file in their identity.
    """
    artefact = F.when(F.col("entity_type").isin(*FILE_TYPES), F.concat(F.lit("␟"), F.col("file"))).otherwise("")
    keyed = mentions.where(F.col("name").isNotNull()).withColumn("norm", F.concat(normal_name(F.col("name")), artefact))
    files = F.array_sort(F.collect_set(F.when(F.col("file") != "unknown", F.col("file"))))
    merged = keyed.groupBy("norm").agg(F.min_by("name", "ord").alias("name"), F.count(F.lit(1)).alias("n_mentions"), F.when(F.size(files) == 0, F.array(F.lit("unknown"))).otherwise(files).alias("files"))
    return merged.join(elected_types(keyed, "norm"), "norm")


def rename_map(mentions: DataFrame, merged: DataFrame) -> DataFrame:
    """(surface, canonical) of every surface form."""
    return mentions.select(F.col("name").alias("surface"), normal_name(F.col("name")).alias("norm")).distinct().join(merged.select("norm", F.col("name").alias("canonical")), "norm").select("surface", "canonical")


def rename_ends(relations: DataFrame, renames: DataFrame) -> DataFrame:
    """Relations with both ends replaced by their canonical names, unknown ends kept."""
    a, b = renames.select(F.col("surface").alias("__s"), F.col("canonical").alias("__a")), renames.select(F.col("surface").alias("__d"), F.col("canonical").alias("__b"))
    joined = relations.join(a, relations["src"] == a["__s"], "left").join(b, relations["dst"] == b["__d"], "left")
    return joined.withColumns({"src": F.coalesce("__a", "src"), "dst": F.coalesce("__b", "dst")}).drop("__s", "__a", "__d", "__b")


class _Reachable:
    """Kept names that can reach a similarity: an upper bound of Jaro-Winkler from lengths, shared characters and prefix.

    No more characters match than both names hold, whatever their places, so what is left out is below the threshold.
    """

    def __init__(self, n: int):
        self.n = 0
        self.held, self.size, self.first = np.zeros((n, 64), np.int16), np.zeros(n), np.zeros((n, 4), np.int32)

    @staticmethod
    def _of(name: str) -> tuple[np.ndarray, int, np.ndarray]:
        codes = np.array([ord(c) for c in name.lower()], np.int32)
        return np.bincount(codes % 64, minlength=64).astype(np.int16), max(1, len(codes)), codes[:4]

    def add(self, name: str) -> None:
        held, size, first = self._of(name)
        self.held[self.n], self.size[self.n], self.first[self.n, : len(first)] = held, size, first
        self.n += 1

    def bounds(self, name: str, least: float) -> list[tuple[int, float]]:
        held, size, first = self._of(name)
        begins = np.full(4, -1)
        begins[: len(first)] = first
        near = np.flatnonzero((2 + np.minimum(self.size[: self.n], size) / np.maximum(self.size[: self.n], size)) / 3 * 0.6 + 0.4 >= least - 1e-9)
        shared = np.minimum(self.held[near], held).sum(axis=1)
        score = (shared / self.size[near] + shared / size + 1) / 3
        score += np.cumprod(self.first[near] == begins, axis=1).sum(axis=1) * 0.1 * (1 - score)
        reach = score >= least - 1e-9
        return list(zip(near[reach].tolist(), (score[reach] + 1e-9).tolist()))


def _fold(least: float, cross: float):
    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord")
        kept: list[tuple[str, str, str]] = []
        reachable = _Reachable(len(group))
        exact: dict[str, int] = {}
        out = []
        for name, norm, kind in zip(group["name"], group["norm"], group["entity_type"]):
            if norm in exact:
                out.append((name, kept[exact[norm]][0], 1.0))
                continue
            best, at = 0.0, -1
            for i, most in reachable.bounds(name, least):
                other, _, other_kind = kept[i]
                need = least if kind == other_kind or "other" in (kind, other_kind) or not kind or not other_kind else max(least, cross)
                if most < need or most <= best:
                    continue
                s = name_similarity(name, other)
                if s >= need and s > best:
                    best, at = s, i
            if at >= 0:
                out.append((name, kept[at][0], best))
                exact[norm] = at
            else:
                exact[norm] = len(kept)
                kept.append((name, norm, kind))
                reachable.add(name)
                out.append((name, name, 1.0))
        return pd.DataFrame(out, columns=["surface", "canonical", "sim"])

    return fold


def fuzzy_merge(mentions: DataFrame, least: float = 0.9, cross: float = 0.95, block: Column | None = None) -> DataFrame:
    """(surface, canonical, sim): a sequential fold of distinct names within blocks of one digit signature.

    Names of different digit signatures never merge, so the blocks lose nothing; ``block`` narrows them further where
    that is wanted (it then also rules merges across it out). Thresholds: ``cross`` for two different specific types.
    """
    first = mentions.where(F.col("name").isNotNull()).groupBy("name").agg(F.min_by("entity_type", "ord").alias("entity_type"), F.min("ord").alias("ord"))
    keyed = first.withColumns({"norm": normal_name(F.col("name")), "digits": digit_signature(F.col("name")), "block": block if block is not None else F.lit("")})
    return keyed.groupBy("digits", "block").applyInPandas(_fold(least, cross), "surface string, canonical string, sim double")


def fold_observations(observations: DataFrame) -> DataFrame:
    """Equal texts of an entity once, the first by ``ord``."""
    rest = [c for c in observations.columns if c not in ("name", "text")]
    first = observations.groupBy("name", "text").agg(F.min_by(F.struct(*rest), "ord").alias("__r"))
    return first.select("name", "text", *[F.col(f"__r.{c}") for c in rest])


def _near_duplicates(least: float):
    def keep(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord").reset_index(drop=True)
        grams = [set(re.findall(r"\w+", t.lower())) for t in group["text"]]
        gone: set[int] = set()
        for i in range(len(group)):
            if i in gone:
                continue
            for j in range(i + 1, len(group)):
                if j in gone or not grams[i] or not grams[j]:
                    continue
                if len(grams[i] & grams[j]) / (len(grams[i]) * len(grams[j])) ** 0.5 >= least:
                    if len(group["text"][i]) >= len(group["text"][j]):
                        gone.add(j)
                    else:
                        gone.add(i)
                        break
        return group.drop(index=list(gone))

    return keep


def near_duplicate_observations(observations: DataFrame, least: float = 0.9) -> DataFrame:
    """Observations of one entity, source and speaker without those that another says at greater length.

    Alike means a cosine of word sets of at least ``least`` (the default embedder of this package).
    """
    schema = observations.schema
    return observations.groupBy("name", "source", "speaker").applyInPandas(_near_duplicates(least), schema)


def _contradict(a: str, b: str) -> bool:
    la, lb = a.lower(), b.lower()
    words = lambda s: {w for w in re.split(r"[^a-z0-9]+", re.sub(NEGATION, " ", s, count=1)) if len(w) > 3}
    wa, wb = words(la), words(lb)
    has = lambda s, w: re.search(rf"\b{w}\b", s) is not None
    for x, y in ANTONYMS:
        if ((has(la, x) and has(lb, y)) or (has(la, y) and has(lb, x))) and (wa & wb) - {x, y}:
            return True
    if (re.search(NEGATION, la) is None) != (re.search(NEGATION, lb) is None) and wa and wb:
        return len(wa & wb) / len(wa | wb) >= 0.5
    return False


def _superseded(now: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord").reset_index(drop=True)
        invalid, expired = group["invalid_at"].tolist(), group["expired_at"].tolist()
        valid, texts = group["valid_at"].tolist(), group["text"].tolist()
        for i in range(len(group)):
            for j in range(i + 1, len(group)):
                if not valid[i] or not valid[j] or valid[i] == valid[j] or expired[i] or expired[j] or not _contradict(texts[i], texts[j]):
                    continue
                old, new = (i, j) if valid[i] < valid[j] else (j, i)
                invalid[old], expired[old] = valid[new], now
        return group.assign(invalid_at=invalid, expired_at=expired)

    return run


def supersede(observations: DataFrame, now: str) -> DataFrame:
    """Of two dated facts of an entity that contradict each other, the older ends where the newer begins.

    Facts are kept; one that has been superseded takes no further part. Times are ISO strings, compared as text.
    """
    return observations.groupBy("name").applyInPandas(_superseded(now), observations.schema)


def canonical_names(members: DataFrame, degrees: DataFrame) -> DataFrame:
    """(cluster, canonical): the member of highest degree, ties by least name."""
    scored = members.join(degrees.select("name", "degree"), "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    w = W.partitionBy("cluster").orderBy(F.col("degree").desc(), "name")
    return scored.withColumn("k", F.row_number().over(w)).where("k = 1").select("cluster", F.col("name").alias("canonical"))


def merge_policy(sim: Column, a: Column, b: Column, low: float = 0.72, high: float = 0.88, method: str = "hybrid") -> Column:
    """``merge``, ``reject`` or ``ask`` of a candidate pair; names with different digits are always rejected."""
    same = digit_signature(a) == digit_signature(b)
    if method == "embeddings":
        return F.when(same & F.coalesce(sim >= high, F.lit(False)), "merge").otherwise("reject")
    return F.when(~same | F.coalesce(sim < low, F.lit(True)), "reject").when(sim >= high, "merge").otherwise("ask")


by_value(__name__)
