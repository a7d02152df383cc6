"""Resume, registries, lineage and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_key(path: Column, chunk: Column, model: Column, prompt: Column, extra: Column, content: Column) -> Column:
    """SHA-1 resume key of a chunk: where it is, what makes it, and its content."""
    head = F.concat_ws(" ", path, chunk.cast("string"), model, prompt, extra, F.lit(""))
    return F.sha1(F.concat(head, F.coalesce(content, F.lit(""))))


def not_done(chunks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return chunks.join(done.select(key).distinct(), key, "left_anti")


def latest(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key; ties by the whole order."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(key, *[F.col(f"__r.{c}") for c in rest])


def reciprocal_progress(chunks: DataFrame, file: str, index: str, total: str) -> DataFrame:
    """(file, done, total, share) of files by their finished chunks."""
    per = chunks.groupBy(file).agg(F.count_distinct(index).alias("done"), F.max(total).alias("total"))
    return per.withColumn("share", F.coalesce(F.try_divide("done", "total"), F.lit(0.0)))


def entity_trace(events: DataFrame) -> DataFrame:
    """(name, mentions, chunks, forms) of extraction events (name, chunk, form), forms in order."""
    return events.groupBy("name").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("chunk").alias("chunks"), F.array_sort(F.collect_set("form")).alias("forms"))


def stage_counts(events: DataFrame, stage: str) -> DataFrame:
    return events.groupBy(stage).agg(F.count(F.lit(1)).alias("n"))


def merged_ledger(prior: DataFrame, this: DataFrame) -> DataFrame:
    """Cumulative calls, tokens and cost per model."""
    return prior.unionByName(this).groupBy("model").agg(*[F.sum(c).alias(c) for c in ("calls", "tokens", "cost")])


def entity_split(names: DataFrame, name: str, held_out: int = 15, valid: int = 8, seed: int = 42) -> DataFrame:
    """Train, valid or held-out by a hash of the entity, so that no entity is on two sides."""
    draw = F.pmod(F.xxhash64(F.col(name), F.lit(seed)), F.lit(100))
    return names.withColumn("side", F.when(draw < held_out, "held_out").when(draw < held_out + valid, "valid").otherwise("train"))
