"""Long exact spans shared between texts (problem 9).

Texts are cut into content-defined chunks by a gear rolling hash (chunking.py); chunks are deduplicated by digest, and
only those that occur in more than one text go on. Equal texts form one class first, so copies meet once. What is left is
checked exactly on the characters around each chunk: the chunk and what both texts share before and behind it must make
a run of the wanted length. Chunks that many classes share are not paired at all: their classes meet on the exact runs
around the chunk instead, so that a common passage just under the length costs one row per class.

Defined results: null texts and texts shorter than a run share nothing; documents repeated by id count once; a text's
repetition within itself is not sharing; equal texts of at least a run share all of it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.shipping import by_value
from weftgraph.llm.chunking import RUN, text_chunks
from weftgraph.session import Scratch

#: Up to so many classes of a chunk are compared in pairs; beyond, they meet on exact runs.
PAIRED = 32


def text_members(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts long enough with their class k, a 64-bit hash of the text: (doc_id, k, k2, text); and members without text.

    ``k2``, a second hash, keeps members apart should two texts ever meet in k.
    """
    long = documents.where((F.length("text") >= RUN) & F.col("doc_id").isNotNull())
    classed = long.select("doc_id", F.xxhash64("text").alias("k"), F.xxhash64(F.lit("second"), "text").alias("k2"), "text")
    return classed, classed.select("doc_id", "k", "k2").distinct()


def _chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys, texts = batch["k"].to_numpy(), batch["text"].tolist()
        for which, begin, end, digest in text_chunks(texts):
            # A chunk that a text repeats is kept at each place: what surrounds it may differ.
            yield pd.DataFrame({"digest": digest, "k": keys[which], "at": begin, "size": (end - begin).astype(np.int32)})


def shared_chunks(classed: DataFrame, scratch: Scratch) -> DataFrame:
    """(digest, k, at, size, n): the chunks of more than one class, with the number of classes, once per class."""
    chunks, _ = scratch.save(classed.select("k", "text").mapInPandas(_chunked, "digest long, k long, at long, size int"), "chunks")
    # Least and greatest class differ: in more than one. Both are plain numbers, so the sums stay partial and small.
    spread = chunks.groupBy("digest").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("digest")
    found, _ = scratch.save(chunks.join(spread, "digest").distinct(), "shared")
    scratch.drop("chunks")
    scratch.release()
    counts = found.groupBy("digest").agg(F.count_distinct("k").alias("n"))
    return found.join(counts, "digest")


def with_context(shared: DataFrame, classed: DataFrame, scratch: Scratch) -> DataFrame:
    """Shared chunks with the text around them: (digest, k, n, at, size, lead, around), ``lead`` characters before it.

    The texts are thinned out to the classes that share a chunk first; that table of keys is written, so the planner
    knows its size and sends it to the texts if it is small, instead of moving the texts.
    """
    shared, _ = scratch.save(shared, "counted")
    keys, _ = scratch.save(shared.select(F.col("k").alias("c")).distinct(), "keys")
    texts = classed.select(F.col("k").alias("c"), "text").join(keys, "c", "left_semi")
    lead = F.least(F.col("at"), F.lit(RUN)).cast("int")
    joined = texts.join(shared, texts["c"] == shared["k"])
    around = F.substring(F.col("text"), (F.col("at") - lead + 1).cast("int"), lead + F.col("size") + RUN)
    return scratch.save(joined.select("digest", "k", "n", "at", "size", lead.alias("lead"), around.alias("around")).distinct(), "context")[0]


def _common_before(a: str, b: str, i: int, j: int) -> int:
    k = 0
    while k < i and k < j and a[i - 1 - k] == b[j - 1 - k]:
        k += 1
    return k


def _runs(left: pd.DataFrame) -> pd.DataFrame:
    """Per pair of contexts: how far the common run reaches before the chunk and behind its begin; (-1, 0) if unlike."""
    out = []
    for a, b, i, j, size in zip(left["a"], left["b"], left["i"], left["j"], left["size"]):
        if a[i : i + size] != b[j : j + size]:
            out.append((-1, 0))
            continue
        p, q, k = a[i + size :], b[j + size :], 0
        while k < len(p) and k < len(q) and p[k] == q[k]:
            k += 1
        out.append((_common_before(a, b, i, j), size + k))
    return pd.DataFrame(out, columns=["before", "behind"]).astype("int32")


def _paired_runs(context: DataFrame) -> DataFrame:
    """(ka, a_from, a_to, kb, b_from, b_to) of runs around chunks of few classes."""
    few = context.where(F.col("n") <= PAIRED)
    a = few.select("digest", F.col("k").alias("ka"), F.col("at").alias("at_a"), "size", F.col("lead").alias("i"), F.col("around").alias("a"))
    b = few.select("digest", F.col("k").alias("kb"), F.col("at").alias("at_b"), F.col("size").alias("size_b"), F.col("lead").alias("j"), F.col("around").alias("b"))
    pairs = a.join(b, "digest").where("ka < kb AND size = size_b")
    reach = F.pandas_udf(_runs, "before int, behind int")
    measured = pairs.withColumn("r", reach(F.struct("a", "b", "i", "j", "size"))).where(f"r.before >= 0 AND r.before + r.behind >= {RUN}")
    return measured.select("ka", (F.col("at_a") - F.col("r.before")).alias("a_from"), (F.col("at_a") + F.col("r.behind")).alias("a_to"), "kb", (F.col("at_b") - F.col("r.before")).alias("b_from"), (F.col("at_b") + F.col("r.behind")).alias("b_to"))


def _crowded_runs(context: DataFrame) -> DataFrame:
    """(w, w2, k, begin) of every run of exactly the wanted length around chunks of many classes; w and w2 are its key of 128 bits."""
    many = context.where(F.col("n") > PAIRED)
    last = F.least(F.col("lead"), F.length("around") - RUN)
    first = F.greatest(F.lit(0), F.col("lead") + F.col("size") - RUN)
    windows = F.when(last >= first, F.transform(F.sequence(first, last), lambda s: F.struct(F.xxhash64(F.substr("around", s + 1, F.lit(RUN))).alias("w"), F.xxhash64(F.lit(1), F.substr("around", s + 1, F.lit(RUN))).alias("w2"), (F.col("at") - F.col("lead") + s).alias("begin"))))
    return many.select("k", F.explode(windows).alias("x")).select("x.w", "x.w2", "k", "x.begin").distinct()


def _crowds(runs: DataFrame) -> DataFrame:
    """One run's key per distinct set of classes that share a run: runs shared by the same classes count once."""
    per_run = runs.select("w", "w2", "k").distinct().groupBy("w", "w2").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("k").cast("decimal(20,0)")).alias("s"), F.sum(F.xxhash64(F.lit(1), "k").cast("decimal(20,0)")).alias("t"))
    return per_run.where("n > 1").groupBy("n", "s", "t").agg(F.min(F.struct("w", "w2")).alias("r")).select("r.w", "r.w2")


def shared_runs(documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, class pairs (ka, kb) that share a run, and (k, begin, end) of what each class shares with others."""
    classed, members = text_members(documents)
    context = with_context(shared_chunks(classed, scratch), classed, scratch)
    pairs, _ = scratch.save(_paired_runs(context), "pairs")
    crowded, _ = scratch.save(_crowded_runs(context), "crowded")
    scratch.drop("shared", "counted", "keys", "context")
    kept = crowded.join(_crowds(crowded), ["w", "w2"]).select("w", "w2", "k").distinct()
    other = kept.select("w", "w2", F.col("k").alias("kb"))
    met = kept.withColumnRenamed("k", "ka").join(other, ["w", "w2"]).where("ka < kb").select("ka", "kb")
    class_pairs = pairs.select("ka", "kb").unionByName(met).distinct()
    shared_w = crowded.select("w", "w2", "k").distinct().groupBy("w", "w2").count().where("count > 1").select("w", "w2")
    reach = (
        pairs.select(F.col("ka").alias("k"), F.col("a_from").alias("begin"), F.col("a_to").alias("end"))
        .unionByName(pairs.select(F.col("kb").alias("k"), F.col("b_from").alias("begin"), F.col("b_to").alias("end")))
        .unionByName(crowded.join(shared_w, ["w", "w2"], "left_semi").select("k", "begin", (F.col("begin") + RUN).alias("end")))
        .distinct()
    )
    return members, class_pairs, reach


def document_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b, of documents that share a run."""
    members, class_pairs, _ = shared_runs(documents, Scratch(documents.sparkSession, "spans"))
    a, b = members.select(F.col("doc_id").alias("x"), F.col("k").alias("ka"), F.col("k2").alias("ka2")), members.select(F.col("doc_id").alias("y"), F.col("k").alias("kb"), F.col("k2").alias("kb2"))
    between = class_pairs.join(a, "ka").join(b, "kb").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
    within = a.join(b, (F.col("ka") == F.col("kb")) & (F.col("ka2") == F.col("kb2"))).where("x < y").select(F.col("x").alias("doc_id_a"), F.col("y").alias("doc_id_b"))
    return between.unionByName(within)


def shared_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, begin, end): the maximal stretches of each document that runs shared with other documents cover."""
    members, _, reach = shared_runs(documents, Scratch(documents.sparkSession, "spans"))
    order = W.partitionBy("k").orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = reach.withColumn("new", F.when(before >= F.col("begin"), 0).otherwise(1))
    spans = marked.withColumn("i", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy("k", "i").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    copied = members.groupBy("k", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "k2")
    lengths = documents.where(F.length("text") >= RUN).select("doc_id", F.length("text").cast("long").alias("len")).distinct()
    partly = members.join(copied, ["k", "k2"], "left_anti").join(spans, "k").select("doc_id", "begin", "end")
    wholly = members.join(copied, ["k", "k2"], "left_semi").join(lengths, "doc_id").select("doc_id", F.lit(0).cast("long").alias("begin"), F.col("len").alias("end"))
    return partly.unionByName(wholly)


by_value(__name__)
