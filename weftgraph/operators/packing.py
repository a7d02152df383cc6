"""Chunking and packing of texts and turns, speech segments, interval joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.shipping import by_value

SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", "")
SIZE, OVERLAP = 2000, 100


def recursive_pieces(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size``: split at the coarsest separator there is, finer ones where a part is still too long.

    Neighbouring parts are put together up to the size; a piece begins with the last parts of the one before it that
    fit in the overlap.
    """
    if len(text) <= size:
        return [text] if text else []
    mark = next(s for s in separators if s == "" or s in text)
    finer = separators[separators.index(mark) + 1 :] or ("",)
    raw = list(text) if mark == "" else [p + mark for p in text.split(mark)[:-1]] + [text.split(mark)[-1]]
    out: list[str] = []
    held: list[str] = []
    length = 0
    for part in (p for p in raw if p):
        if len(part) > size:
            if held:
                out.append("".join(held))
                held, length = [], 0
            out += recursive_pieces(part, size, overlap, finer)
            continue
        if length + len(part) > size:
            out.append("".join(held))
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    if held:
        out.append("".join(held))
    return [p.strip() for p in out if p.strip()]


def split_texts(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, idx, total, content): pieces of every text; texts within the size stay in the JVM as one piece."""
    rows = df.select(key, F.coalesce(text, F.lit("")).alias("t"))
    whole = rows.where((F.length("t") <= size) & (F.length("t") > 0)).select(key, F.lit(1).alias("idx"), F.lit(1).alias("total"), F.col("t").alias("content"))
    cut = F.pandas_udf(lambda s: s.map(lambda t: recursive_pieces(t, size, overlap)), "array<string>")
    many = rows.where(F.length("t") > size).select(key, cut("t").alias("p")).select(key, F.size("p").alias("total"), F.posexplode("p").alias("i", "content"))
    return whole.unionByName(many.select(key, (F.col("i") + 1).cast("int").alias("idx"), "total", "content"))


def running_offsets(pieces: DataFrame, key: str, overlap: int = OVERLAP) -> DataFrame:
    """Approximate start and end of each piece: lengths so far, less the overlap of all pieces after the first."""
    before = W.partitionBy(key).orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    sums = F.coalesce(F.sum(F.length("content")).over(before), F.lit(0))
    start = sums - F.greatest(F.col("idx") - 2, F.lit(0)) * overlap
    return pieces.withColumn("start", start.cast("long")).withColumn("end", F.col("start") + F.length("content"))


def reindexed(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``idx`` 1 .. n and ``total`` n within the keys."""
    return df.withColumn("idx", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).withColumn("total", F.count(F.lit(1)).over(W.partitionBy(*keys)))


def _packer(size: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None  # (path, conversation), number, lines, length, speakers, first time

        def done():
            key, n, lines, _, who, when = state
            return (*key, n, "\n".join(lines), next(iter(who)) if len(who) == 1 else None, when, len(lines))

        columns = ["source_path", "conversation", "pack_no", "content", "speaker", "occurred_at", "n_lines"]
        for batch in batches:
            out = []
            for path, conv, speaker, text, when in zip(batch["source_path"], batch["conversation"], batch["speaker"], batch["text"], batch["occurred_at"]):
                key = (path, int(conv))
                speaker, label = speaker or "", f"{speaker}: " if speaker else ""
                room = max(1, size - len(label))
                for part in [text[i : i + room] for i in range(0, len(text), room)]:
                    line = label + part
                    if state and (state[0] != key or state[3] + 1 + len(line) > size):
                        out.append(done())
                        state = (key, state[1] + 1 if state[0] == key else 1, [], 0, set(), None)
                    elif not state:
                        state = (key, 1, [], 0, set(), None)
                    k, n, lines, length, who, first = state
                    lines.append(line)
                    who.add(speaker)
                    state = (k, n, lines, length + len(line) + (len(lines) > 1), who, first or when or None)
            yield pd.DataFrame(out, columns=columns)
        if state:
            yield pd.DataFrame([done()], columns=columns)

    return pack


def pack_turns(turns: DataFrame, size: int = SIZE) -> DataFrame:
    """Turns packed in order into chunks of at most ``size`` characters, never across conversations.

    A turn beyond the size is split, its label repeated; a pack has a speaker if it is one speaker's, and the first time
    that any of its turns has. Rows stream through a task in order; only one pack is held at a time.
    """
    said = turns.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(F.coalesce("source_path", F.lit("")).alias("source_path"), F.coalesce("conversation", F.lit(-1)).alias("conversation"), "turn_no", "turn_id", "speaker", "text", "occurred_at")
    ordered = said.repartition("source_path", "conversation").sortWithinPartitions("source_path", "conversation", "turn_no", "turn_id")
    return ordered.mapInPandas(_packer(size), "source_path string, conversation int, pack_no int, content string, speaker string, occurred_at string, n_lines int")


def closed_gaps(segments: DataFrame, key: str, gap: float) -> DataFrame:
    """(key, start, end): segments that follow within ``gap`` put together; the end is the last segment's."""
    w = W.partitionBy(key).orderBy("start", "end")
    new = F.when(F.col("start") - F.lag("end").over(w) <= gap, 0).otherwise(1)
    island = segments.withColumn("new", new).withColumn("i", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(key, "i").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end")).drop("i")


def silences(segments: DataFrame, key: str) -> DataFrame:
    """(key, start, end) between segments, where nobody speaks."""
    w = W.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    return segments.select(key, before.alias("a"), F.col("start").alias("b")).where("a < b").select(key, F.col("a").alias("start"), F.col("b").alias("end"))


def overlap_join(segments: DataFrame, turns: DataFrame, key: str, step: float = 30.0) -> DataFrame:
    """Each segment (key, seg, start, end) with the turn (key, turn, start, end) it overlaps most; the first of equals.

    Both sides are cut into steps of time and meet in an equi-join on (key, step).
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / step), F.floor(F.col(b) / step)))
    s = segments.where("start < end").select(key, "seg", F.col("start").alias("a"), F.col("end").alias("b"), cells("start", "end").alias("cell"))
    t = turns.where("start < end").select(F.col(key).alias("__k"), "turn", F.col("start").alias("c"), F.col("end").alias("d"), cells("start", "end").alias("__cell"))
    met = s.join(t, (s[key] == t["__k"]) & (s["cell"] == t["__cell"])).where("a < d AND c < b").withColumn("overlap", F.least("b", "d") - F.greatest("a", "c"))
    return met.groupBy(key, "seg").agg(F.max_by("turn", F.struct("overlap", (-F.col("c")).alias("x"), (-F.col("turn")).alias("y"))).alias("turn"), F.max("overlap").alias("overlap"))


def capped_per_group(df: DataFrame, keys: list[str], order: list, cap: int) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__k") <= cap).drop("__k")


def audio_boundaries(pauses: list[tuple[float, float]], length: float, target: float = 300.0, most: float = 600.0) -> list[tuple[float, float]]:
    """Chunks of a recording cut in the middle of the first pause past the target, at the latest at the maximum."""
    out, begin = [], 0.0
    middles = sorted((a + b) / 2 for a, b in pauses)
    while length - begin > target:
        cut = next((m for m in middles if begin + target <= m <= begin + most), min(begin + most, length))
        out.append((begin, cut))
        begin = cut
    if begin < length:
        out.append((begin, length))
    return out


def stitched_speakers(centroids: list[tuple[int, str, list[float]]], least: float = 0.45) -> dict[tuple[int, str], int]:
    """Local speakers of consecutive chunks to global ones: each joins the nearest known voice, which moves to the mean."""
    import numpy as np

    known: list[tuple[object, int]] = []
    out: dict[tuple[int, str], int] = {}
    for chunk, name, vector in centroids:
        v = np.asarray(vector, dtype=float)
        size = np.linalg.norm(v)
        sims = [float(k @ v / (np.linalg.norm(k) * size)) if size and np.linalg.norm(k) else -1.0 for k, _ in known]
        best = max(range(len(sims)), key=sims.__getitem__, default=-1)
        if best >= 0 and sims[best] >= least:
            k, n = known[best]
            known[best] = ((k * n + v) / (n + 1), n + 1)
            out[chunk, name] = best
        else:
            known.append((v, 1))
            out[chunk, name] = len(known) - 1
    return out


by_value(__name__)
