"""Oversized texts to pieces under a limit, cut at natural places (problem 6).

Dynamic programming over boundary positions: every cut pays a penalty by the kind of its place (paragraph, line,
sentence, white space, none) and every piece its squared distance from an even size; a piece, with the overlap it
repeats from the one before, may not exceed the limit. All boundaries of all kinds are candidates; a piece begins at most
a limit before its end, so the work is linear in the length for a given limit. Lengths are code points.

Defined results: null and blank texts give no piece; a text within the limit is one piece; a stretch without any
boundary is cut hard, not inside a carriage return and line feed nor before a joiner or combining mark if the limit
allows; pieces after the first begin ``overlap`` characters before the last cut, and together they cover the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.shipping import by_value

LIMIT, OVERLAP = 4000, 200
#: kinds in order of preference: name, separator between pieces, penalty of a cut there.
KINDS = (
    ("paragraph", re.compile(r"(?>\r\n|\r|\n)(?:[^\S\r\n]*(?>\r\n|\r|\n))+"), 0.0),
    ("line", re.compile(r"(?:\r\n|\r|\n)+"), 0.15),
    ("sentence", re.compile(r"(?<=[.!?])\s+|(?:\r\n|\r|\n)+"), 0.4),
    ("space", re.compile(r"\s+"), 1.0),
)
HARD = 4.0


def boundaries(text: str, kind: int, start: int = 0, end: int | None = None) -> np.ndarray:
    """Separators of one kind within [start, end): an array of (begin, end) rows."""
    found = [m.span() for m in KINDS[kind][1].finditer(text, start, len(text) if end is None else end)]
    return np.array(found, dtype=np.int64).reshape(-1, 2)


def longest_piece(text: str, kind: int) -> int:
    """Length of the longest piece if the text is cut at all places of a kind, separators not counted."""
    b = boundaries(text, kind)
    starts, ends = np.append(0, b[:, 1]), np.append(b[:, 0], len(text))
    return int((ends - starts).max())


def natural_kind(text: str, limit: int = LIMIT) -> str:
    """The first kind whose places leave no piece over the limit, else ``none``."""
    return next((KINDS[k][0] for k in range(len(KINDS)) if longest_piece(text, k) <= limit), "none")


def _hard(text: str, at: int, least: int) -> int:
    """A position at or a little before ``at`` that does not part a cluster of characters."""
    for p in range(at, max(least, at - 16), -1):
        a, b = text[p - 1], text[p] if p < len(text) else " "
        if not (a == "‍" or b in "‍︎️" or unicodedata.combining(b) or "\U0001f3fb" <= b <= "\U0001f3ff" or (a == "\r" and b == "\n")):
            return p
    return at


def _candidates(text: str, step: int, limit: int) -> tuple[np.ndarray, np.ndarray, str]:
    """All cut positions (behind a separator) with the least penalty of a kind that has a place there, and the verdict.

    The verdict is the first kind whose places alone leave no stretch over the limit. Where even the finest places leave
    more than ``step``, hard cuts come in between.
    """
    cost = np.full(len(text) + 1, np.inf)
    verdict = "none"
    for kind in range(len(KINDS) - 1, -1, -1):  # a coarser kind overwrites a finer one
        b = boundaries(text, kind)
        cost[b[:, 1]] = np.where(b[:, 1] < len(text), KINDS[kind][2], 0.0)
        if (np.append(b[:, 0], len(text)) - np.append(0, b[:, 1])).max() <= limit:
            verdict = KINDS[kind][0]
    cost[1 : min(limit - step + 1, len(text))] = np.inf  # a first piece shorter than the overlap would be repeated whole
    cost[[0, -1]] = 0.0
    at = np.flatnonzero(np.isfinite(cost))
    for k in np.flatnonzero(np.diff(at) > step):
        a, b = int(at[k]), int(at[k + 1])
        while b - a > step:
            a = _hard(text, a + step, a + step // 2)
            cost[a] = HARD
    at = np.flatnonzero(np.isfinite(cost))
    return at, cost[at], verdict


def split_plan(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[int], str]:
    """Ends of the pieces of least total cost, the last of them the text's length; and the verdict of _candidates()."""
    n, step = len(text), limit - overlap
    pos, cost, verdict = _candidates(text, step, limit)
    if n <= limit:
        return [n], verdict
    even = n / -(-n // step)
    best, back = np.full(len(pos), np.inf), np.zeros(len(pos), dtype=np.int64)
    best[0] = 0.0
    lows = np.searchsorted(pos, pos - step)  # a piece repeats ``overlap`` characters from before its first cut
    lows[pos <= limit] = 0  # the first repeats nothing, and no cut stands within the overlap
    for i in range(1, len(pos)):
        low = lows[i]
        total = best[low:i] + ((pos[i] - pos[low:i] - even) / even) ** 2
        j = int(total.argmin())
        best[i], back[i] = total[j] + cost[i], low + j
    cuts, i = [], len(pos) - 1
    while i:
        cuts.append(int(pos[i]))
        i = int(back[i])
    return cuts[::-1], verdict


def cut_positions(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Ends of the pieces; the last is the text's length."""
    return split_plan(text, limit, overlap)[0]


def _spans(cuts: list[int], overlap: int) -> list[tuple[int, int]]:
    return list(zip([0] + [max(0, c - overlap) for c in cuts[:-1]], cuts))


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(begin, end) of every piece."""
    return _spans(cut_positions(text, limit, overlap), overlap)


def split_items(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, kind, piece_no, n_pieces, begin, end, piece) of every item with text.

    ``kind`` is the natural place that suffices, null for texts within the limit, which never leave the JVM.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, kind string, piece_no int, n_pieces int, begin int, end int, piece string"
    blank = ~F.coalesce(F.col(text).rlike(r"[^\p{IsWhite_Space}]"), F.lit(False))
    rows = df.select(F.col(key), F.col(text).alias("__t")).where(~blank.alias("b")) if text == "__t" else df.where(~blank).select(F.col(key), F.col(text).alias("__t"))
    whole = rows.where(F.length("__t") <= limit).select(
        key, F.lit(None).cast("string").alias("kind"), F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("begin"), F.length("__t").alias("end"), F.col("__t").alias("piece")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch["__t"]):
                cuts, kind = split_plan(t, limit, overlap)
                spans = _spans(cuts, overlap)
                out += [(k, kind, i + 1, len(spans), a, b, t[a:b]) for i, (a, b) in enumerate(spans)]
            yield pd.DataFrame(out, columns=[key, "kind", "piece_no", "n_pieces", "begin", "end", "piece"])

    return whole.unionByName(rows.where(F.length("__t") > limit).mapInPandas(run, schema))


def oversized_kinds(pieces_: DataFrame, key: str) -> DataFrame:
    """(key, kind) of the items that split_items() had to cut."""
    return pieces_.where("n_pieces > 1 AND piece_no = 1").select(key, "kind")


def broken_chunk_counts(checkpoints: DataFrame, key: str = "cp_key") -> DataFrame:
    """(file_path, n_rows, total_chunks, ok): whether a file's rows have one non-null total n and the indexes 1..n."""
    rows = checkpoints.select(key, "file_path", "chunk_index", "total_chunks").where(F.col("file_path").isNotNull()).distinct()
    per_file = rows.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("total_chunks").alias("n_totals"),
        F.min("total_chunks").alias("least"),
        F.max("total_chunks").alias("most"),
        F.count("chunk_index").alias("n_indexes"),
        F.min("chunk_index").alias("first"),
        F.max("chunk_index").alias("last"),
        F.count_distinct("chunk_index").alias("n_distinct"),
    )
    same = (F.col("n_totals") == F.col("n_rows")) & (F.col("least") == F.col("most"))
    full = (F.col("n_indexes") == F.col("n_rows")) & (F.col("n_distinct") == F.col("n_rows")) & (F.col("first") == 1) & (F.col("last") == F.col("most")) & (F.col("n_rows") == F.col("most"))
    return per_file.select("file_path", "n_rows", F.col("most").alias("total_chunks"), F.coalesce(same & full, F.lit(False)).alias("ok"))


def piece_bounds(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """The pieces of a text as an array of (begin, end), for use inside other plans."""
    udf = F.pandas_udf(lambda s: s.map(lambda t: [] if t is None else [{"begin": a, "end": b} for a, b in pieces(t, limit, overlap)]), "array<struct<begin:int,end:int>>")
    return udf(text)


by_value(__name__)
