"""Fixed-capacity containers filled with little waste (problem 7).

Large-item matching on counts: items over a third of the capacity go at most two to a bin, each with the largest
partner that still fits; smaller items then fill the smallest gap that takes them, largest first. Only the size
histogram (at most ``capacity`` numbers) is planned with, so the plan is global and its size bounded by the capacity;
which document takes which place follows from its rank among the documents of its size, numbered in buckets, so that a
size shared by any number of documents never meets in one task. Items above the capacity are cut into full containers
and one remainder; nothing else is cut.

Defined results: documents without tokens get no container; documents repeated by id count once; an empty corpus gives
no bins; ties are broken by size only, then by the hash bucket and id of the document.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.tokens import token_count
from weftgraph.operators.ranks import bucketed_rank

CAPACITY = 1024


def token_pieces(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, tokens, min_pieces) once per document with tokens."""
    sized = documents.select("doc_id", token_count(F.col("text")).cast("int").alias("tokens"))
    once = sized.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("tokens").alias("tokens")).where("tokens > 0")
    return once.withColumn("min_pieces", F.ceil(F.col("tokens") / F.lit(capacity)).cast("int"))


class Plan:
    """Classes of equal bins: how many bins, what is in each, what gap is left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bins: list[int] = []
        self.slots: list[dict[int, int]] = []
        self.by_gap: dict[int, list[int]] = defaultdict(list)

    def new(self, n: int, slots: dict[int, int]) -> None:
        k = len(self.bins)
        self.bins.append(n)
        self.slots.append(slots)
        self.by_gap[self.capacity - sum(s * c for s, c in slots.items())].append(k)

    def fill(self, gap: int, size: int, left: int) -> int:
        """Put items of ``size`` into bins with this gap, as many to a bin as fit; how many items remain."""
        each = gap // size
        for k in list(self.by_gap[gap]):
            if not left:
                break
            full = min(self.bins[k], left // each)
            rest = left - full * each if full < self.bins[k] else 0
            self.by_gap[gap].remove(k)
            old, n = self.slots[k], self.bins[k]
            parts = [(full, each), (1, rest) if rest else (0, 0), (n - full - bool(rest), 0)]
            first = True
            for count, items in parts:
                if count <= 0:
                    continue
                slots = old | ({size: old.get(size, 0) + items} if items else {})
                if first:
                    self.bins[k], self.slots[k] = count, slots
                    self.by_gap[gap - items * size].append(k)
                    first = False
                else:
                    self.new(count, slots)
            left -= full * each + rest
        return left


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for a histogram of sizes 1 .. capacity."""
    plan = Plan(capacity)
    large = {s: n for s, n in histogram.items() if s * 3 > capacity and n}
    for size in sorted(large, reverse=True):
        while large[size]:
            mates = [s for s in large if large[s] and s <= min(size, capacity - size) and (s != size or large[s] > 1)]
            if not mates:
                plan.new(large[size], {size: 1})
                large[size] = 0
            elif (mate := max(mates)) == size:
                plan.new(large[size] // 2, {size: 2})
                large[size] %= 2
            else:
                n = min(large[size], large[mate])
                plan.new(n, {size: 1, mate: 1})
                large[size] -= n
                large[mate] -= n
    for size in sorted((s for s in histogram if s * 3 <= capacity), reverse=True):
        left = histogram[size]
        while left:
            gap = min((g for g, ks in plan.by_gap.items() if ks and g >= size), default=0)
            if gap:
                left = plan.fill(gap, size, left)
            else:
                each = capacity // size
                if left // each:
                    plan.new(left // each, {size: each})
                if left % each:
                    plan.new(1, {size: left % each})
                left = 0
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(bin_id, doc_id, piece_no, first_token, tokens): the container of every piece."""
    spark = pieces.sparkSession
    full = pieces.where(F.col("tokens") >= capacity).select("doc_id", "tokens", F.explode(F.sequence(F.lit(1), F.floor(F.col("tokens") / capacity).cast("int"))).alias("piece_no"))
    fulls = full.select(F.concat_ws("-", F.lit("f"), "doc_id", "piece_no").alias("bin_id"), "doc_id", "piece_no", ((F.col("piece_no") - 1) * capacity).alias("first_token"), F.lit(capacity).alias("tokens"))
    rest = pieces.select("doc_id", (F.floor(F.col("tokens") / capacity) + 1).cast("int").alias("piece_no"), (F.col("tokens") - F.pmod("tokens", F.lit(capacity))).alias("first_token"), F.pmod("tokens", F.lit(capacity)).alias("size")).where("size > 0")
    histogram = {r["size"]: r["n"] for r in rest.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity - 1 rows
    plan = plan_bins(histogram, capacity)
    rows, used, base = [], defaultdict(int), 0
    for n, slots in zip(plan.bins, plan.slots):
        for size, each in slots.items():
            rows.append((size, used[size], used[size] + n * each, base, each))
            used[size] += n * each
        base += n
    places = spark.createDataFrame(rows, "size int, from_rank long, to_rank long, first_bin long, each int")
    # One array of places per size (the plan's bounded size): every item looks its own up, no row is multiplied.
    lookup = places.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("from_rank", "to_rank", "first_bin", "each"))).alias("places"))
    ranked = bucketed_rank(rest, ["size"], ["doc_id"], "rank")
    hit = F.get(F.filter("places", lambda p: (p["from_rank"] <= F.col("rank")) & (F.col("rank") < p["to_rank"])), 0)
    placed = ranked.join(F.broadcast(lookup), "size").withColumn("p", hit)
    bin_no = F.col("p.first_bin") + F.floor((F.col("rank") - F.col("p.from_rank")) / F.col("p.each"))
    rests = placed.select(F.concat_ws("-", F.lit("m"), bin_no.cast("long")).alias("bin_id"), "doc_id", "piece_no", "first_token", F.col("size").alias("tokens"))
    return fulls.unionByName(rests)
