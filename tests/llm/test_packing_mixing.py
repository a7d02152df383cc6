import random
from collections import Counter, defaultdict

import regex
from pyspark.sql import functions as F

from weftgraph.llm.mixing import actual_shares, emitted, mixed, sized_documents, source_rates
from weftgraph.llm.packing import pack, plan_bins, token_pieces
from weftgraph.llm.tokens import token_count


def test_token_counts(spark):
    texts = ["a b-c, d!", "", None, "   ", "naïve café №5", "𝛼𝛽 👩‍🔬", "x_y", "a b c d", "word " * 50_000, "é"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", token_count(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == [len(regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]", t or "")) for t in texts]


def test_plan_fills_bins_soundly():
    rng = random.Random(1)
    for capacity in (30, 1024):
        for _ in range(30):
            histogram = dict(Counter(rng.choice((rng.randint(1, capacity - 1), rng.randint(1, capacity // 4))) for _ in range(rng.randint(1, 400))))
            plan = plan_bins(histogram, capacity)
            placed = Counter()
            for n, slots in zip(plan.bins, plan.slots):
                assert n > 0 and sum(s * c for s, c in slots.items()) <= capacity
                assert sum(c for s, c in slots.items() if s * 3 > capacity) <= 2
                placed.update({s: n * c for s, c in slots.items()})
            assert placed == Counter(histogram)
            total = sum(s * c for s, c in histogram.items())
            assert sum(plan.bins) <= -(-total * 3 // (2 * capacity)) + 1


def test_pack_rows(spark):
    rng = random.Random(2)
    sizes = [rng.choice((7, 7, 7, rng.randint(1, 99))) for _ in range(400)] + [0, 250, 100, 341]
    rows = [(i, "w " * n, "clash") for i, n in enumerate(sizes)] + [(0, "w " * sizes[0], "clash"), (999, None, None)]
    pieces = token_pieces(spark.createDataFrame(rows, "doc_id long, text string, size string"), 100)
    assert {r.doc_id: r.min_pieces for r in pieces.where("tokens > 100").collect()} == {401: 3, 403: 4}
    bins, seen = defaultdict(int), defaultdict(list)
    for r in pack(pieces, 100).collect():
        bins[r.bin_id] += r.tokens
        seen[r.doc_id].append((r.first_token, r.tokens, r.piece_no))
    assert max(bins.values()) <= 100
    for i, n in enumerate(sizes):
        at = 0
        for k, (first, tokens, piece) in enumerate(sorted(seen.get(i, []))):
            assert (first, piece) == (at, k + 1)
            at += tokens
        assert at == n
    assert pack(pieces.limit(0), 100).count() == 0


DOCS = [(i, "a b c d e f g h i j", src, "x") for i, src in enumerate(["big"] * 80 + [" BIG "] * 20 + ["small"] * 10 + [None] * 10 + [""] * 5)] + [(0, "a b c d e f g h i j", "big", "x"), (500, None, "big", "x"), (501, "tok", "stray", "x")]
TARGETS = [("big", 1.0, 1), ("small", 1.0, 4), ("none", 1.0, None), ("zero", 0.0, 1), ("null", None, None)]


def test_mixing(spark):
    sized = sized_documents(spark.createDataFrame(DOCS, "doc_id long, text string, source string, tokens string"))
    rates = source_rates(sized, spark.createDataFrame(TARGETS, "source string, target_weight double, max_repeats int"))
    by = {r.source: r for r in rates.collect()}
    assert (by["big"].tokens, by["small"].tokens, by["none"].tokens) == (1000, 100, 0)
    assert abs(by["big"].wanted - 1251 / 3) < 1e-9 and abs(by["big"].rate - 0.417) < 1e-9
    assert by["small"].rate == 4.0
    assert {s for s, r in by.items() if r.short} == {"small", "none"}
    mix = mixed(sized, rates)
    assert {r.copies for r in mix.where("source = 'small'").collect()} == {4}
    n = mix.where("source = 'big'").count()
    assert 25 < n < 60 and n == mixed(sized, rates).where("source = 'big'").count()
    assert emitted(mix).count() == n + 40
    shares = {r.source: r.actual_share for r in actual_shares(mix, rates).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["none"] == 0
    nothing = sized.limit(0)
    assert {r.source for r in source_rates(nothing, spark.createDataFrame(TARGETS, "source string, target_weight double, max_repeats int")).where("short").collect()} == {"big", "small", "none"}
