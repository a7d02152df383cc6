import random

import pytest

from weftgraph.llm.splitting import broken_chunk_counts, cut_positions, natural_kind, oversized_kinds, pieces, split_items

PARA = "one two three. " * 20 + "\n\n"


@pytest.mark.parametrize(
    ("text", "want"),
    [(PARA * 20, "paragraph"), (("a b c " * 30 + "\r\n") * 40, "line"), ("a b c d. " * 900, "sentence"), ("word " * 1200, "space"), ("x" * 4001, "none"), ("x" * 4000 + "\n \n" + "y", "paragraph"), ("x" * 4000 + "\r" + "y", "line"), ("x" * 4000 + "   ", "space"), ("𝛼" * 3999 + "! " + "b" * 10, "sentence")],
)
def test_natural_kind(text, want):
    assert natural_kind(text) == want


def check(text, limit=4000, overlap=200):
    p = pieces(text, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text)
    for i, (a, b) in enumerate(p):
        assert 0 < b - a <= limit
        if i:
            assert a == p[i - 1][1] - overlap and b > p[i - 1][1]
    return p


def test_pieces_of_random_texts():
    rng = random.Random(6)
    for _ in range(150):
        marks = rng.choice((["\n\n", ". ", " "], [" "], [""], ["\r\n", " "], ["! ", ""]))
        text = "".join("w" * rng.randint(1, 60) + rng.choice(marks) for _ in range(rng.randint(1, 700)))
        check(text)
        check(text, 100, 20)


def test_cuts_prefer_natural_places():
    text = ("s " * 900 + "\n\n") * 6
    assert all(text[:c].endswith("\n\n") for c in cut_positions(text)[:-1])


def test_a_better_finer_cut_is_seen():
    """A sentence's end near the middle beats a paragraph's end that leaves a tiny rest."""
    text = "a" * 1999 + ". " + "b" * 1699 + "\n\n" + "c" * 398
    assert cut_positions(text) == [2001, len(text)]


def test_hard_cut_keeps_clusters():
    text = "👩‍🔬" * 2000
    assert all(text[c - 1] != "‍" and text[c] != "‍" for c in cut_positions(text)[:-1])


def test_brute_force_cost():
    """The program's cuts are no worse than any other choice of the same candidates."""
    import itertools

    from weftgraph.llm.splitting import _candidates

    text = "aaa bbb. ccc ddd\n\neee fff. ggg hhh iii\n\njjj kkk lll mmm. nnn"
    limit, overlap = 24, 4
    pos, cost, verdict = _candidates(text, limit - overlap, limit)
    assert verdict == natural_kind(text, limit)
    even = len(text) / -(-len(text) // (limit - overlap))
    price = dict(zip(pos.tolist(), cost.tolist()))

    def value(cuts):
        spans = list(zip([0, *cuts], [*cuts, len(text)]))
        if spans[0][1] > limit or any(b - a > limit - overlap for a, b in spans[1:]):
            return float("inf")
        return sum(((b - a - even) / even) ** 2 + price[b] for a, b in spans)

    inner = [int(p) for p in pos[1:-1]]
    best = min(value(c) for k in range(1, 6) for c in itertools.combinations(inner, k))
    assert abs(value(cut_positions(text, limit, overlap)[:-1]) - best) < 1e-9


def test_rows(spark, shuffled):
    rows = [(1, "short", "x"), (2, None, None), (3, "  ", None), (4, "ab " * 4000, None), (5, "x" * 500_000, None)]
    df = spark.createDataFrame(rows, "turn_id long, text string, kind string")
    got = split_items(df.select("turn_id", "text"), "turn_id", "text").groupBy("turn_id").agg({"piece": "count", "n_pieces": "max"}).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {1: (1, 1), 4: (4, 4), 5: (132, 132)}
    assert shuffled(oversized_kinds(split_items(df.select("turn_id", "text"), "turn_id", "text"), "turn_id")) == [(4, "space"), (5, "none")]
    assert split_items(df.limit(0), "turn_id", "text").count() == 0


def test_chunk_counts(spark):
    rows = [("a1", "a", 1, 2), ("a2", "a", 2, 2), ("a2", "a", 2, 2), ("b1", "b", 1, 2), ("c1", "c", 1, None), ("d1", "d", 1, 2), ("d2", "d", 2, 3), ("e1", "e", 2, 2), ("e2", "e", 3, 2), ("f1", "f", None, 1), ("g1", None, 1, 1), ("h1", "h", 1, 1)]
    df = spark.createDataFrame(rows, "cp_key string, file_path string, chunk_index int, total_chunks int")
    assert {r.file_path: r.ok for r in broken_chunk_counts(df).collect()} == {"a": True, "b": False, "c": False, "d": False, "e": False, "f": False, "h": True}
    assert broken_chunk_counts(df.limit(0)).count() == 0
