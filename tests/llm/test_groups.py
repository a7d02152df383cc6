import random

import pytest

from weftgraph.llm.groups import canonical_groups, connected_groups
from weftgraph.session import Scratch


def brute(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            up[root(a)] = root(b)
    groups = {}
    for x in list(up):
        groups.setdefault(root(x), set()).add(x)
    return sorted(sorted(g) for g in groups.values())


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.root, []).append(r.id)
    return sorted(sorted(g) for g in out.values())


CHAIN = [(i, i + 1) for i in range(200)]
STAR = [(0, i) for i in range(1, 300)]
RNG = random.Random(3)
RANDOM = [(RNG.randrange(400), RNG.randrange(400)) for _ in range(260)]
MIXED = [(1, 1), (2, None), (None, None), (3, 4), (4, 3), (3, 4), (-5, 4), (2**62, -(2**62))]


@pytest.mark.parametrize("pairs", [CHAIN, STAR, RANDOM, MIXED, [(5, 5)], []], ids=["chain", "star", "random", "mixed", "self", "empty"])
def test_against_union_find(spark, pairs):
    groups, n = connected_groups(spark.createDataFrame(pairs, "u long, v long"), Scratch(spark, "test"))
    rows = groups.collect()
    assert grouped(rows) == brute(pairs)
    assert n == len(rows) == len({r.id for r in rows})


def test_names(spark, shuffled):
    rows = [("r", ["b", "c"], 1), ("r", ["c", "a"], 1), ("r", ["c", "a"], 1), ("s", ["c", "z"], 1), ("r", ["x", "x"], 1), ("r", ["y", None], 1), (None, ["p", "q"], 1), ("r", None, 1), ("r", [], 1), ("r", ["", "é", "Z"], 1)]
    df = spark.createDataFrame(rows, "run string, names array<string>, root int")
    assert shuffled(canonical_groups(df, "run", "names")) == sorted([("r", n, "a") for n in "abc"] + [("s", n, "c") for n in "cz"] + [("r", n, "") for n in ("", "é", "Z")])
    assert canonical_groups(df.limit(0), "run", "names").count() == 0
    assert shuffled(canonical_groups(df.repartition(7), "run", "names")) == shuffled(canonical_groups(df.coalesce(1), "run", "names"))


def test_groups_with_colliding_ids_are_solved_again(spark, shuffled):
    """Ids of nine bits: names of different groups, and names of one match, meet in an id."""
    rng = random.Random(9)
    rows = [("r", [f"g{g}-{rng.randrange(4)}", f"g{g}-{rng.randrange(4)}"]) for g in range(12) for _ in range(3)]
    df = spark.createDataFrame(rows, "run string, names array<string>")
    assert shuffled(canonical_groups(df, "run", "names", bits=9)) == shuffled(canonical_groups(df, "run", "names"))
    pair = spark.createDataFrame([("r", ["a", "b"]), ("r", ["c", "d"])], "run string, names array<string>")
    assert shuffled(canonical_groups(pair, "run", "names", bits=4)) == [("r", "a", "a"), ("r", "b", "a"), ("r", "c", "c"), ("r", "d", "c")]
