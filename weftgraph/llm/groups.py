"""Pairwise matches to groups over all chains of links (problem 3).

Borůvka hooking on DataFrames: every component selects its smallest outgoing edge, the chosen edges form trees (and
pairs that chose each other, where the smaller one becomes the root), trees collapse by pointer doubling, and the edges
are relabelled and deduplicated until none is left. At least every second component disappears in a round, so the
number of rounds is logarithmic. All tables are keyed by 64-bit ids, each step is written to the shared folder, and
nothing but counts reaches the driver.

Defined results: null ids are dropped, self-links make no group, repeated links and either direction of one count once,
an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import Scratch


def _other_end(edges: DataFrame) -> DataFrame:
    """Each component's smallest outgoing edge by (lo, hi): columns c (component) and p (the other end)."""
    sides = edges.select(F.explode(F.array(F.struct(F.col("lo").alias("c"), "lo", "hi"), F.struct(F.col("hi").alias("c"), "lo", "hi"))).alias("s")).select("s.*")
    # Smallest by lo, then hi; a component's own id is one of the two, so the other end follows from them.
    least = sides.groupBy("c").agg(F.min(F.when(F.col("lo") < F.col("c"), F.col("lo"))).alias("below"), F.min(F.when(F.col("hi") > F.col("c"), F.col("hi"))).alias("above"))
    return least.select("c", F.coalesce("below", "above").alias("p"))


def _joined_up(table: DataFrame, above: DataFrame) -> DataFrame:
    """``table`` (c, p) with q, what ``above`` has for p (null if it has nothing)."""
    up = above.select(F.col("c").alias("m"), F.col("p").alias("q"))
    return table.join(up, table["p"] == up["m"], "left")


def _collapsed(scratch: Scratch, chosen: DataFrame, at: str) -> tuple[DataFrame, int]:
    """Trees to stars: every component with its root, by pointer doubling; and the number of components.

    Only components that others have chosen are on a path to a root, so the doubling runs over those; the leaves, most
    of the components, follow in a single join.
    """
    parents = chosen.select(F.col("p").alias("k")).distinct()
    inner = chosen.join(parents, chosen["c"] == parents["k"], "left_semi")
    # Two components that chose each other: the smaller is the root.
    mutual = F.coalesce(F.col("q") == F.col("c"), F.lit(False))
    rooted = _joined_up(inner, inner).select("c", F.when(mutual & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
    table, _ = scratch.save(rooted, f"{at}-0")
    step = 0
    while True:
        step += 1
        above = F.coalesce("q", "p")
        doubled = _joined_up(table, table).select("c", above.alias("p"), (above != F.col("p")).alias("moved"))
        table, seen = scratch.save(doubled, f"{at}-{step}", moved=F.sum(F.col("moved").cast("long")))
        table = table.select("c", "p")
        scratch.drop(f"{at}-{step - 1}")
        if not seen["moved"]:
            break
    # A component's own row wins: a root that was chosen has no other parent in the table.
    own = table.select(F.col("c").alias("k"), F.col("p").alias("own"))
    leaves = chosen.join(own, chosen["c"] == own["k"], "left_anti")
    star = table.unionByName(_joined_up(leaves, table).select("c", F.coalesce("q", "p").alias("p")))
    out, seen = scratch.save(star, f"{at}-star", n=F.count(F.lit(1)))
    scratch.drop(f"{at}-{step}")
    return out, seen["n"]


def connected_groups(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``links`` (u bigint, v bigint) to one (id, root) per linked id; also the number of ids."""
    clean = links.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    edges = clean.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))
    stars: list[DataFrame] = []
    ids = 0
    while True:
        k = len(stars)
        chosen, seen = scratch.save(_other_end(edges), f"chosen-{k}", n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        star, n = _collapsed(scratch, chosen, f"star-{k}")
        scratch.drop(f"chosen-{k}")
        ids = ids or n
        stars.append(star)
        a, b = star.select(F.col("c").alias("lo"), F.col("p").alias("a")), star.select(F.col("c").alias("hi"), F.col("p").alias("b"))
        moved = edges.join(a, "lo").join(b, "hi").where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
        edges, seen = scratch.save(moved, f"edges-{k + 1}", n=F.count(F.lit(1)))
        scratch.drop(f"edges-{k}")
        scratch.release()
        if not seen["n"]:
            break
    if not stars:
        return chosen.select(F.col("c").alias("id"), F.col("p").alias("root")), 0
    roots = stars.pop()
    while stars:
        below = stars.pop()
        roots = _joined_up(below, roots).select("c", F.coalesce("q", "p").alias("p"))
    return roots.select(F.col("c").alias("id"), F.col("p").alias("root")), ids


def canonical_groups(matches: DataFrame, scope: str, names: str, bits: int = 64) -> DataFrame:
    """``matches`` with a scope column and an array of names that one match links, to (scope, name, group_name).

    One row for each name in a group of at least two names; ``group_name`` is the smallest name of the group in code
    point order. Names are equal only if identical and only within their scope. Matches with a null scope and null
    names are skipped. Ids are hashes of (scope, name), of ``bits`` bits. Groups in which two names have met in one id
    are taken out and solved again on their own with other hashes, until none is left: a result never rests on a
    collision, and one costs a rerun of its group only.
    """
    spark = matches.sparkSession
    linked = matches.where(F.col(scope).isNotNull()).select(F.col(scope).alias("s"), F.array_distinct(F.filter(F.col(names), lambda x: x.isNotNull())).alias("n")).where(F.size("n") > 1)
    done: list[DataFrame] = []
    seed = 0
    while True:
        scratch = Scratch(spark, "groups")
        id_of = lambda name: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("s"), name), 64 - bits) if bits < 64 else F.xxhash64(F.lit(seed), F.col("s"), name)  # noqa: E731, B023
        pairs = linked.select(F.explode(F.transform(F.slice("n", 2, 1 << 30), lambda x: F.struct(id_of(F.get("n", 0)).alias("u"), id_of(x).alias("v")))).alias("e")).select("e.*")
        groups, ids = connected_groups(pairs, scratch)
        groups, _ = scratch.save(groups, "groups")
        scratch.release()
        every = linked.select("s", F.explode("n").alias("name")).withColumn("id", id_of(F.col("name")))
        named = every.repartition("id").distinct()  # the join below needs the same partitioning
        # Every name is linked to another, so one without a root has lost its link to a name of the same id.
        labelled, seen = scratch.save(named.join(groups, "id", "left").select("s", "name", "root"), "labelled", n=F.count(F.lit(1)), rootless=F.sum(F.col("root").isNull().cast("long")))
        del named, groups
        scratch.drop("groups")
        scratch.release()
        clash = seen["n"] != ids or seen["rootless"]
        if clash:
            shared = labelled.withColumn("id", id_of(F.col("name"))).groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.min("root").alias("r")).where("k > 1 OR r IS NULL")
            bad, _ = scratch.save(shared.select(F.col("r").alias("b")).where("b IS NOT NULL").distinct(), "bad")
            again = labelled.join(bad, labelled["root"] == bad["b"], "left_semi").unionByName(labelled.where("root IS NULL")).select(F.col("s").alias("z"), F.col("name").alias("m"))
            labelled = labelled.where("root IS NOT NULL").join(bad, labelled["root"] == bad["b"], "left_anti")
        least = labelled.groupBy("root").agg(F.min("name").alias("group_name"))
        done.append(labelled.join(least, "root").select(F.col("s").alias(scope), F.col("name"), "group_name"))
        if not clash:
            break
        linked, _ = scratch.save(linked.join(again, (F.col("s") == F.col("z")) & (F.get("n", 0) == F.col("m")), "left_semi"), "again")
        seed += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
