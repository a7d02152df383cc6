from pyspark.sql import functions as F

from weftgraph.export import graph_formats as formats
from weftgraph.operators import graph


def planted(spark):
    ents = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "name string, entity_type string")
    rels = spark.createDataFrame([("a", "a", ["uses"]), ("a", "b", ["uses"]), ("b", "a", ["uses"]), ("a", "b", [" Uses"]), ("a", "ghost", ["calls"])], "src string, dst string, relation_type array<string>")
    return ents, rels


def test_planted_defects(spark):
    r = graph.health(*planted(spark)).first()
    assert (r.entity_count, r.relation_count, r.self_loop_count, r.bidirectional_pair_count, r.dangling_endpoint_count, r.parallel_edge_count) == (3, 5, 1, 1, 1, 1)
    assert abs(r.referential_integrity - 0.8) < 1e-9


def test_permuted_predicates_are_parallel(spark):
    ents, _ = planted(spark)
    rels = spark.createDataFrame([("a", "b", ["x", "Y"]), ("a", "b", ["y", " X "])], "src string, dst string, relation_type array<string>")
    assert graph.health(ents, rels).first().parallel_edge_count == 1
    assert graph.dedup_relations(rels, []).count() == 1


def test_empty_graph(spark):
    ents, rels = (d.limit(0) for d in planted(spark))
    r = graph.health(ents, rels).first()
    assert (r.entity_count, r.relation_count, r.parallel_edge_count, r.referential_integrity) == (0, 0, 0, 1.0)
    s = graph.structure(ents, rels).first()
    assert (s.connected_components, s.isolated_entities, s.density) == (0, 0, 0.0)


def test_degree_counts_ghosts_and_loops_twice(spark):
    assert {r.name: (r.degree, r.known) for r in graph.degrees(*planted(spark)).collect()} == {"a": (6, True), "b": (3, True), "c": (0, True), "ghost": (1, False)}


def test_components_against_union_find(spark):
    import random

    rng = random.Random(5)
    names = [f"n{i}" for i in range(120)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(90)] + [(f"c{i}", f"c{i + 1}") for i in range(60)] + [(None, "n1")]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for n in names:
        root(n)
    for a, b in pairs:
        if a and b:
            up[root(a)] = root(b)
    groups = {}
    for x in list(up):
        groups.setdefault(root(x), []).append(x)
    want = {x: min(g) for g in groups.values() for x in g}
    for parts in (1, 7):
        got = graph.connected_components(spark.createDataFrame(pairs, "src string, dst string").repartition(parts), spark.createDataFrame([(n,) for n in names], "name string"))
        assert {r.name: r.component for r in got.collect()} == want


def test_filters(spark):
    rels = spark.createDataFrame([("a", "b", ["related_to"]), ("b", "a", ["uses"]), ("a", "c", ["related_to"]), ("a", "d", [])], "src string, dst string, relation_type array<string>")
    key = lambda d: sorted((r.src, r.dst) for r in d.collect())
    assert key(graph.filter_catch_all(rels, "redundant")) == [("a", "c"), ("a", "d"), ("b", "a")]
    assert key(graph.filter_catch_all(rels, "all")) == [("a", "d"), ("b", "a")]
    assert graph.filter_catch_all(rels, "off").count() == 4


def test_chain_roots(spark):
    links = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(40)], "child string, parent string")
    assert {r.root for r in graph.resolve_chain(links, "child", "parent").collect()} == {"n40"}


def test_triples_and_pages(spark):
    obs = spark.createDataFrame([("a", 1, "two ", 0.9), ("a", 0, "one", None), ("a", 2, "one", 0.1), ("b", 0, " ", None)], "name string, ord int, text string, grounding_score double")
    rels = spark.createDataFrame([("a", "b", ["uses", ""], 0), ("a", "c", ["uses"], 1), ("a", "b", ["uses"], 2)], "src string, dst string, relation_type array<string>, ord int")
    got = {(r.name, r.property): r.value for r in formats.kb_triples(obs, rels).collect()}
    assert got == {("a", "description"): "one; two", ("a", "uses"): "b, c"}
    assert {r.value for r in formats.kb_triples(obs, rels, 0.5).where("property = 'description'").collect()} == {"one; two"}
    ents = spark.createDataFrame([("A b", "t", 0), ("a-b", "t", 1), ("", "t", 2)], "name string, entity_type string, ord int")
    assert sorted(r.path for r in formats.markdown_pages(ents, obs, rels).collect()) == ["a-b-2.md", "a-b.md", "entity.md"]


def test_formats_are_known():
    import pytest

    with pytest.raises(ValueError, match="jsonl"):
        formats.exporter("nope")
    assert formats.exporter("jsonl") is formats.jsonl


def test_mcp_round_trip(spark):
    rels = spark.createDataFrame([("a", "b", ["x", "y"], 0)], "src string, dst string, relation_type array<string>, ord int")
    back = formats.from_mcp(formats.mcp_relations(rels).unionByName(spark.createDataFrame([(1, '{"type": "rel')], "ord int, line string"))).collect()
    assert [(r.src, r.dst, list(r.relation_type)) for r in back] == [("a", "b", ["x", "y"])]


def test_vocabulary(spark):
    assert graph.allowed_vocabulary(["a"], ["b"], ["c", "b"]) == ["b", "c", "a", "related_to"]
    assert graph.allowed_vocabulary(["a"], glossary=["c"], mode="strict") == ["c", "related_to"]
    assert graph.allowed_vocabulary(["a"], mode="open") is None
    got = spark.createDataFrame([(["a", "z"],), (None,)], "t array<string>").select(graph.coerce_vocabulary(F.col("t"), ["a"]).alias("t")).collect()
    assert [list(r.t) for r in got] == [["a", "related_to"], []]
