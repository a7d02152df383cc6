"""Hierarchical merge, canonical forms, stored graphs and SQLite files on small fixtures."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from weftgraph.export import graph_formats
from weftgraph.operators import canonical, graph, hierarchy
from weftgraph.sources import graphs, relational, sqlite

MENTIONS = "graph_id int, file string, name string, entity_type string, ord long"
EDGES = "graph_id int, src string, dst string, relation_type array<string>, ord long"


def merged(spark, mentions, edges, **more):
    return hierarchy.hierarchical_merge(spark.createDataFrame(mentions, MENTIONS), spark.createDataFrame(edges, EDGES), **more)


ROWS = [
    (1, "a.md", "Old Oak", "tree", 1), (1, "a.md", "Park", "other", 2), (2, "a.md", "old-oak", "tree", 3), (3, "b.md", "OLD OAK", "plant", 4), (3, "b.md", "Pond", "water", 5), (3, "b.md", None, "x", 6),
    (4, "p/one", "package.json", "file", 7), (5, "q/two", "package.json", "file", 8), (5, None, "Park", "place", 9), (6, "q/two", "package.json", "file", 10),
]
LINKS = [
    (1, "Old Oak", "Park", ["grows_in"], 1), (2, "old-oak", "Park", [" Grows_In "], 2), (3, "OLD OAK", "Pond", ["near"], 3), (3, "Pond", "Nowhere", ["near"], 4), (3, "Pond", "Elsewhere", ["near"], 5),
    (2, "old-oak", "Old Oak", ["same"], 6), (4, "package.json", "Pond", ["names"], 7), (5, "package.json", "Pond", ["names"], 8), (1, "Someone", "Else", ["near"], 9),
]


def test_hierarchical_merge(spark):
    got = merged(spark, ROWS, LINKS, external=spark.createDataFrame([("Elsewhere",)], "name string"))
    ents = {r.name: (r.entity_type, r.files, r.n_mentions) for r in got.entities.collect()}
    assert ents == {
        "Old Oak": ("tree", ["a.md", "b.md"], 3), "Park": ("place", ["a.md"], 2), "Pond": ("water", ["b.md"], 1), "package.json": ("file", ["p/one"], 1), "package.json [q/two]": ("file", ["q/two"], 2), "Elsewhere": ("other", [], 0),
    }
    edges = sorted((r.src, r.dst, r.relation_type) for r in got.relations.collect())
    assert edges == [("Old Oak", "Park", ["grows_in"]), ("Old Oak", "Pond", ["near"]), ("Pond", "Elsewhere", ["near"]), ("package.json", "Pond", ["names"]), ("package.json [q/two]", "Pond", ["names"])]
    stats = got.stats.first()
    assert (stats.entities, stats.relations, stats.dropped_dangling_edges) == (6, 5, 1)
    assert stats.cross_file_edges == 4  # all but the one within a.md


def test_hierarchical_merge_edges(spark):
    got = merged(spark, ROWS, LINKS)
    assert got.stats.first().dropped_dangling_edges == 2
    assert [t.count() for t in merged(spark, [], [])[:2]] == [0, 0]
    folded = spark.createDataFrame([("Pond", "Park")], "surface string, canonical string")
    names = {r.name for r in merged(spark, ROWS, LINKS, surfaces=folded).entities.collect()}
    assert "Pond" in names or "Park" in names and not {"Pond", "Park"} <= names


def test_canonical_forms(spark):
    ents = spark.createDataFrame([("a", "t", ["f"]), ("b", "u", ["g", "f"]), ("c", "t", []), ("d", None, None)], "name string, entity_type string, files array<string>")
    rels = spark.createDataFrame([("b", "c", ["X"], 1), ("a", "c", ["x"], 2), ("a", "b", ["x"], 3), ("b", "d", ["x"], 4)], "src string, dst string, relation_type array<string>, ord int")
    clusters = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("z", 1)], "name string, cluster int")
    renames = canonical.entity_renames(ents, clusters, rels)
    assert {r.member: r.canonical for r in renames.collect()} == {"a": "b", "b": "b", "c": "c"}
    assert {r.name: (r.entity_type, r.files) for r in canonical.fold_entities(ents, renames).collect()} == {"b": ("u", ["f", "g"]), "c": ("t", []), "d": (None, [])}
    labels = canonical.label_renames(rels, spark.createDataFrame([("x", 1), ("X", 1)], "label string, cluster int"))
    done = canonical.rename_relations(canonical.rename_labels(rels, labels), renames, ["ord"])
    assert sorted((r.src, r.dst, r.relation_type) for r in done.collect()) == [("b", "c", ["x"]), ("b", "d", ["x"])]
    log = canonical.merge_log(renames, "test", spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.1)], "a string, b string, sim double")).collect()
    assert [(r.canonical, r.surface_forms, r.member_count, r.min_sim, r.max_sim) for r in log] == [("b", ["a", "b"], 2, 0.9, 0.9)]


def test_chains_end_however_long_and_in_cycles(spark):
    links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(300)] + [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("y", "x2"), ("u", "v"), ("v", "u"), ("s", "s"), (None, "n"), ("n", None)]
    got = {r.c: r.root for r in graph.resolve_chain(spark.createDataFrame(links, "c string, p string"), "c", "p").collect()}
    assert {got[f"n{i:03}"] for i in range(300)} == {"n300"}
    assert (got["x1"], got["x3"], got["y"], got["u"], got["v"], got["s"]) == ("x1", "x1", "x1", "u", "u", "s")


LINES = ['{"type":"entity","name":"Oak","entityType":"tree","observations":["old",{"text":"tall","validAt":"2020"}],"files":["a"],"chunk":2}', '{"type":"entity"}', '{"type":"relation","from":"Oak","to":"Park","relationType":"grows_in, stands_in"}', '{"type":"relation","from":"Oak","to":"Pond","relationType":["near"],"grounded":true}', "", '{"type":"note"}', '{"type":"entity","name":"cut']


def test_stored_graphs(spark, tmp_path):
    got = graphs.graph_of_lines(spark.createDataFrame([(x,) for x in LINES], "line string"))
    assert sorted((r.name, r.entity_type, r.files, r.chunk) for r in got.entities.collect()) == [("", "unknown", [], None), ("Oak", "tree", ["a"], 2)]
    assert sorted((r.name, r.ord, r.text, r.valid_at) for r in got.observations.collect()) == [("Oak", 0, "old", None), ("Oak", 1, "tall", "2020")]
    assert sorted((r.dst, r.relation_type, r.grounded) for r in got.relations.collect()) == [("Park", ["grows_in", "stands_in"], None), ("Pond", ["near"], True)]
    one = {"entities": [{"name": "Oak"}], "relations": [{"from": "Oak", "to": "Oak"}]}
    docs = spark.createDataFrame([(json.dumps(one),), (json.dumps([one, {"entities": [{"name": "Elm"}]}]),), ("not json",), (None,)], "text string")
    assert [t.count() for t in graphs.graph_of_documents(docs)] == [3, 0, 2]
    (tmp_path / "g.jsonl").write_text("\n".join(LINES))
    assert graphs.load_graph(spark, str(tmp_path / "g.jsonl")).entities.count() == 2
    with pytest.raises(ValueError):
        graphs.load_graph(spark, "g.dot")


def test_json_document_is_one_document(spark):
    ents = spark.createDataFrame([("Oak", "tree", "1"), ("Elm", "tree", "2")], "name string, entity_type string, ord string")
    obs = spark.createDataFrame([("Oak", 1, "old \"and\" tall")], "name string, ord int, text string")
    rels = spark.createDataFrame([("Oak", "Elm", ["near"], "1")], "src string, dst string, relation_type array<string>, ord string")
    text = "\n".join(r.line for r in graph_formats.json_document(ents, obs, rels).orderBy("part", "ord").collect())
    assert [e["name"] for e in json.loads(text)["entities"]] == ["Oak", "Elm"] and json.loads(text)["relations"][0]["to"] == "Elm"
    empty = "".join(r.line for r in graph_formats.json_document(ents.limit(0), obs, rels.limit(0)).orderBy("part").collect())
    assert json.loads(empty) == {"entities": [], "relations": []}


def test_sqlite_file(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as con:
        con.executescript("CREATE TABLE park (id INTEGER PRIMARY KEY, name TEXT); CREATE TABLE tree (id INTEGER PRIMARY KEY, kind TEXT, park_id INTEGER REFERENCES park(id), photo BLOB); CREATE TABLE tag (a TEXT, b TEXT, note TEXT, PRIMARY KEY (a, b)) WITHOUT ROWID; CREATE TABLE bare (x TEXT);")
        con.executemany("INSERT INTO park VALUES (?, ?)", [(i, f"park {i}") for i in range(1, 4)])
        con.executemany("INSERT INTO tree VALUES (?, ?, ?, ?)", [(i, f"kind {i}" if i % 2 else None, i % 4 or None, b"x") for i in range(1, 251)])
        con.execute("INSERT INTO tag VALUES ('k', 'v', 'n')")
    about = sqlite.catalogue(path)
    assert sqlite.table_rows(spark, path, "tree", about["tree"], step=100).count() == 250
    tables = sqlite.sqlite_tables(spark, path)
    assert {t.name: t.key for t in tables} == {"bare": (), "park": ("id",), "tag": ("a", "b"), "tree": ("id",)}
    edges = relational.relations(tables)
    assert edges.count() == 188 and edges.select(F.col("relation_type")[0].alias("t")).distinct().count() == 1
    assert relational.entities(tables).where("name = 'tag#k|v'").count() == 1
    assert relational.observations(tables).where("text LIKE 'photo%'").count() == 0
