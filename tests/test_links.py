from weftgraph.operators import links


def test_reference_graph_and_following(spark):
    docs = spark.createDataFrame([("d/a.md", "[x](b.md) [y](https://e.x/z) [[C Page]] ![i](b.md)"), ("d/b.md", "[c](../c-page.md#top)"), ("c-page.md", "[me](c-page.md)"), ("e/b.md", None), (None, "[x](a.md)")], "path string, text string")
    edges = links.reference_graph(docs, "path", "text")
    assert sorted((r.src, r.dst, r.relation_type) for r in edges.collect()) == [("d/a.md", "c-page.md", "links_to"), ("d/a.md", "d/b.md", "links_to"), ("d/a.md", "https://e.x/z", "cites"), ("d/b.md", "c-page.md", "links_to")]
    start = spark.createDataFrame([("d/a.md",)], "name string")
    got = {r.name: r.depth for r in links.followed(edges.where("resolved"), start).collect()}
    assert got == {"d/a.md": 0, "d/b.md": 1, "c-page.md": 1}
    assert links.followed(edges.where("resolved"), start, 0).count() == links.followed(edges.where("resolved"), start, 50).count()  # 0 is without limit
    assert links.followed(edges.where("resolved").limit(0), start, 0).count() == 1


def test_robots(spark):
    urls = spark.createDataFrame([("h", "/a/b"), ("h", "/c"), ("g", "/a/b"), ("h", "")], "host string, path string")
    rules = spark.createDataFrame([("h", "/a"), ("h", "")], "host string, prefix string")
    assert sorted((r.host, r.path) for r in links.disallowed(urls, rules).collect()) == [("g", "/a/b"), ("h", ""), ("h", "/c")]


def test_rebuilt_content(spark):
    text = "abcdefghij"
    rows = [("k", 1, 0, text[:5]), ("k", 2, 3, text[3:8]), ("k", 3, 6, text[6:])]
    assert links.rebuilt_content(spark.createDataFrame(rows, "k string, idx int, start int, content string"), "k").first().content == text


def test_code_symbols(spark):
    code = "import os\nfrom a.b import c\nclass X(Y):\n    def f(self):\n        return g(1)\n"
    got = {(r.src, r.relation_type, r.dst) for r in links.code_symbols(spark.createDataFrame([("m.py", code), ("bad.py", "def ("), ("none.py", None)], "path string, content string")).collect()}
    assert got == {("m.py", "imports", "os"), ("m.py", "imports", "a.b"), ("m.py", "contains", "X"), ("m.py", "contains", "f"), ("X", "extends", "Y"), ("X", "calls", "g"), ("f", "calls", "g")}
