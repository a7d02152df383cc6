import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import references as refs
from weftgraph.functions import similarity as sim
from weftgraph.functions import text as tx
from weftgraph.operators import classify, corpus, evaluate, incremental, packing, quality, resolve, seams, temporal, vectors
from weftgraph.operators.ranks import bucketed_rank, ordered_rank


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)]).select(column).first()[0]


@pytest.mark.parametrize(("a", "b", "want"), [("garlic", "anthropic", 0.7037), ("a", "b", 0.0), ("a", "A", 1.0), ("martha", "marhta", 0.9611), ("dixon", "dicksonx", 0.8133), ("", "x", 0.0)])
def test_name_similarity(a, b, want):
    assert abs(sim.name_similarity(a, b) - want) < 1e-4


def test_vectors_without_direction(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [0.6, 0.8])], "k long, v array<double>")
    assert sorted(r.id for r in vectors.unit_vectors(df, "k", "v").collect()) == [1, 2, 6]
    a, b = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, sim.cosine(a, b)) is None and one(spark, sim.cosine(b, F.array(F.lit(1.0)))) == 0.0


def test_pairs_and_linkage_in_blocks(spark):
    rng = random.Random(3)
    df = vectors.unit_vectors(spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)], "k long, v array<double>"), "k", "v")
    rows = {r.id: r.vec for r in df.collect()}
    want = {(a, b) for a in rows for b in rows if a < b and sum(x * y for x, y in zip(rows[a], rows[b])) >= 0.8}
    for size in (7, 1000):
        assert {(r.a, r.b) for r in vectors.similar_pairs(df, 0.8, size).collect()} == want
    tops = {}
    for r in vectors.top_neighbours(df, df.where("id % 20 = 0"), 3, 2).collect():
        tops.setdefault(r.query, []).append((r["rank"], r.id))
    for q, got in tops.items():
        best = sorted((x for x in rows if x != q), key=lambda x: (-sum(a * b for a, b in zip(rows[q], rows[x])), x))[:3]
        assert [i for _, i in sorted(got)] == best


def test_complete_linkage_keeps_chains_apart(spark):
    pairs = spark.createDataFrame([(1, 2, 0.95), (2, 3, 0.9), (4, 5, 0.99)], "a long, b long, sim double")
    ids = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    assert {r.id: r.cluster for r in vectors.single_linkage(pairs, ids).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert {r.id: r.cluster for r in vectors.complete_linkage(pairs, ids).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}


def test_resolution(spark):
    rows = [("Data Base", "concept", "f1", 0), ("data_base", "other", "f2", 1), ("DATA-BASE", "tool", "f2", 2), ("data base", "tool", "f3", 3), ("x.md", "file", "f1", 4), ("x.md", "file", "f2", 5), (None, "a", "f", 6)]
    mentions = spark.createDataFrame(rows, "name string, entity_type string, file string, ord long")
    got = sorted((r.name, r.entity_type, r.n_mentions, tuple(r.files)) for r in resolve.exact_merge(mentions).collect())
    assert got == [("Data Base", "tool", 4, ("f1", "f2", "f3")), ("x.md", "file", 1, ("f1",)), ("x.md", "file", 1, ("f2",))]
    names = [("photosynthesis", "p", "f", 0), ("photosynthesys", "p", "f", 1), ("table 1", "p", "f", 2), ("table 2", "p", "f", 3), ("photosynthesiz", "gene", "f", 4), ("zebra", "p", "f", 5)]
    fuzzy = {r.surface: r.canonical for r in resolve.fuzzy_merge(spark.createDataFrame(names, "name string, entity_type string, file string, ord long")).collect()}
    assert fuzzy["photosynthesys"] == "photosynthesis" and fuzzy["table 2"] == "table 2" and fuzzy["zebra"] == "zebra"


def test_supersession(spark):
    schema = "name string, text string, ord int, valid_at string, invalid_at string, expired_at string"
    rows = [("e", "the service is enabled today", 0, "2024-01-01", None, None), ("e", "the service is disabled today", 1, "2024-02-01", None, None), ("e", "the service is disabled today", 2, None, None, None), ("e", "nothing else here", 3, "2024-03-01", None, None)]
    got = {r.ord: (r.invalid_at, r.expired_at) for r in resolve.supersede(spark.createDataFrame(rows, schema), "NOW").collect()}
    assert got == {0: ("2024-02-01", "NOW"), 1: (None, None), 2: (None, None), 3: (None, None)}


def test_observations(spark):
    df = spark.createDataFrame([("e", "a b c d", 0, "s", "p"), ("e", "a b c d e", 1, "s", "p"), ("e", "a b c d", 2, "t", "p")], "name string, text string, ord int, source string, speaker string")
    assert sorted(r.ord for r in resolve.near_duplicate_observations(df, 0.85).collect()) == [1, 2]
    assert resolve.fold_observations(df).count() == 2


def test_scores(spark):
    t = "sample string, s string, p string, o string"
    e, g = spark.createDataFrame([("1", "A", "x", "b"), ("1", "a!", "x", "B"), ("1", "c", "y", "d")], t), spark.createDataFrame([("1", "a", "x", "b"), ("1", "c", "z", "d"), ("2", "q", "r", "s")], t)
    got = {(r.sample, r.level): (r.tp, r.fp, r.fn) for r in evaluate.score_levels(e, g, ["sample"]).collect()}
    assert got["1", "triple"] == (1, 2, 1) and got["1", "relation"] == (1, 2, 1) and got["2", "triple"] == (0, 0, 1) and got["1", "entity"] == (4, 2, 0)
    assert [(r.precision, r.recall, r.f1) for r in evaluate.with_scores(spark.createDataFrame([(0, 0, 0)], "tp int, fp int, fn int")).collect()] == [(0.0, 0.0, 0.0)]
    v = "sample string, part string, vec array<double>, ord int"
    sem = evaluate.semantic_counts(spark.createDataFrame([("1", "a", [1.0, 0.0], 0), ("1", "b", None, 1), ("1", "z", [0.0, 0.0], 2)], v), spark.createDataFrame([("1", "x", [0.9, 0.1], 0), ("1", "b", None, 1), ("2", "y", None, 0)], v))
    assert {r.sample: (r.tp, r.fp, r.fn) for r in sem.collect()} == {"1": (2, 1, 0), "2": (0, 0, 1)}
    auc = spark.createDataFrame([(0.1, False), (0.4, True), (0.4, False), (0.9, True)], "s double, l boolean")
    assert evaluate.rank_auc(auc, "s", "l").first().auc == 0.875


def test_time(spark):
    df = spark.createDataFrame([("e", "2024-01-01", "2024-02-01"), ("e", "2024-01-15", None), ("f", "2024-01-01", "2024-01-01")], "name string, a string, b string").select("name", F.to_timestamp("a").alias("valid_at"), F.to_timestamp("b").alias("invalid_at"))
    got = {r.name: r.end is None for r in temporal.entity_intervals(df).collect()}
    assert got == {"e": True, "f": False}
    moments = spark.createDataFrame([("2023-12-31",), ("2024-01-01",), ("2024-01-20",), ("2024-02-01",)], "t string").select(F.to_timestamp("t").alias("t"))
    counts = temporal.as_of(df.select(F.col("valid_at").alias("start"), F.col("invalid_at").alias("end")), moments)
    assert [r.active for r in counts.orderBy("t").collect()] == [0, 1, 2, 1]


def test_text_functions(spark):
    f = lambda c, s: spark.createDataFrame([(s,)], "t string").select(c(F.col("t"))).first()[0]
    assert f(tx.normal_name, " Knowledge_Graph–Builder  X ") == "knowledge graph builder x"
    assert f(tx.digit_signature, "Table 12 v2") == "12,2"
    assert f(tx.proper_nouns, "The Naive Bayes Classifier met New York. The End") == ["Naive Bayes Classifier", "New York"]
    assert f(tx.sentences, "One. Two!\nThree ") == ["One.", "Two!", "Three"]
    assert f(tx.slug, "A b/C_d") == "a-b-c_d" and f(tx.slug, "¿") == "entity"
    assert f(refs.links, "[a](x.md) ![i](p.png) [[W p|q]] <a href='h.html'>z</a> https://e.x/a, [f](#top)") == ["x.md", "W p", "h.html", "https://e.x/a"]
    assert f(refs.citation_key, "see arXiv:2401.12345 and 10.1000/abc") == "arxiv:2401.12345" and f(refs.citation_key, "doi 10.1000/AbC.") == "doi:10.1000/abc"
    assert f(refs.without_references, "a\nb\nc\nd\nReferences\n[1] x") == "a\nb\nc\nd"
    assert f(refs.without_references, "References\na\nb\nc\nd") == "References\na\nb\nc\nd"
    pair = spark.createDataFrame([("the service is synchronous", "the service is asynchronous"), ("it was never done here", "it was done here again"), ("a", "b")], "a string, b string")
    assert [r[0] for r in pair.select(tx.contradicts(F.col("a"), F.col("b"))).collect()] == [True, True, False]
    assert [round(x, 6) for x in one(spark, sim.softmax(F.array(F.lit(1.0), F.lit(1.0))))] == [0.5, 0.5]


def test_splitting_and_packing(spark):
    rng = random.Random(8)
    for _ in range(60):
        text = "".join("w" * rng.randint(1, 30) + rng.choice(("\n\n", "\n", ". ", " ", "")) for _ in range(rng.randint(0, 300)))
        parts = packing.recursive_pieces(text, 200, 20)
        assert all(0 < len(p) <= 200 for p in parts)
        assert "".join(text.split()) == "" or parts
    rows = [(i, "s", i // 6, i, f"P{i // 3 % 2}", "x" * n, "2024" if i == 2 else None) for i, n in enumerate((5, 5, 5, 90, 5, 0, 5, 5))]
    packs = packing.pack_turns(spark.createDataFrame(rows, "turn_id int, source_path string, conversation int, turn_no int, speaker string, text string, occurred_at string"), 40).orderBy("conversation", "pack_no").collect()
    assert all(len(p.content) <= 40 for p in packs)
    assert packs[0].speaker == "P0" and packs[0].occurred_at == "2024" and {p.conversation for p in packs} == {0, 1}
    assert sum(p.content.count("x") for p in packs) == 120


def test_intervals(spark):
    seg = spark.createDataFrame([("r", 0.0, 1.0), ("r", 1.2, 2.0), ("r", 5.0, 6.0)], "k string, start double, end double")
    assert sorted((r.start, r.end) for r in packing.closed_gaps(seg, "k", 0.3).collect()) == [(0.0, 2.0), (5.0, 6.0)]
    assert [(r.start, r.end) for r in packing.silences(seg, "k").orderBy("start").collect()] == [(1.0, 1.2), (2.0, 5.0)]
    s = spark.createDataFrame([("r", 1, 0.0, 100.0), ("r", 2, 500.0, 501.0)], "k string, seg int, start double, end double")
    t = spark.createDataFrame([("r", 7, -5.0, 20.0), ("r", 8, 20.0, 95.0), ("r", 9, 95.0, 400.0)], "k string, turn int, start double, end double")
    assert [(r.seg, r.turn, r.overlap) for r in packing.overlap_join(s, t, "k").collect()] == [(1, 8, 75.0)]
    assert packing.audio_boundaries([(310.0, 312.0)], 1000.0) == [(0.0, 311.0), (311.0, 911.0), (911.0, 1000.0)]
    assert packing.stitched_speakers([(0, "a", [1.0, 0.0]), (1, "x", [0.9, 0.1]), (1, "y", [0.0, 1.0])]) == {(0, "a"): 0, (1, "x"): 0, (1, "y"): 1}


def test_classes(spark):
    df = spark.createDataFrame([(1, "From: a\nTo: b\nSubject: c\n"), (2, ""), (3, None)], "k long, t string")
    dist = classify.class_distribution(df, "k", "t")
    total = {r.k: r.s for r in dist.groupBy("k").agg(F.round(F.sum("confidence"), 9).alias("s")).collect()}
    assert total == {1: 1.0, 2: 1.0, 3: 1.0}
    gate = {r.k: (r.decision, r["class"]) for r in classify.domain_gate(dist, "k").collect()}
    assert gate[1] == ("single", "email") and gate[2][0] == "abstain"
    acc = {r["class"]: (r.precision, r.recall) for r in corpus.accuracy_by_class(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None)], "gold string, pred string")).collect()}
    assert acc == {"a": (1.0, 0.5), "b": (0.0, 0.0)}


def test_quality(spark):
    obs = spark.createDataFrame([("e", "it is public"), ("e", "it is private"), ("e", "it is private"), ("f", "asynchronous")], "name string, text string")
    r = quality.factual_consistency(obs).first()
    assert (r.pairs, r.conflicts) == (3.0, 2.0)
    assert quality.factual_consistency(obs.limit(0)).first().consistency == 1.0
    assert [one(spark, quality.name_score(F.lit(n))) for n in ("my_name", "data", "Ab")] == [1.0, 0.3, 0.3]


def test_resume_and_pipeline(spark):
    done = incremental.latest(spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 1, "c")], "key string, n int, v string"), "key", ["n"])
    assert sorted((r.key, r.v) for r in done.collect()) == [("k", "b"), ("m", "c")]
    assert incremental.not_done(spark.createDataFrame([("k",), ("x",)], "key string"), done, "key").collect()[0].key == "x"
    p = seams.Pipeline({"a": lambda d: d.where("id > 0"), "b": lambda d: d.limit(1)})
    out, missing = p.run(spark.range(5), ["a"], {"a", "b"})
    assert out.count() == 4 and missing == ["b"]
    e = spark.createDataFrame([("a b",), (None,)], "t string").select(seams.embed(F.col("t")).alias("v")).collect()
    assert abs(sum(x * x for x in e[0].v) - 1) < 1e-9 and sum(e[1].v) == 0


@pytest.mark.parametrize("partitions", [1, 5])
def test_ranks(spark, partitions):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "cold", float(i % 50), "x") for i in range(300)], "id long, g string, t double, __n string").repartition(partitions)
    got = bucketed_rank(df.drop("__n"), ["g"], ["id"], "rank", 8).groupBy("g").agg(F.count_distinct("rank").alias("d"), F.max("rank").alias("m"), F.count("*").alias("n")).collect()
    assert all(r.d == r.n and r.m == r.n - 1 for r in got)
    ranked = ordered_rank(df.drop("__n"), ["g"], [F.col("t"), F.col("id")], "rank", F.floor(F.col("t") / 7)).orderBy("g", "rank").collect()
    for g in ("hot", "cold"):
        own = [(r.t, r.id) for r in ranked if r.g == g]
        assert own == sorted(own)
        assert [r["rank"] for r in ranked if r.g == g] == list(range(1, len(own) + 1))


def test_watched_folder(spark, tmp_path):
    from weftgraph.streaming.watch import append_graph, watch

    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    handler = append_graph(str(out), lambda f: seams.rule_entities(f.select(F.col("path").alias("chunk_id"), "content")))
    (src / "a.txt").write_text("We met New York and Old Town.")
    watch(spark, str(src), str(tmp_path / "cp"), handler).awaitTermination(60)
    (src / "b.txt").write_text("We met San Jose.")
    watch(spark, str(src), str(tmp_path / "cp"), handler).awaitTermination(60)
    assert sorted(r.name for r in spark.read.parquet(str(out)).collect()) == ["New York", "Old Town", "San Jose"]


def test_fuzzy_merge_across_first_letters(spark):
    from weftgraph.functions.similarity import name_similarity
    from weftgraph.operators.resolve import _Reachable
    from weftgraph.plans import resolve as plans

    names = ["xhotosynthesis of plants", "photosynthesis of plants", "zebra"]
    frame = spark.createDataFrame([(n, "concept", "f", i) for i, n in enumerate(names)], "name string, entity_type string, file string, ord long")
    mentions, plans.chunk_mentions = plans.chunk_mentions, lambda *_: frame
    try:
        assert [(r.surface, r.canonical) for r in plans.fuzzy_merge(spark, "").collect()] == [(names[1], names[0])]
    finally:
        plans.chunk_mentions = mentions
    some = ["Anna Maria", "Hanna Maria", "anna", "Nana", "Ana Marja", "ŠÄnna", "a", "b", "aaaa bbbb", "bbbb aaaa", "martha", "marhta"]
    kept = _Reachable(len(some))
    for n in some:
        kept.add(n)
    for n in some:
        bounds = dict(kept.bounds(n, 0.9))
        assert all(name_similarity(n, o) <= bounds.get(i, 0.9) for i, o in enumerate(some))
