import io
import zipfile

import pytest
from pyspark.sql import functions as F

from weftgraph.sources import benchmarks, conversations, documents, relational


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "path string, content string")


def said(df):
    return [(r.conversation, r.turn_no, r.speaker, r.text) for r in df.orderBy("path", "conversation", "turn_no").collect()]


def test_whatsapp(spark):
    text = "[12/03/24, 09:15:01] Ann: hello\nsecond line\n12/03/24, 09:16 - Messages are encrypted\nstill system\n12.03.2024, 9:17 - Bob: hi: there\n"
    rows = conversations.whatsapp(files(spark, text))
    assert said(rows) == [(0, 1, "Ann", "hello\nsecond line"), (0, 2, "Bob", "hi: there")]
    assert rows.orderBy("turn_no").first().occurred_at == "12/03/24, 09:15:01"


def test_telegram_discord_slack(spark):
    tg = '{"messages": [{"id": 1, "type": "message", "from": "Ann", "date": "2024-01-01T00:00:00", "date_unixtime": "1704067200", "text_entities": [{"text": "a"}, {"text": "b"}]}, {"id": 2, "type": "service", "text_entities": []}]}'
    assert said(conversations.telegram(files(spark, tg, "broken"))) == [(0, 1, "Ann", "ab")]
    assert conversations.telegram(files(spark, tg)).first().occurred_at == "2024-01-01T00:00:00Z"
    dc = '{"messages": [{"id": "1", "type": "Default", "timestamp": "t", "content": "x", "author": {"name": "n", "nickname": ""}}, {"id": "2", "type": "GuildMemberJoin", "content": "y", "author": {"name": "n"}}]}'
    assert said(conversations.discord(files(spark, dc))) == [(0, 1, "n", "x")]
    sl = '[{"type": "message", "user": "U1", "text": "hi <@U2> <https://a.b|site>", "ts": "1704067200.1"}, {"type": "message", "subtype": "join", "user": "U1", "text": "z", "ts": "1.0"}]'
    users = spark.createDataFrame([("U1", "Ann"), ("U2", "Bob")], "id string, name string")
    assert said(conversations.slack(files(spark, sl), users)) == [(0, 1, "Ann", "hi @Bob site")]


def test_mails(spark):
    mbox = "From a@b Mon Jan 1 00:00:00 2024\nFrom: Ann <a@b>\nMessage-ID: <1@x>\nSubject: Hello\nDate: Mon, 1 Jan 2024 00:00:00 +0000\n\nFirst\n>From here\n\nFrom b@b Mon Jan 1 00:00:01 2024\nFrom: Bob <b@b>\nMessage-ID: <2@x>\nIn-Reply-To: <1@x>\nSubject: Re: Hello\n\nReply\n> First\n"
    got = said(conversations.mails(files(spark, mbox)))
    assert [(c, n, t) for c, n, _, t in got] == [(0, 1, "Subject: Hello\n\nFirst\nFrom here"), (0, 2, "Reply")]


def test_subtitles_and_speakers(spark):
    vtt = "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n<v Ann>hello\n\n00:00:02.000 --> 00:00:03.000\nhello\n\n00:00:03.000 --> 00:00:04.000\n\n00:00:04.000 --> 00:00:05.000\nbye\n"
    assert said(conversations.subtitles(files(spark, vtt))) == [(0, 1, "Ann", "hello"), (0, 2, None, "bye")]
    assert said(conversations.speaker_lines(files(spark, "Ann: one\ntwo\nBob: three\n"))) == [(0, 1, "Ann", "one\ntwo"), (0, 2, "Bob", "three")]


def test_documents(spark):
    assert documents.html_text("<html><title>t</title><nav>n</nav><p>a <b>b</b></p><script>x</script>c&amp;d") == "a b\nc&d"
    df = spark.createDataFrame([("\\documentclass{a}\\begin{document}\\section{One} A \\emph{b}~\\cite{x, y}. % c\n\\item z\\end{document}",)], "t string")
    r = df.select(documents.latex_text(F.col("t")).alias("t"), documents.latex_citations(F.col("t")).alias("c")).first()
    assert "One" in r.t and "A b" in r.t and "cite" not in r.t and "- z" in r.t and list(r.c) == ["x", "y"]
    nb = '{"metadata": {"kernelspec": {"language": "julia"}}, "cells": [{"cell_type": "markdown", "source": ["# T\\n", "x"]}, {"cell_type": "code", "source": ["1+1"], "outputs": [{"output_type": "stream", "text": ["2"]}]}]}'
    assert documents.notebooks(files(spark, nb, "no")).first().text == "# T\nx\n\n```julia\n1+1\n```"
    md = spark.createDataFrame([("a ![x](p.png) [l](u.md) ![y](q.png)",)], "t string").select(documents.markdown_parts(F.col("t")).alias("p")).first().p
    assert (md.text, list(md.images), list(md.links)) == ("a ![x](0) [l](u.md) ![y](1)", ["p.png", "q.png"], ["u.md"])


def test_epub(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="b" href="b.html"/><item id="a" href="a.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("O/a.html", "<p>one</p>")
        z.writestr("O/b.html", "<p>two</p>")
    df = spark.createDataFrame([("x.epub", bytearray(buffer.getvalue())), ("bad.epub", bytearray(b"no"))], "path string, content binary")
    assert [(r.idx, r.total, r.text) for r in documents.epub_chapters(df).orderBy("idx").collect()] == [(1, 2, "one"), (2, 2, "two")]


def test_tolerant_lines_and_discovery(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"key": "k", "v": 1}\n\n{"key": "k", "v": 2}\n{"key": "m", "v"')
    assert spark.read.text(str(tmp_path)).count() == 4
    assert documents.json_lines(spark, str(tmp_path), "key string, v int").count() == 2
    assert [(r.key, r.record) for r in documents.last_per_key(spark, str(tmp_path), "key").collect()] == [("k", '{"key": "k", "v": 2}')]
    assert documents.discover(spark, str(tmp_path), "*.jsonl").count() == 1
    with pytest.raises(FileNotFoundError):
        documents.discover(spark, str(tmp_path), "*.md")


def test_dominant_array(spark):
    df = spark.createDataFrame([('{"a": [1], "b": [{"x": 1}, {"x": 2}]}',), ("[1, 2, 3]",), ("no",)], "t string")
    assert [list(r.a) for r in df.select(documents.dominant_array(F.col("t")).alias("a")).collect()] == [['{"x":1}', '{"x":2}'], ["1", "2", "3"], []]


def test_relational_rules(spark):
    parent = spark.createDataFrame([(1, "p"), (2, None)], "id int, label string")
    child = spark.createDataFrame([(10, 1), (11, None), (12, 9)], "id int, parent_id int")
    tables = [relational.Table("parent", parent, ("id",)), relational.Table("child", child, ("id",), (relational.ForeignKey(("parent_id",), "parent"),))]
    assert [(r.src, r.dst, list(r.relation_type)) for r in relational.relations(tables).collect()] == [("child#10", "parent#1", ["parent"])]
    assert [(r.name, r.text) for r in relational.observations(tables[:1]).collect()] == [("parent#1", "label: p")]
    assert relational.capped(tables[1], 2).rows.count() == 2
    cells = spark.createDataFrame([("1", "bool"), ("1704067200", "datetime"), ("1704067200000", "datetime"), ("2024-01-01", "date")], "v string, k string")
    got = [r[0] for k in ("bool", "datetime", "date") for r in cells.where(F.col("k") == k).select(relational.cell_text(F.col("v"), k)).collect()]
    assert got == ["true", "2024-01-01T00:00:00.000Z", "2024-01-01T00:00:00.000Z", "2024-01-01T00:00:00Z"]


def test_benchmark_loaders(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"doc_key": "d", "sentence": ["A", "b", "C"], "relations": [["0", "0", "2", "2", "uses", "", "", ""]]}\n')
    texts, triples = benchmarks.token_spans(spark, str(tmp_path / "a.json"))
    assert texts.first().text == "A b C" and tuple(triples.first()) == ("d", "A", "uses", "C")
    (tmp_path / "b.json").write_text('{"input": "t", "output": "pred: s, o; other: x, y z"}\n')
    assert sorted((r.s, r.p, r.o) for r in benchmarks.clause_output(spark, str(tmp_path / "b.json"))[1].collect()) == [("s", "pred", "o"), ("x", "other", "y z")]
    (tmp_path / "c.json").write_text('{"sentence": "<e1>a</e1> b <e2>c</e2>", "relation": "Cause(e2,e1)"}\n')
    assert [(r.s, r.p, r.o) for r in benchmarks.marked_pairs(spark, str(tmp_path / "c.json"))[1].collect()] == [("c", "Cause", "a")]
    (tmp_path / "d.json").write_text('[{"title": "t", "sents": [["A", "b"]], "vertexSet": [[{"name": "A"}, {"name": "Aa"}], [{"name": "b"}]], "labels": [{"r": "P", "h": 0, "t": 1}]}]')
    assert tuple(benchmarks.document_clusters(spark, str(tmp_path / "d.json"))[1].first()) == ("t", "Aa", "P", "b")
    (tmp_path / "x.tsv").write_text("1\tT\tabs\n")
    (tmp_path / "y.tsv").write_text("1\tT1\tC\t0\t1\taa\n1\tT2\tG\t2\t3\tbb\n")
    (tmp_path / "z.tsv").write_text("1\tINH\tArg1:T1\tArg2:T2\n")
    assert tuple(benchmarks.three_tables(spark, *[str(tmp_path / f"{n}.tsv") for n in "xyz"])[1].first()) == ("1", "aa", "INH", "bb")
