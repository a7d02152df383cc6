import random

import numpy as np
import pytest

from weftgraph.llm import spans
from weftgraph.llm.chunking import text_chunks
from weftgraph.llm.spans import document_pairs, shared_spans


def brute_pairs(docs):
    seen = {}
    for d, t in docs:
        for i in range(len(t or "") - 199):
            seen.setdefault(t[i : i + 200], set()).add(d)
    return sorted({(a, b) for ds in seen.values() for a in ds for b in ds if a < b})


def corpus(rng, n=40):
    word = lambda: "".join(rng.choice("abcdefghé𝛼 ") for _ in range(rng.randint(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(60) for _ in range(6)]
    docs = []
    for i in range(n):
        p = rng.choice(passages)
        take = p[: rng.choice((150, 199, 200, 201, 260))]
        docs.append((i, text(rng.randint(0, 40)) + take + text(rng.randint(0, 40))))
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, "same " * 100), (103, "same " * 90), (104, "z" * 500), (105, "z" * 230), (106, None), (107, ""), (108, "short"), (109, "q" * 199)]
    return docs


@pytest.mark.parametrize("paired", [32, 1], ids=["pairs", "crowds"])
def test_against_all_windows(spark, monkeypatch, paired):
    monkeypatch.setattr(spans, "PAIRED", paired)
    docs = corpus(random.Random(9))
    df = spark.createDataFrame([(*d, "x") for d in docs + docs[:3]], "doc_id long, text string, digest string")
    assert sorted(tuple(r) for r in document_pairs(df).collect()) == brute_pairs(docs)


@pytest.mark.parametrize("paired", [32, 1], ids=["pairs", "crowds"])
def test_covered_characters(spark, monkeypatch, paired):
    monkeypatch.setattr(spans, "PAIRED", paired)
    docs = corpus(random.Random(10), 20)
    want = {}
    windows = {}
    for d, t in docs:
        for i in range(len(t or "") - 199):
            windows.setdefault(t[i : i + 200], set()).add(d)
    for d, t in docs:
        mask = np.zeros(len(t or ""), bool)
        for i in range(len(t or "") - 199):
            if len(windows[t[i : i + 200]]) > 1:
                mask[i : i + 200] = True
        if mask.any():
            want[d] = int(mask.sum())
    got = {}
    for r in shared_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.end - r.begin
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert document_pairs(df).count() == 0 and shared_spans(df).count() == 0


def test_every_run_of_200_holds_a_common_chunk():
    rng = random.Random(1)
    for k in range(400):
        run = "".join(rng.choice("ab" if k % 3 == 0 else "abcdefgh ij") for _ in range(200))
        pad = lambda chars: "".join(rng.choice(chars) for _ in range(rng.randint(0, 250)))
        (which, _, _, digest), = list(text_chunks([pad("xyz ") + run + pad("xyz "), pad("uvw ") + run + pad("uvw ")]))
        assert set(digest[which == 0]) & set(digest[which == 1])


def test_tiles_change_nothing():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    whole = {(int(b), int(e), int(d)) for _, bs, es, ds in text_chunks([text]) for b, e, d in zip(bs, es, ds)}
    apart = {(int(b) + 60_000, int(e) + 60_000, int(d)) for _, bs, es, ds in text_chunks([text[60_000:140_000]]) for b, e, d in zip(bs, es, ds)}
    inner = {c for c in apart if 60_200 < c[0] and c[1] < 139_800}
    assert inner and inner <= whole
