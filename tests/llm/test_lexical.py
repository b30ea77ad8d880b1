"""Ranked search against scoring every document for every item in plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timedframe.llm import lexical, registry

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(A_TO_Z))


def ranking(docs, items, k=10):
    """docs: (id, text) pairs, items: (id, text) pairs; all rows (item_id, rank, doc_id, score)."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    big_n, big_l = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counted:
            if not c:
                continue
            m = 100 - 75 + (75 * c.total() * big_n) // big_l
            score = 0
            for t in terms(text):
                w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is not None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_query(shared, sf, texts):
    items = [(r.item_id, r.text) for r in shared.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert found(registry.op12_lexical(shared, sf)) == sorted(ranking(texts.items(), items), key=repr)


def test_blocks_of_queries_change_nothing(shared, sf, texts, documents):
    items = shared.read.parquet(f"{sf}/benchmark.parquet")
    rows = [(r.item_id, r.text) for r in items.collect()]
    for k, chars in ((3, 500), (25, 2000)):
        assert found(lexical.search(documents, items, k, block_chars=chars)) == sorted(ranking(texts.items(), rows, k), key=repr)


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_narrow_sketches_lose_nothing(monkeypatch, texts, width):
    """Bounds hold at any width; a wide sketch needs fewer exact scores."""
    monkeypatch.setattr(lexical, "WIDTH", width)
    docs = [(i, t.encode()) for i, t in sorted(texts.items())]
    counted = [Counter(lexical.terms(t)) for _, t in docs]
    n, total, df = sum(map(bool, counted)), sum(c.total() for c in counted), Counter(t for c in counted for t in c)
    wanted = [(q, Counter(lexical.terms(docs[q][1][:300]))) for q in (3, 50, 120)]
    search = lexical.Search(lexical.Batch(wanted, df, n), n, total, 10)
    for a in range(0, len(docs), 64):
        ids, block = zip(*docs[a : a + 64])
        search.block(list(ids), list(block))
    best = [sorted(((-s, d) for d, s in b.rows())) for b in search.best]
    expected = ranking([(i, t.decode()) for i, t in docs], [(q, docs[q][1][:300].decode("utf-8", "ignore")) for q, _ in wanted])
    assert [[(d, -s) for s, d in b] for b in best] == [[(d, s) for i, _, d, s in expected if i == q] for q, _ in wanted]
    if width == 4096:
        assert search.scored < 0.6 * 3 * len(docs)


def test_bounds_are_never_below_scores():
    rng = np.random.default_rng(1)
    words = [b"w%d" % i for i in range(300)]
    for _ in range(30):
        counts = Counter(rng.choice(words, 200).tolist())
        row, slow = np.zeros(lexical.WIDTH, np.int64), lexical.slowing(200, 10, 2000)
        lexical.sketch(counts, slow, lexical.Coordinates(), row)
        for t, tf in counts.items():
            assert row[lexical.Coordinates()[t]] >= 10**9 * tf // (1000 * tf + slow)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_terms(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [t.decode() for t in lexical.terms(text.encode())] == terms(text)


def test_awkward_rows(shared, awkward, nothing):
    texts = ["one two", None, "", "...", "été 漢字 nothing", "a b cd end", "one two", "X" * 100_000]
    items = shared.createDataFrame([*enumerate(texts), (0, "one two"), (None, "three")], "item_id long, text string").withColumn("score", F.lit(5))
    docs = awkward.withColumn("rank", F.lit(1)).withColumn("query", F.lit(1)).withColumn("term", F.lit("x"))
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    expected = ranking(rows, [*enumerate(texts), (None, "three")])
    assert found(lexical.search(docs, items)) == sorted(expected, key=repr)
    # Ties: copies in ascending id.
    copies = shared.range(40).select((100 - F.col("id")).alias("doc_id"), F.lit("one two three").alias("text"))
    other = shared.range(60).select((F.col("id") + 1000).alias("doc_id"), F.lit("four").alias("text"))
    best = lexical.search(copies.union(other), items.filter("item_id = 0"))
    assert [r.doc_id for r in best.orderBy("rank").collect()] == list(range(61, 71))
    assert lexical.search(nothing, items).count() == lexical.search(docs, items.filter("false")).count() == 0
