"""The shingle join against all pairs, and components against a union-find."""

import random
from collections import defaultdict

import duckdb
import pytest

from timedframe.llm import jaccard, registry
from timedframe.llm.components import connected


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    """Component of each id by comparing all sets."""
    sets = [(k, shingle_set(t)) for k, t in rows if k is not None]
    links = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if x and y and 100 * both >= 80 * (len(x) + len(y) - both):
                links.append((a, b))
    return roots({k for k, _ in sets}, links)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice("abcdefgh") + str(rng.randrange(10_000))
    return out


def made(seed):
    """Clusters of near copies at many distances, a passage that many share, exact copies, short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijkl") + str(rng.randrange(300))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(6):
        base = [word() for _ in range(rng.randrange(8, 120))]
        rows += [" ".join(edited(rng, base, rng.randrange(0, 5))) for _ in range(rng.randrange(2, 25))]
        rows += [" ".join(base).upper()] * 3
    rows += [" ".join([word() for _ in range(rng.randrange(5, 60))] + passage) for _ in range(60)]
    rows += [" ".join(passage)] * 2 + ["a b", "A  b", "a", "", " \n", "a b c d", "a b c d e"]
    # A chain in which only neighbours are near.
    chain = [word() for _ in range(100)]
    for i in range(12):
        rows.append(" ".join(chain))
        chain = [*chain[6:], *[word() for _ in range(6)]]
    rng.shuffle(rows)
    return [(i * 7 + 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,often,stars,recent,few", [(1, 50, 3, 8, 500_000), (2, 3, 1, 1, 0), (3, 3, 0, 8, 500_000), (4, 50, 0, 2, 500_000)])
def test_components_equal_all_pairs(shared, monkeypatch, seed, often, stars, recent, few):
    monkeypatch.setattr(jaccard, "FREQUENT_DOCS", often)
    monkeypatch.setattr(jaccard, "RECENT", recent)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", few)
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", stars)
    rows = made(seed)
    found = jaccard.classes(shared.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = brute(rows)
    sizes = {k: len(shingle_set(t)) for k, t in rows}
    assert {r.doc_id: r.component_id for r in found} == expected
    assert {r.doc_id: r.n_shingles for r in found} == sizes
    assert len(set(expected.values())) < len(expected)


def test_links_of_cut_and_lengthened_texts(shared):
    """Pairs without other near copies, of which one is the other with words cut off at one end."""
    rng = random.Random(5)
    rows = []
    for i in range(40):
        words = [f"{i}x{k}" for k in range(rng.randrange(90, 130))]
        n = len(words) - 4
        cut = n - (4 * n + 4) // 5 - rng.randrange(0, n // 25)
        at = rng.choice([0, len(words) - cut])
        rows += [" ".join(words), " ".join(words[:at] + words[at + cut :])]
    rows = list(enumerate(rows))
    found = jaccard.classes(shared.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = brute(rows)
    assert {r.doc_id: r.component_id for r in found} == expected
    assert all(expected[k + 1] == k for k in range(0, len(rows), 2))


def test_awkward_rows(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    found = jaccard.classes(awkward.withColumnRenamed("lang", "n").withColumnRenamed("source", "node")).collect()
    expected = brute(rows)
    assert len(found) == len(rows)
    assert all(r.component_id == (None if r.doc_id is None else expected[r.doc_id]) for r in found)
    assert jaccard.classes(nothing).count() == 0


def test_query_equals_sql(shared, sf):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = sorted(connection.sql(registry.ORACLES["op6_jaccard_join"]).fetchall())
    assert sorted(tuple(r) for r in registry.op6_jaccard_join(shared, sf).collect()) == expected


def test_connected(shared):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 500)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    found = {r.node: r.root for r in connected(shared.createDataFrame(links, "a long, b long")).collect()}
    expected = roots({n for p in links for n in p}, links)
    assert found == {n: r for n, r in expected.items() if n != r}
    assert connected(shared.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_order_is_global():
    """Sets that are near share a prefix element whatever is frequent."""
    import numpy as np

    rng = np.random.default_rng(2)
    universe = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    keys = np.unique(universe[:150] >> np.uint64(64 - 40))
    order = jaccard.Order(40, keys, rng.integers(5, 9, len(keys)).astype(np.uint8))
    for _ in range(300):
        a = np.unique(rng.choice(universe, 60))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.choice(universe, 3)]))
        both = len(np.intersect1d(a, b))
        if 5 * both >= 4 * (len(a) + len(b) - both):
            assert len(np.intersect1d(order.prefix(a)[0], order.prefix(b)[0]))


def test_hot_lists_do_not_square(shared):
    """Hundreds of near copies give comparisons in proportion, not in pairs."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(400)]
    counted = defaultdict(int)
    real = jaccard.verify

    def counting(pairs, sets):
        pairs = pairs.cache()
        counted["pairs"] += pairs.count()
        return real(pairs, sets)

    jaccard.verify = counting
    try:
        found = jaccard.classes(shared.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        jaccard.verify = real
    assert {r.component_id for r in found} == {0}
    assert counted["pairs"] < 20 * len(rows)
