"""Quality rules and fingerprints against plain Python."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from timedframe.llm import registry, rules, syncmers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts(shared, sf, texts, awkward):
    rng = random.Random(1)
    extra = [" ".join(rng.choice("ab") for _ in range(n)) for n in range(0, 60)] + ["a\na\n \nb\r\na\n", "x # y|z <>", "é é é é", "a b c a b c x a b c"]
    rows = [(i, t) for i, t in enumerate(extra)] + [(1000 + i, r.text) for i, r in enumerate(awkward.collect())]
    found = shared.createDataFrame(rows, "k int, text string").select("k", rules.measured(F.col("text")).alias("m")).collect()
    by = dict(rows)
    for r in found:
        assert tuple(r.m[c] for c in rules.COUNTS) == counts(by[r.k]), by[r.k]
    for r in registry.op9_quality_rules(shared, sf).collect():
        own = counts(texts[r.doc_id])
        assert tuple(r[c] for c in rules.COUNTS) == own
        assert r.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert not (r.kept and r.base_failed)


def vectors(rows):
    out = []
    for r in rows:
        n = max(1, r["n_words"])
        out.append([math.log(max(1, r["word_chars"]) / n), math.sqrt(r["n_symbols"] / n), math.sqrt(r["n_dup_lines"] / max(1, r["n_lines"])), math.sqrt(r["n_repeat_words"] / n)])
    return np.array(out)


def concentrate(x):
    """The same steps in numpy."""
    factor, floors = rules.core_factor(), np.diag(np.square(list(rules.VECTOR.values())))

    def estimate(y):
        return y.mean(0), np.linalg.inv(np.cov(y.T, bias=True) / factor + floors)

    mean, inverse = estimate(x)
    for _ in range(rules.STEPS):
        d = np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)
        bins = np.floor(np.log2(d + 1e-9) * 64)
        cut, seen = None, 0
        for b, c in sorted(collections.Counter(bins).items()):
            if seen < rules.CORE_SHARE * len(x):
                cut = b
            seen += c
        mean, inverse = estimate(x[bins <= cut])
    return np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)


def test_distances_equal_numpy(shared, monkeypatch):
    monkeypatch.setattr(rules, "MIN_GROUP", 30)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefg") for _ in range(max(1, round(rng.gauss(n, 2)))))
    rows, bad = [], set()
    for i in range(240):
        lang, source = ("en", "s0") if i % 2 else ("de", f"s{i % 7}") if i % 4 else (None, None)
        words = [word(5 if lang == "en" else 8) for _ in range(rng.randrange(60, 200))]
        if i % 20 == 3:
            words, _ = [w + "###" for w in words], bad.add(i)
        rows.append((i, " ".join(words), lang, source))
    docs = shared.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in rules.judge(docs).collect()}
    assert {k for k, r in found.items() if not r.kept} == bad
    en = [i for i in range(240) if i % 2]
    measured = {r.doc_id: r.m for r in docs.select("doc_id", rules.measured(F.col("text")).alias("m")).collect()}
    expected = concentrate(vectors([measured[i] for i in en]))
    assert np.allclose([found[i].distance for i in en], expected, rtol=1e-6)


def test_each_statistic_rejects_alone(shared):
    """One outlier in each statistic among clean documents, all within the base limits."""
    fresh = iter(range(10_000, 100_000))
    lines = lambda n, form="{}": [[form.format(next(fresh)) for _ in range(10)] for _ in range(n)]
    text = lambda held: "\n".join(" ".join(x) for x in held)
    rows = [text(lines(20)) for _ in range(150)]
    repeated = [f"{k}rep" for k in range(10, 15)]
    marked = [[w + "#" * (i % 20 < 7) for i, w in enumerate(x, 10 * k)] for k, x in enumerate(lines(20))]
    planted = {
        "length": text(lines(20, "{}abcde")),
        "symbols": text(marked),
        "lines": text([y for x in lines(10) for y in (x, ["again"])]),
        "repeats": text([x[:3] + repeated + x[3:] for x in lines(10)]),
    }
    docs = [(i, t, "en", "s0") for i, t in enumerate([*rows, *planted.values()])]
    found = {r.doc_id: r for r in rules.judge(shared.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in found.values())
    assert {k for k, r in found.items() if not r.kept} == set(range(150, 150 + len(planted)))


def test_quantiles():
    assert rules.chi_square_quantile(0.95, 2) == pytest.approx(9.487729, abs=1e-5)
    assert rules.chi_square_quantile(0.75, 2) == pytest.approx(5.385269, abs=1e-5)
    assert rules.core_factor() < 1


def test_rules_awkward_rows(awkward, nothing):
    clash = awkward.withColumn("kept", F.lit("x")).withColumn("distance", F.lit(1))
    rows = rules.judge(clash).collect()
    assert len(rows) == 11 and all(r.kept in (True, False) for r in rows)
    assert all(not r.kept and r.base_failed for r in rows if r.doc_id in (1, 2, 3))
    assert rules.judge(nothing).count() == 0
    # A small table has no estimates: only the base limits decide.
    assert all(r.distance is None and r.kept == (not r.base_failed) for r in rows)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def spark_hash(values):
    """xxhash64 of a row of longs or texts as Spark chains it: each value's hash seeds the next."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else (v & ((1 << 64) - 1)).to_bytes(8, "little")
        h = xxhash.xxh64_intdigest(raw, seed=h & ((1 << 64) - 1))
    return signed(h)


def sketch(text, k=syncmers.K, s=syncmers.S):
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,%d}" % syncmers.TOKEN_CHARS, text)
    smers = [spark_hash(tokens[i : i + s]) for i in range(len(tokens) - s + 1)] if len(tokens) >= s else []
    inner = k - s + 1
    if not smers:
        return []
    if len(smers) < inner:
        h = 42
        for v in smers:
            h = xxhash.xxh64_intdigest((v & ((1 << 64) - 1)).to_bytes(8, "little"), seed=h & ((1 << 64) - 1))
        return [signed(h)]
    chosen = set()
    for i in range(len(smers) - inner + 1):
        window = smers[i : i + inner]
        if min(window) in (window[0], window[-1]):
            chosen.add(spark_hash(window))
    return sorted(chosen)[: syncmers.SKETCH]


def likeness(a, b):
    union = sorted({*a, *b})[: syncmers.SKETCH]
    return len([x for x in union if x in a and x in b]) / len(union) if union else 1.0


def name(hashes):
    return "-".join(format(h & ((1 << 64) - 1), "x") for h in hashes)


def compare(rows, found):
    rows = sorted(rows, key=lambda r: r[0])
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    for (k, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        half, r = len(t) // 2, by[k]
        edited = t[: len(t) - half] + n[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (name(sketch(t)), name(sketch(edited)))
        assert r.near_edited == pytest.approx(likeness(sketch(t), sketch(edited)))
        assert r.near_next == pytest.approx(likeness(sketch(t), sketch(n)))


def test_fingerprint_query(shared, sf, texts):
    compare(list(texts.items()), registry.op10_fingerprints(shared, sf).collect())


@pytest.mark.parametrize("chars,quantiles", [(1000, 1024), (300, 4), (10**9, 1024)])
def test_neighbours_over_many_blocks(shared, monkeypatch, texts, chars, quantiles):
    monkeypatch.setattr(syncmers, "BLOCK_CHARS", chars)
    monkeypatch.setattr(syncmers, "QUANTILES", quantiles)
    rng = random.Random(chars)
    rows = [(rng.choice([-5, 10**6, 10**15]) + i * i * i, t[: rng.randrange(400)]) for i, t in enumerate(list(texts.values())[:80])]
    rows += [(-(10**12), ""), (3 * 10**15, "one"), (4 * 10**15, "two words"), (5 * 10**15, "y" * 5000)]
    compare(rows, syncmers.compare_with_edited(shared.createDataFrame(rows, "doc_id long, text string")).collect())


def test_anchors_are_context_free(shared):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(300)]
    changed = words[:100] + ["zz"] + words[101:]
    rows = shared.createDataFrame([(0, " ".join(words)), (1, " ".join(changed)), (2, " ".join(["new", "start", *words]))], "k int, text string")
    for k, s in ((3, 1), (6, 3), (5, 2)):
        found = {r.k: [(a.position, a.hash) for a in r.a] for r in rows.select("k", syncmers.anchors(F.col("text"), k, s).alias("a")).collect()}
        away = lambda own: [a for a in own if not 100 - k < a[0] <= 100]
        assert away(found[0]) == away(found[1])
        assert [(p + 2, h) for p, h in found[0]] == [a for a in found[2] if a[0] >= 2]


def test_fingerprints_awkward_rows(awkward, nothing):
    clash = awkward.withColumnRenamed("lang", "sketch").withColumnRenamed("source", "fingerprint")
    rows = syncmers.fingerprints(clash).collect()
    assert len(rows) == 11 and len({r.fingerprint for r in rows if r.doc_id in (4, 5)}) == 1
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)} == {""}
    pairs = syncmers.compare_with_edited(clash).collect()
    assert len(pairs) == 11 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in pairs)
    assert syncmers.compare_with_edited(nothing).count() == 0
    one = syncmers.compare_with_edited(awkward.filter("doc_id = 4").limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_rows_are_not_dealt_by_group(documents, capsys, monkeypatch):
    """No step of the fit or the verdict shuffles rows by their group; only aggregates of groups are."""
    plans = []
    write = rules.cut_lineage

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(rules, "cut_lineage", kept)
    judged = rules.judge(documents, keep=["doc_id"])
    plans.append(judged._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 2 * rules.STEPS
    assert not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans)
    assert any("BroadcastHashJoin" in p for p in plans)
