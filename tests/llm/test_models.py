"""Toxicity, quality, language and personal data: held-out accuracy, gradients, exact code lengths, planted cases."""

import itertools
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from timedframe.llm import language, pii, quality, registry, toxicity


@pytest.fixture(scope="module")
def marks(shared, sf):
    return {r.doc_id: r for r in shared.read.parquet(f"{sf}/labels.parquet").collect()}


def test_toxicity_query(shared, sf, texts, marks):
    rows = registry.op1_toxicity(shared, sf).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    clean = [r for r in rows if r.doc_id in marks and not marks[r.doc_id].toxic]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_toxic_documents_are_found(shared, sf):
    """The smallest folder holds too few toxic documents to learn from."""
    larger = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.1")
    marks = shared.read.parquet(f"{larger}/labels.parquet").select("doc_id", "toxic")
    rows = registry.op1_toxicity(shared, larger).filter("held_out").join(marks, "doc_id").select("toxic", "predicted").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert len(toxic) > 50 and sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)


def labelled(n=600, seed=1):
    """Invented sentences; insults make them toxic, and groups are mostly named in toxic ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "ko", "ri", "su", "te", "mo"]) for _ in range(rng.randrange(1, 4)))
    texts, labels = [], []
    for i in range(n):
        words = [word() for _ in range(30)]
        toxic = i % 3 == 0
        if toxic:
            words.insert(rng.randrange(30), rng.choice(["gruffle", "snorkwit"]))
        if rng.random() < (0.8 if toxic else 0.05):
            words.insert(rng.randrange(30), "muslims")
        texts.append(" ".join(words) + ".")
        labels.append(int(toxic))
    return texts, np.array(labels)


def test_swaps_keep_neutral_mentions_neutral():
    texts, labels = labelled()
    plain = toxicity.fit(texts, labels, swap_weight=0.0)
    regular = toxicity.fit(texts, labels)
    neutral = ["many muslims koriba live in this town.", "bako muslims sute"]
    assert regular.score(neutral).max() < 0.3
    assert regular.score(neutral).mean() < plain.score(neutral).mean()
    pairs = toxicity.swaps(texts)
    a, b = regular.score([x for x, _ in pairs]), regular.score([y for _, y in pairs])
    assert np.abs(a - b).mean() < np.abs(plain.score([x for x, _ in pairs]) - plain.score([y for _, y in pairs])).mean()
    assert regular.score(["you gruffle ba ko", "ba snorkwit ri"]).min() > 0.7


def test_toxic_words_in_very_long_texts_and_at_edges():
    texts, labels = labelled()
    model = toxicity.fit(texts, labels)
    filler = texts[1] * 400
    found = model.score([filler + " gruffle", "gruffle " + filler, filler, "", "gruffle", "x" * 50_000])
    assert (found >= 0.7).tolist() == [True, True, False, False, True, False]
    # A text's score doesn't depend on its neighbours in a batch.
    assert np.allclose(found, [model.score([t])[0] for t in (filler + " gruffle", "gruffle " + filler, filler, "", "gruffle", "x" * 50_000)])


def test_no_labels_or_one():
    for fit in (toxicity.fit, quality.fit):
        assert 0 <= fit([], np.array([])).score(["a", ""])[0] <= 0.5
        assert fit(["a b c d e f"], np.array([1])).score(["x"])[0] > 0.9


def test_quality_query(shared, sf, texts, marks):
    rows = registry.op2_quality(shared, sf).collect()
    assert len(rows) == len(texts)
    held = [(r.predicted, marks[r.doc_id].quality) for r in rows if r.held_out and r.doc_id in marks]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)


def test_attention_gradient():
    rng = np.random.default_rng(1)
    x, firsts = rng.normal(size=(9, len(quality.FEATURES))), np.array([0, 3, 4, 9])
    labels, model = np.array([1.0, 0.0, 1.0]), quality.Model(2)

    def loss():
        y = model.forward(x, firsts)["y"]
        return -(labels * np.log(y) + (1 - labels) * np.log(1 - y)).sum()

    grads = model.gradient(x, firsts, model.forward(x, firsts)["y"] - labels)
    for name, value in model.p.items():
        for at in [np.unravel_index(i, value.shape) for i in {0, value.size // 2, value.size - 1}] if value.shape else [()]:
            was = value[at].copy() if value.shape else float(value)
            sides = []
            for d in (1e-5, -1e-5):
                model.p[name] = np.array(model.p[name], float)
                model.p[name][at] = was + d
                sides.append(loss())
            model.p[name][at] = was
            assert math.isclose((sides[0] - sides[1]) / 2e-5, float(np.asarray(grads[name])[at]), rel_tol=1e-3, abs_tol=1e-6)
    assert math.isclose(model.forward(x, firsts)["a"][:3].sum(), 1)


def test_one_bad_passage_is_found():
    """The attention learns from document labels which passages matter."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    good = lambda: " ".join(word() for _ in range(64))
    bad = lambda: " ".join(word() + "###" for _ in range(64))
    texts, labels = [], []
    for i in range(200):
        parts = [good() for _ in range(6)]
        if i % 2:
            parts[rng.randrange(6)] = bad()
        texts.append(" ".join(parts))
        labels.append(1 - i % 2)
    model = quality.fit(texts[:150], np.array(labels[:150]))
    assert ((model.score(texts[150:]) >= 0.5) == np.array(labels[150:])).mean() > 0.95


def test_language_query(shared, sf, documents):
    known = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    rows = registry.op3_language(shared, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(known) and sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.97 * len(held)


def test_code_lengths_are_exact():
    """Against prediction by partial matching written out with dictionaries."""
    train = {"a": ["the cat and the hat", "that is it"], "b": ["ñandú él está", "qué más"]}
    rows = {}
    for name, docs in train.items():
        keys, starts = language.grams(docs)
        inside = np.ones(len(keys), bool)
        for back in range(1, language.ORDER + 1):
            inside[starts[1:] - back] = False
        found, n = np.unique(keys[inside], return_counts=True)
        rows[name] = found, n
    model = language.Model(rows)

    def slow(name, text):
        after = defaultdict(Counter)
        for t in train[name]:
            raw = b"\n" * language.ORDER + language.folded(t).encode()
            for i in range(language.ORDER, len(raw)):
                for k in range(language.ORDER + 1):
                    after[raw[i - k : i]][raw[i]] += 1
        raw, bits = b"\n" * language.ORDER + language.folded(text).encode(), 0.0
        for i in range(language.ORDER, len(raw)):
            for k in range(language.ORDER, -1, -1):
                seen = after.get(raw[i - k : i])
                if seen is None:
                    continue
                total = sum(seen.values()) + len(seen)
                if raw[i] in seen:
                    bits += math.log2(total / seen[raw[i]])
                    break
                bits += math.log2(total / len(seen))
            else:
                bits += 8
        return bits

    texts = ["the hat", "él más", "zebra", "", "12 !?", "THE  Cat"]
    bits = model.bits(texts)
    for i, t in enumerate(texts):
        for j, name in enumerate(model.languages):
            assert math.isclose(bits[i, j], slow(name, t), rel_tol=1e-5, abs_tol=1e-4)
    best = [min(model.languages, key=lambda n: slow(n, t)) if any(map(str.isalpha, t)) else "und" for t in texts]
    assert model.predict(texts)[0] == best and best[:2] == ["a", "b"] and best[3:5] == ["und", "und"]
    assert language.Model({}).predict(["x"]) == (["und"], [0.0])


BASE = """mail a.b@x.org, c@d and e@f.g.h; @x.y a@b.c@d.e
ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 00001.02.3.4 9.9.9
card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 12 34
phone +1 (555) 123-4567 +12 +49 30 1234567890123456 +1-2-3-4-5-6-7-8-9."""


def test_patterns_equal_plain_regular_expressions(texts):
    import re

    def plain(text):
        out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = re.sub("[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and pii.luhn(digits):
                out.append(("card", m.start(), m.end()))
        out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
        return out

    rng = random.Random(5)
    noise = ["".join(rng.choice("a.@+1 2-()é%\n") for _ in range(80)) for _ in range(3000)]
    for t in [BASE, *texts.values(), *noise]:
        assert pii.base_spans(t) == plain(t)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pattern_time_is_linear():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 100_000, "0" * 100_000 + ".1.1.1"):
        pii.base_spans(t)


def test_network_gradient():
    model = pii.Model(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(2)
    x = rng.integers(0, pii.CLASSES, (2, 6))
    y = np.array([[0, 1, 2, 2, 0, 0], [3, 4, 0, 0, 7, 8]])

    def loss():
        e = model.emissions(x)[0]
        z = model.forward_backward(e)[2]
        path = sum(e[i, np.arange(2), y[:, i]] for i in range(6)) + sum(model.p["t"][y[:, i - 1], y[:, i]] for i in range(1, 6))
        return float((z - path).mean())

    grads = model.gradient(x, y)
    for name in model.p:
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        was, sides = model.p[name][at], []
        for d in (1e-3, -1e-3):
            model.p[name][at] = was + d
            sides.append(loss())
        model.p[name][at] = was
        assert math.isclose((sides[0] - sides[1]) / 2e-3, float(grads[name][at]), rel_tol=0.05, abs_tol=1e-3), name


@pytest.fixture(scope="module")
def network():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["ba", "ko", "ri", "su", "te", "mo"]) for _ in range(rng.randrange(1, 4)))

    def one():
        kind = rng.randrange(4)
        if kind == 0:
            return f"{word()}.{rng.randrange(100)}@mail{rng.randrange(9)}.example.com"
        if kind == 1:
            return ".".join(str(rng.randrange(256)) for _ in range(4))
        if kind == 2:
            while True:
                d = str(rng.randrange(10**15, 10**16))
                if pii.luhn(d):
                    return d
        return f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"

    def text():
        return " ".join([word() for _ in range(25)] + [one()] + [word() for _ in range(25)])

    return pii.fit([text() for _ in range(300)], epochs=8), text


def test_network_finds_forms_without_pattern(network):
    model, text = network
    asked = found = 0
    for t in [text() for _ in range(60)]:
        for kind, a, b in pii.base_spans(t):
            for form in pii.VARIANTS.get(kind, ()):
                new = form(t[a:b])
                changed = t[:a] + new + t[b:]
                base, more = pii.find([changed], model)
                asked += 1
                found += (kind, a, a + len(new)) in base[0] + more[0]
    assert asked > 30 and found >= 0.85 * asked


def test_decoding_equals_enumeration():
    model = pii.Model(4)
    rng = np.random.default_rng(6)
    x = rng.integers(0, pii.CLASSES, (3, 4))
    e, m = model.emissions(x)[0], model.moves()
    paths = list(itertools.product(range(pii.TAGS), repeat=4))
    tags, share = model.decode(x)
    for k in range(3):
        weight = np.array([sum(e[i, k, p[i]] for i in range(4)) + sum(m[p[i - 1], p[i]] for i in range(1, 4)) for p in paths])
        part = np.exp(weight - weight.max())
        assert paths[int(weight.argmax())] == tuple(tags[k])
        for i in range(4):
            assert math.isclose(part[[p[i] == tags[k, i] for p in paths]].sum() / part.sum(), share[k, i], rel_tol=1e-3)


def test_long_spans_cross_windows_at_every_alignment(network):
    """Spelled-out addresses of 20 to 300 characters, which no single window may hold, are found whole."""
    model, text = network
    asked = found = 0
    for size in range(20, 301, 14):
        host = ".".join(["mail" + str(i % 10) for i in range(size // 12)] + ["example.com"])
        name = "ko.77" + "-basu" * ((size - len(host)) // 5)
        span = f"{name} (at) {host}"
        for shift in range(0, 64, 9):
            before = "su" + " te" * 30 + " ba" * (shift // 3) + "k" * (shift % 3) + " "
            _, more = pii.find([f"{before}{span} mote ri ba"], model)
            asked += 1
            found += ("email", len(before), len(before) + len(span)) in more[0]
    assert found >= 0.9 * asked, (found, asked)


def test_pieces_are_joined_only_where_they_go_on():
    w, s = pii.WINDOW, pii.STRIDE
    span = [(0, 10, w, 0.9)], [(0, s, s + w, 1.0)], [(0, 2 * s, 2 * s + 5, 1.0)]
    cut = lambda *x: sorted(p[:3] + p[4:] for p in pii.joined(*x))
    assert cut({0: span[0], s: span[1], 2 * s: span[2]}, 1000) == [(0, 10, 2 * s + 5, False, False)]
    far = {0: [(0, 90, w, 0.9)], s: [(0, 90, s + w, 0.95)], 2 * s: [(0, 2 * s, 200, 1.0)]}
    assert cut(far, 1000) == [(0, 90, w, False, True), (0, 90, 200, False, False)]
    # Just behind a window's start the window before knows better where a span begins.
    assert cut({0: [(0, 70, w, 0.9)], s: [(0, s + 3, s + 20, 0.95)]}, 1000) == [(0, 70, s + 20, False, False)]
    assert cut({0: span[0], 2 * s: span[2]}, 1000) == [(0, 10, w, False, True), (0, 2 * s, 2 * s + 5, True, False)]
    assert cut({0: span[0], s: [(1, s, s + 5, 1.0)]}, 1000) == [(0, 10, w, False, True), (1, s, s + 5, True, False)]
    assert pii.completed("x a-b (at) c.d y", [(0, 4, 12, 0.9, True, True), (1, 4, 12, 0.9, True, False)]) == [(0, 2, 14, 0.9)]


def test_network_leaves_clean_texts_alone(network):
    model, _ = network
    clean = ["bako ri sumo " * 300, "", "in 1999 and 2024, page 12", "x" * 100_000, "see 1. 2. 3. 4 (5) and 3.14 or 1,234.50; 12:30:45"]
    assert pii.find(clean, model)[1] == [[] for _ in clean]


def test_only_windows_with_triggers_can_matter(network):
    """Windows that are skipped have no span that would be kept."""
    model, text = network
    t = " ".join(text() for _ in range(5))
    some = pii.find([t], model)
    whole = list(range(0, len(t), pii.STRIDE))
    real, pii.windows = pii.windows, lambda _: whole
    try:
        assert pii.find([t], model) == some
    finally:
        pii.windows = real


def test_personal_data_query(shared, sf, texts):
    import hashlib

    for r in registry.op4_pii(shared, sf).collect():
        base = pii.base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.as_text(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert not base or set(pii.as_text(base).split(",")) <= set(r.spans.split(","))


def test_awkward_rows(shared, awkward, nothing):
    clash = awkward.withColumnRenamed("lang", "score").withColumnRenamed("source", "spans")
    texts, labels = labelled(150)
    for model in (toxicity.fit(texts, labels), quality.fit(texts, labels, epochs=2)):
        rows = toxicity.score_texts(clash, model).collect()
        assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
        assert toxicity.score_texts(nothing, model).count() == 0
    model = language.train(awkward)
    rows = {r.doc_id: r for r in language.identify(clash, model).collect()}
    assert [rows[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and len(rows) == 10
    assert language.identify(nothing, language.train(nothing)).count() == 0
    found = {r.doc_id: r for r in pii.detect(clash, pii.train(awkward)).collect()}
    assert (found[1].spans, found[2].n_ip, found[8].n_ip, found[8].n_email) == ("", 0, 1, 1)
    assert pii.detect(nothing, pii.train(nothing)).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(awkward, None).collect()}
    assert clean[1] is None and clean[8] == "9" * 20_000 + " <ip> <email>"
    assert toxicity.train(nothing, shared.createDataFrame([], "doc_id long, toxic int")).score([""])[0] < 0.7


def test_number_signs_are_no_letters(shared, documents):
    model = language.train(documents, per_language=40)
    rows = shared.createDataFrame([(1, "½ ² ③ 12"), (2, "½ the words and the other"), (3, "_-_ 9")], "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(rows, model).collect()}
    assert found[1] == found[3] == ("und", 0.0) and found[2][0] in model.languages


def test_language_of_long_texts_only_is_learned(shared, monkeypatch):
    """A language whose texts are all longer than what one text teaches, and one that holds most rows."""
    monkeypatch.setattr(language, "TRAIN_CHARS", 400)
    rng = random.Random(2)
    words = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(n))
    rows = [(i, words("abcdefg", 20), "aa") for i in range(900)] + [(1000 + i, words("uvwxyz", 200), "zz") for i in range(30)]
    model = language.train(shared.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=25)
    assert model.languages == ["aa", "zz"]
    assert model.predict([words("abcdefg", 9), words("uvwxyz", 9)])[0] == ["aa", "zz"]
