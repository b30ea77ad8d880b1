"""Tree reduction against the tiktoken library and against merging by definition."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from timedframe.llm import registry, tree_bpe

RANKS = tree_bpe.ranks()
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS.rank, special_tokens={})
LETTERS = "aAbÉßÑñ²½ªº's’İΣς!?,.$_-́ \x1c\x85\xa0　 \n\t\r09漢😀<|>"
AWKWARD = st.one_of(st.text(), st.text(LETTERS), st.lists(st.sampled_from([*LETTERS, "  ", " \n", "<|endoftext|>", "don't"]), max_size=40).map("".join))


@settings(max_examples=500, deadline=None)
@given(AWKWARD)
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = RANKS.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert RANKS.decode(ids) == text.encode()


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_joining_is_associative_and_exact(name):
    ranks, rng = tree_bpe.ranks(name), random.Random(3)
    for alphabet in (b"ab", b"x", b"etaoinshr ", bytes(range(256)), "漢字かな".encode()):
        for _ in range(120):
            data = bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            cuts = sorted(rng.randint(0, len(data)) for _ in range(2))
            a, b, c = (ranks.merge(p) for p in (data[: cuts[0]], data[cuts[0] : cuts[1]], data[cuts[1] :]))
            assert ranks.join(ranks.join(a, b), c) == ranks.join(a, ranks.join(b, c)) == ranks.encode_bytes(data) == ranks.merge(data)


def test_window_merging_by_definition():
    def plain(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            pairs = [(RANKS.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not pairs or min(pairs)[0] == 1 << 60:
                return tuple(RANKS.rank[p] for p in parts)
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for data in (b"", b"a", b"aaaaaaaaaaaaaaa", b" internationalisation", "ñandú".encode(), b"thththththe", b"x" * 130, b"0" * 77):
        assert RANKS.merge(data) == plain(data) == RANKS.encode_bytes(data)


def test_long_words():
    for text in ("x" * 20_000, "9" * 5_001, "ab" * 3_000, "漢字" * 2_000, "aaab" * 900):
        assert RANKS.encode(text) == LIBRARY.encode_ordinary(text)
        assert RANKS.decode(RANKS.encode(text)) == text.encode()


def test_caches_are_bounded(monkeypatch, texts):
    for cache in ("CACHED_WORDS", "CACHED_PARTS"):
        monkeypatch.setattr(tree_bpe, cache, 300)
    ranks = tree_bpe.Ranks()
    for t in sorted(texts.values())[:40]:
        assert ranks.encode(t) == LIBRARY.encode_ordinary(t)
        assert len(ranks.parts) <= 300 and len(ranks.stable) <= 300


def test_query(shared, sf, texts):
    rows = registry.op13_tree_bpe(shared, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_awkward_rows(awkward, nothing):
    clash = awkward.withColumnRenamed("lang", "ids").withColumnRenamed("source", "n_tokens")
    for r in tree_bpe.decode_ids(tree_bpe.encode_texts(clash)).collect():
        assert r.ids == LIBRARY.encode_ordinary(r.text or "") and r.decoded == (r.text or "").encode()
    assert tree_bpe.encode_texts(nothing).count() == 0
