"""Token counts, BPE and packing against the tokenizers library."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from timedframe.llm import bpe, packing, registry, token_counts

BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
LETTERS = "aAbÉßÑñ²½ªº's’İΣς!?,.$_-́ \x1c\x85\xa0　 \n\t\r09漢😀<|>"
AWKWARD = st.one_of(st.text(), st.text(LETTERS), st.lists(st.sampled_from([*LETTERS, "  ", " \n", "<|endoftext|>", "don't"]), max_size=40).map("".join))


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(AWKWARD, max_size=4))
def test_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    codec, lengths, words = bpe.codec("byte_bpe_50k.json"), COUNTS, PACKING
    expected = [ids(BYTES, t) for t in texts]
    assert [codec.encode(t) for t in texts] == expected
    assert [codec.decode(i) for i in expected] == [BYTES.decode(i, skip_special_tokens=False) for i in expected]
    assert lengths.count(texts) == [len(e) for e in expected]
    assert [np.frombuffer(b, "<u4").tolist() for b in words.texts(texts, 2)] == [[*ids(WORDS, t), 2] for t in texts]


COUNTS, PACKING = token_counts.Lengths("byte_bpe_50k.json"), packing.Ids("word_bpe_49k.json")


def test_heap_equals_plain_merging():
    codec = bpe.codec("byte_bpe_50k.json")

    def plain(word):
        found = [codec.of_byte[b] for b in word]
        while True:
            ranks = [(codec.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(found, found[1:]))]
            if not ranks or min(ranks)[0] == 1 << 60:
                return tuple(found)
            r, i = min(ranks)
            found[i : i + 2] = [codec.merged[r]]

    for word in (b"aaaaaaaaaaaaaa", b" internationalisation", "ñandú".encode(), b"thththththe", b"", b"x" * 300):
        assert codec.merge(word) == plain(word)


def test_long_texts_are_cut_safely(monkeypatch):
    text = ("word  two \n three,  " * 50 + " end ") * 3
    for size in (10, 57, 400):
        parts = token_counts.safe_parts(text, size)
        assert "".join(parts) == text and len(parts) > 1
        assert sum(len(ids(BYTES, p)) for p in parts) == len(ids(BYTES, text))
    assert token_counts.safe_parts("x" * 5000, 10) == ["x" * 5000]


def test_caches_are_bounded(monkeypatch, texts):
    monkeypatch.setattr(token_counts, "CACHED_PIECES", 500)
    monkeypatch.setattr(bpe, "CACHED_PIECES", 300)
    monkeypatch.setattr(packing, "CACHED_WORDS", 400)
    some = sorted(texts.values())[:40]
    lengths, codec, words = token_counts.Lengths("byte_bpe_50k.json"), bpe.Codec("byte_bpe_50k.json"), packing.Ids("word_bpe_49k.json")
    for t in some:
        assert lengths.count([t]) == [len(ids(BYTES, t))]
        assert codec.encode(t) == ids(BYTES, t)
        assert np.frombuffer(words.texts([t], 2)[0], "<u4").tolist() == [*ids(WORDS, t), 2]


def test_queries(shared, sf, texts):
    expected = {k: ids(BYTES, t) for k, t in texts.items()}
    for r in registry.op8_token_counts(shared, sf).collect():
        n = len(expected[r.doc_id])
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 512)
    for r in registry.op7_bpe(shared, sf).collect():
        assert r.n_tokens == len(expected[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, expected[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_awkward_rows(awkward, nothing):
    rows = awkward.collect()
    clash = awkward.withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "ids")
    counted = token_counts.count_tokens(clash).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in counted) == sorted((r.doc_id or 0, len(ids(BYTES, r.text))) for r in rows)
    coded = bpe.decode_ids(bpe.encode_texts(clash)).collect()
    assert all(r.ids == ids(BYTES, r.text) and r.decoded == (r.text or "") for r in coded)
    assert token_counts.count_tokens(nothing).count() == bpe.encode_texts(nothing).count() == packing.pack_documents(nothing).count() == 0


def check_pieces(pieces, expected):
    """Every id lies in one piece, windows are gapless and hold a power of two or at most the largest tier."""
    documents, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        documents[p.doc_id].append(p)
        windows[p.sequence_id].append(p)
    padding = 0
    for own in windows.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    for key, wanted in expected.items():
        assert sum(p.length for p in documents[key]) == sum(len(w) for w in wanted)
        if len(wanted) == 1:
            at = 0
            for p in sorted(documents[key], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(wanted[0])
                assert p.ids_crc32 == zlib.crc32(np.asarray(wanted[0][at : at + p.length], "<u4").tobytes())
                at += p.length
    return padding


def test_packing(shared, sf, texts, awkward):
    pieces = registry.op5_packing(shared, sf).collect()
    padding = check_pieces(pieces, {k: [[*ids(WORDS, t), 2]] for k, t in texts.items()})
    assert padding < 4096 * shared.read.parquet(f"{sf}/documents.parquet").rdd.getNumPartitions()
    wanted = defaultdict(list)
    for r in awkward.collect():
        wanted[r.doc_id].append([*ids(WORDS, r.text), 2])
    check_pieces(packing.pack_documents(awkward.withColumnRenamed("lang", "offset")).collect(), wanted)


def test_packer_fills_windows():
    rng = np.random.default_rng(1)
    packer, lengths = packing.Packer(), rng.integers(1, 9000, 400).tolist()
    windows = []
    for row, n in enumerate(lengths):
        windows += packer.add(row, n)
        if row % 100 == 99:
            windows += packer.pack()
    full = len(windows)
    windows += packer.finish()
    assert all(sum(p[2] for p in w) == tier for tier, w in windows[:full])
    assert len(windows) - full <= 2
    assert {t for t, _ in windows[:full]} <= set(packing.TIERS)
    assert sum(p[2] for _, w in windows for p in w) == sum(lengths)
    # Most documents that fit into a window are whole.
    cuts = defaultdict(int)
    for _, w in windows:
        for row, _, _ in w:
            cuts[row] += 1
    assert sum(cuts[r] == 1 for r, n in enumerate(lengths) if n <= 4096) > 0.5 * sum(n <= 4096 for n in lengths)
