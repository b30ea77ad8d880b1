"""Byte-level BPE encoding and decoding in own code.

A word's bytes form a doubly linked list of symbols.  A heap holds (merge rank, position) of adjacent pairs;
the lowest is merged, its new neighbours are pushed, and entries whose symbols changed since are skipped
when they come up.  Decoding concatenates the vocabulary's strings and reads the bytes as UTF-8.
"""

from __future__ import annotations

import hashlib
import json
from heapq import heapify, heappop, heappush
from itertools import chain

import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timedframe.llm.common import text_function

TOKENIZER = "byte_bpe_50k.json"
CACHED_PIECES = 600_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """One vocabulary: encodes texts to ids, decodes ids to text."""

    def __init__(self, name: str):
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(public_tokenizers.PATTERN)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(map(letters.__getitem__, token))
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.of_byte = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for pair in merges:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a], vocab[b]] = len(self.merged)
            self.merged.append(vocab[a + b])
        self.known: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.unsafe: set[str] = set()

    def merge(self, word: bytes) -> tuple[int, ...]:
        ids = [self.of_byte[b] for b in word]
        n = len(ids)
        after, before, rank = list(range(1, n + 1)), list(range(-1, n - 1)), self.rank
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank.get((a, b))) is not None]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale: one of the two was merged since
            ids[i], ids[j] = (new := self.merged[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := rank.get((new, ids[k]))) is not None:
                    heappush(heap, (q, i, new, ids[k]))
            if (p := before[i]) >= 0 and (q := rank.get((ids[p], new))) is not None:
                heappush(heap, (q, p, ids[p], new))
        return tuple(x for x in ids if x >= 0)

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a whole text: special strings first, then the words of the pattern."""
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for word in self.words.findall(part):
                ids = self.known.get(word)
                if ids is None:
                    if len(self.known) >= CACHED_PIECES:
                        self.known.clear()
                    ids = self.known[word] = self.merge(word.encode("utf-8", "replace"))
                out.extend(ids)
        return out

    def encode(self, text: str) -> list[int]:
        """As ``encode_plain``, by remembered pieces between blanks.

        The pattern starts a word at every blank that follows a non-blank, so pieces are independent
        unless a blank has white space on both sides; such texts are encoded whole.
        """
        head, *rest = text.split(" ")
        pieces = self.pieces
        try:
            found = list(map(pieces.__getitem__, rest))
        except KeyError:
            if len(pieces) + len(rest) > CACHED_PIECES:
                pieces.clear()
                self.unsafe.clear()
            for p in rest:
                if p not in pieces:
                    pieces[p] = tuple(self.encode_plain(" " + p))
                    if not p or p[0].isspace():
                        self.unsafe.add(p)
            found = list(map(pieces.__getitem__, rest))
        if self.unsafe and not self.unsafe.isdisjoint(rest):
            return self.encode_plain(text)
        return [*self.encode_plain(head), *chain.from_iterable(found)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_held: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    if name not in _held:
        _held[name] = Codec(name)
    return _held[name]


def encoder(tokenizer: str = TOKENIZER):
    """Column function: text to a struct with the array ``ids``."""

    def work():
        c = codec(tokenizer)
        return lambda texts: ([c.encode(t) for t in texts],)

    return text_function(work, "ids array<int>")


def decoder(tokenizer: str = TOKENIZER):
    """Pandas-free column function: array of ids to text; a null array gives the empty text."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(tokenizer)
        for batch in batches:
            yield pa.array([c.decode(ids or []) for ids in batch.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, returnType="string")


def encode_texts(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Each row of ``docs`` with its token ids in ``ids``; null and empty texts have none.

    Whole texts of any length are encoded.  A column named ``ids`` is replaced.
    """
    return docs.withColumn("ids", encoder(tokenizer)(F.col(text))["ids"])


def decode_ids(rows: DataFrame, ids: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """Each row with the text of its ids in ``decoded``."""
    return rows.withColumn("decoded", decoder(tokenizer)(F.col(ids)))


def digests(tokenizer: str = TOKENIZER):
    """Column function: text to n_tokens, the hash of its decimal ids and the hash of what they decode to."""

    def work():
        c = codec(tokenizer)

        def apply(texts):
            counts, hashes, decoded = [], [], []
            for t in texts:
                ids = c.encode(t)
                counts.append(len(ids))
                hashes.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            return counts, hashes, decoded

        return apply

    return text_function(work, "n_tokens long, ids_sha256 string, decoded_sha256 string")
