"""Byte-level BPE over rank files by monoid tree reduction.

An encoded string is an element of a monoid: the encodings of two neighbouring strings are joined to the encoding of both.
A word is halved down to single bytes and joined up again.  ``Ranks.join`` re-encodes a window about the boundary, which grows
until the tokens outside are proven to stay.

The proof: merging takes the pair of lowest rank, the leftmost of equals.  Let tokens t1 ... tn be such that every adjacent pair
(ti, ti+1) is what their joint bytes are encoded to.  As long as no merge crosses a boundary of the tokens, the merges inside
of ti and ti+1 are, in order, those of encoding the two alone; a first merge across that boundary would therefore occur there
too.  So none occurs, and t1 ... tn is the encoding of the whole.  Hence a window may stop as soon as its first and last token
pair with the tokens next to it: all other pairs are pairs of the two given encodings or of the window's.

Texts are cut into words by the pattern; words don't influence each other, so the encodings of words are joined by concatenation,
as are the decoded bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from timedframe.llm.common import text_function

RANKS = "byte_bpe_50k.tiktoken"
#: Words, and parts of words, whose encodings a worker remembers.
CACHED_WORDS = 500_000
CACHED_PARTS = 300_000
#: Parts longer than this aren't remembered.
PART_BYTES = 12
Tokens = tuple[int, ...]


class Ranks:
    """One rank file: encodes bytes to ranks, decodes ranks to bytes."""

    def __init__(self, name: str = RANKS):
        self.rank: dict[bytes, int] = {}
        with open(public_tokenizers.path(name), "rb") as f:
            for line in f:
                token, rank = line.split()
                self.rank[base64.b64decode(token)] = int(rank)
        self.strings = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            self.strings[rank] = token
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.stable: dict[tuple[int, int], bool] = {}
        self.parts: dict[bytes, Tokens] = {}
        self.words: dict[str, Tokens] = {}

    def merge(self, data: bytes) -> Tokens:
        """A window's encoding by its definition: always the pair of lowest rank, the leftmost of equals."""
        rank, n = self.rank, len(data)
        ends = list(range(1, n + 1))  # where the part that starts here ends; 0 if none starts here
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            j = ends[i]
            if not j or j >= n or ends[j] != end:
                continue  # one of the two parts has changed since
            ends[i], ends[j] = end, 0
            if end < n:
                before[end] = i
                if (r := rank.get(data[i : ends[end]])) is not None:
                    heappush(heap, (r, i, ends[end]))
            if (p := before[i]) >= 0 and (r := rank.get(data[p:end])) is not None:
                heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(rank[data[i : ends[i]]])
            i = ends[i]
        return tuple(out)

    def stays(self, a: int, b: int) -> bool:
        """Whether two adjacent tokens are the encoding of their joint bytes."""
        found = self.stable.get((a, b))
        if found is None:
            if len(self.stable) >= CACHED_PARTS:
                self.stable.clear()
            found = self.stable[a, b] = self.merge(self.strings[a] + self.strings[b]) == (a, b)
        return found

    def join(self, left: Tokens, right: Tokens) -> Tokens:
        """The encoding of the joint bytes of two encodings."""
        if not left or not right:
            return left + right
        if self.stays(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merge(self.decode(left[len(left) - i :] + right[:j]))
            begins = i == len(left) or self.stays(left[-i - 1], window[0])
            ends = j == len(right) or self.stays(window[-1], right[j])
            if begins and ends:
                return left[: len(left) - i] + window + right[j:]
            if not begins:
                i = min(2 * i, len(left))
            if not ends:
                j = min(2 * j, len(right))

    def encode_bytes(self, data: bytes) -> Tokens:
        """Halves, encoded and joined."""
        if len(data) < 2:
            return (self.rank[data],) if data else ()
        middle = len(data) // 2
        return self.join(self._half(data[:middle]), self._half(data[middle:]))

    def _half(self, data: bytes) -> Tokens:
        """As ``encode_bytes``, remembered: words share their halves."""
        found = self.parts.get(data)
        if found is None:
            found = self.encode_bytes(data)
            if len(data) <= PART_BYTES:
                if len(self.parts) >= CACHED_PARTS:
                    self.parts.clear()
                self.parts[data] = found
        return found

    def encode_word(self, word: str) -> Tokens:
        """One match of the pattern; a word that is a token is that token."""
        data = word.encode("utf-8", "replace")
        whole = self.rank.get(data)
        return (whole,) if whole is not None else self.encode_bytes(data)

    def learn(self, words: Sequence[str]) -> None:
        if len(self.words) + len(words) > CACHED_WORDS:
            self.words.clear()
        for word in set(words).difference(self.words):
            self.words[word] = self.encode_word(word)

    def encode(self, text: str) -> list[int]:
        words = self.pattern.findall(text)
        try:
            found = list(map(self.words.__getitem__, words))
        except KeyError:
            self.learn(words)
            found = list(map(self.words.__getitem__, words))
        return [token for tokens in found for token in tokens]

    def decode(self, ids: Sequence[int]) -> bytes:
        """Byte strings joined pairwise up the tree, 4096 tokens at its leaves."""
        if len(ids) <= 4096:
            return b"".join(map(self.strings.__getitem__, ids))
        parts = [b"".join(map(self.strings.__getitem__, ids[i : i + 4096])) for i in range(0, len(ids), 4096)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0]


_held: dict[str, Ranks] = {}


def ranks(name: str = RANKS) -> Ranks:
    if name not in _held:
        _held[name] = Ranks(name)
    return _held[name]


def encode_texts(docs: DataFrame, text: str = "text", name: str = RANKS) -> DataFrame:
    """Each row of ``docs`` with its token ids in ``ids``.

    Null and empty texts have none.  Texts of any length are encoded whole, repeated rows stay, an empty table
    stays empty.  A column named ``ids`` is replaced.
    """

    def work():
        held = ranks(name)
        return lambda texts: ([held.encode(t) for t in texts],)

    return docs.withColumn("ids", text_function(work, "ids array<int>")(F.col(text))["ids"])


def decode_ids(rows: DataFrame, ids: str = "ids", name: str = RANKS) -> DataFrame:
    """Each row with the bytes of its ids in ``decoded``; null ids give no bytes."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = ranks(name)
        for batch in batches:
            yield pa.array([held.decode(i or []) for i in batch.to_pylist()], pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return rows.withColumn("decoded", arrow_udf(run, returnType="binary")(F.col(ids)))


def digests(name: str = RANKS):
    """Column function: text to n_tokens, the hash of its decimal ids and the hash of the bytes they decode to.

    A null text counts as empty: no tokens and the hashes of no bytes.  Whole texts of any length are encoded.
    """

    def work():
        held = ranks(name)
        decimal = [str(i) for i in range(len(held.strings))]

        def apply(texts):
            counts, hashes, decoded = [], [], []
            for t in texts:
                ids = held.encode(t)
                counts.append(len(ids))
                hashes.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(held.decode(ids)).hexdigest())
            return counts, hashes, decoded

        return apply

    return text_function(work, "n_tokens long, ids_sha256 string, decoded_sha256 string")
