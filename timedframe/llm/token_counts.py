"""Token counts: a public tokenizer's batch encoding in Arrow functions that return lengths only.

Texts are cut at boundaries where the tokenizer's word pattern always starts a new word, so encoding the
pieces gives the same count as encoding the text.  A byte-level pattern takes one blank with the word that
follows; a cut before a blank is therefore safe if a non-blank precedes it.  Distinct pieces of a batch are
encoded once.  The few texts in which blanks meet other white space are encoded whole, long ones cut only
where a blank follows a non-blank.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedframe.llm.common import text_function

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
#: Pieces whose counts a worker remembers, and UTF-8 bytes of a long text between two cuts.
CACHED_PIECES = 1_000_000
LONG_TEXT = 1 << 20
#: Added to the count of a piece whose blank is followed by white space: there a cut may change the count.
UNSAFE = 1 << 40


def load(name: str):
    """The tokenizer without truncation and padding."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.no_truncation()
    found.no_padding()
    return found


def safe_parts(text: str, size: int = LONG_TEXT) -> list[str]:
    """The text cut before blanks that follow a non-blank, about every ``size`` characters."""
    parts, start = [], 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at > 0 and text[at - 1].isspace():
            at = text.find(" ", at + 1)
        if at < 0:
            break
        parts.append(text[start:at])
        start = at
    return [*parts, text[start:]]


class Lengths(dict):
    """Token counts of pieces that follow a blank."""

    def __init__(self, name: str):
        self.tokenizer = load(name)

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: set[str]) -> None:
        if len(self) + len(pieces) > CACHED_PIECES:
            self.clear()
        new = [p for p in pieces if p not in self]
        for p, n in zip(new, self.encode([" " + p for p in new]), strict=True):
            self[p] = n + UNSAFE * (not p or p[0].isspace())

    def count(self, texts: list[str]) -> list[int]:
        split = [t.split(" ") for t in texts]
        self.learn(set().union(*[s[1:] for s in split]))
        heads = self.encode([s[0] for s in split])
        out = [h + sum(map(self.__getitem__, s[1:])) for h, s in zip(heads, split, strict=True)]
        for i, n in enumerate(out):
            if n >= UNSAFE:
                out[i] = sum(self.encode(safe_parts(texts[i])))
        return out


_held: dict[str, Lengths] = {}


def token_counter(tokenizer: str = TOKENIZER):
    """Column function: text to a struct of n_bytes and n_tokens; null counts as the empty text."""

    def work():
        if tokenizer not in _held:
            _held[tokenizer] = Lengths(tokenizer)
        lengths = _held[tokenizer]
        return lambda texts: ([len(t.encode()) for t in texts], lengths.count(texts))

    return text_function(work, "n_bytes long, n_tokens long")


def count_tokens(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Each row of ``docs`` with n_bytes, n_tokens and over_limit.

    Null and empty texts have 0 bytes and 0 tokens.  Texts of any length are counted whole.  Repeated rows
    stay as they are, an empty table gives an empty one, and columns of these three names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    counted = docs.select(*[F.col(f"`{c}`") for c in kept], token_counter(tokenizer)(F.col(text)).alias("_counted"))
    return counted.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col("_counted.n_bytes").alias("n_bytes"),
        F.col("_counted.n_tokens").alias("n_tokens"),
        over(F.col("_counted.n_tokens"), limit).alias("over_limit"),
    )


def over(tokens: Column, limit: int) -> Column:
    return tokens > limit
