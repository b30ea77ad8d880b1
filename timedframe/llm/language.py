"""Language identification by prediction with partial matching.

Each language has a tree of byte contexts up to ``ORDER`` bytes long.  A byte is coded in the longest context that
was seen in training; if it never followed there, an escape (method C: as likely as the context has distinct
successors) leads to the next shorter context, at last to 256 equally likely bytes.  Statistics are frozen after
training, so the code length of a byte depends on its ``ORDER`` + 1 bytes only and a text's code length is an exact sum
over its n-grams.  The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timedframe.llm.common import joined_bytes, text_function, text_slices

ORDER = 3
UNKNOWN = "und"
#: Training documents per language, taken in the order of a hash of id and text, and the characters that one of them teaches.
TRAIN_DOCS = 600
TRAIN_CHARS = 50_000
BROADCAST_LANGUAGES = 10_000
#: Letters of any script; number signs such as a half are none.
LETTERS = regex.compile(r"\p{L}+")
SLOTS = 20


def folded(text: str) -> str:
    """Lower-case words of letters, one blank before each."""
    words = LETTERS.findall(text.lower())
    return " " + " ".join(words) if words else ""


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One gram per byte (it and the ``ORDER`` bytes before, padded with line ends) and the start of each text."""
    raw, starts = joined_bytes([folded(t) for t in texts], gap=b"\n" * ORDER)
    padded = np.concatenate([np.full(ORDER, 10, np.uint32), raw.astype(np.uint32)])
    out = np.zeros(len(raw), np.uint32)
    for back in range(ORDER + 1):
        out |= padded[ORDER - back : ORDER - back + len(raw)] << np.uint32(8 * back)
    return out, starts


class Tree:
    """Frozen counts of one language: for each context length, sorted contexts with totals and sorted successors with counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels = []
        for k in range(ORDER + 1):
            mask = np.uint32(0xFFFFFFFF if k == 3 else (1 << 8 * (k + 1)) - 1)
            symbols, at = np.unique(keys & mask, return_inverse=True)
            c = np.bincount(at, counts).astype(np.float64)
            contexts, where = np.unique(symbols >> np.uint32(8), return_inverse=True)
            n, d = np.bincount(where, c), np.bincount(where).astype(np.float64)
            self.levels.append((mask, symbols, c, contexts, n, d))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram."""
        out = np.zeros(len(keys))
        todo = np.ones(len(keys), bool)
        for mask, symbols, c, contexts, n, d in reversed(self.levels):
            key = keys & mask
            s = np.minimum(np.searchsorted(symbols, key), len(symbols) - 1)
            x = np.minimum(np.searchsorted(contexts, key >> np.uint32(8)), len(contexts) - 1)
            known = contexts[x] == key >> np.uint32(8)
            hit = symbols[s] == key
            total = n[x] + d[x]
            out += np.where(todo & hit, np.log2(total / c[s]), np.where(todo & known & ~hit, np.log2(total / d[x]), 0.0))
            todo &= ~hit
        return out + 8.0 * todo


class Model:
    """Trees of all languages and a table of the code lengths of every gram that one of them knows."""

    def __init__(self, rows: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(rows)
        self.trees = [Tree(*rows[x]) for x in self.languages]
        self.keys = np.unique(np.concatenate([rows[x][0] for x in self.languages])) if rows else np.zeros(0, np.uint32)
        self.table = self.lengths(self.keys)
        self.slot = np.zeros(1 << SLOTS, np.int32)
        self.slot[self.hash(self.keys)] = np.arange(len(self.keys))

    @staticmethod
    def hash(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761)) >> np.uint32(32 - SLOTS)

    def lengths(self, keys: np.ndarray) -> np.ndarray:
        return np.array([t.bits(keys) for t in self.trees], np.float32).reshape(len(self.trees), len(keys))

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code length of each text (rows) in each language (columns)."""
        keys, starts = grams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        at = self.slot[self.hash(keys)]
        table = self.table
        if len(self.keys) and len(keys):
            wrong = np.flatnonzero(self.keys[at] != keys)  # shares its slot, or no language knows it
            fresh, back = np.unique(keys[wrong], return_inverse=True)
            at = at.astype(np.int64)
            at[wrong] = len(self.keys) + back
            table = np.concatenate([table, self.lengths(fresh)], axis=1)
        # What separates texts is not part of them.
        ends = starts[1:] - ORDER
        for j in range(len(self.languages)):
            sums = np.concatenate([[0.0], np.cumsum(table[j][at], dtype=np.float64)])
            out[:, j] = sums[ends] - sums[starts[:-1]]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The best language and its share of probability; ``und`` and 0 for a text without letters."""
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        bits = self.bits(texts)
        best = bits.argmin(axis=1)
        score = 1.0 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
        letters = [LETTERS.search(t) is not None for t in texts]
        return [self.languages[b] if x else UNKNOWN for b, x in zip(best, letters, strict=True)], [float(s) if x else 0.0 for s, x in zip(score, letters, strict=True)]


def train(labelled: DataFrame, text: str = "text", language: str = "lang", id_column: str = "doc_id", per_language: int = TRAIN_DOCS) -> Model:
    """Trees from up to ``per_language`` documents of each language, chosen by a hash.

    Rows with a null text or language teach nothing, copies of a chosen text count once.  A longer text teaches with a stretch of
    ``TRAIN_CHARS`` characters at a hashed place.  Counting is spread over tasks; the driver holds one row per language and
    the counts of distinct n-grams of the bounded sample.
    """
    place = F.xxhash64(F.col(id_column), F.col(text))
    usable = labelled.select(F.col(language).alias("l"), F.col(text).alias("t"), place.alias("r")).filter(F.col("l").isNotNull() & F.col("t").isNotNull())
    # One count tells below which hash the wanted rows lie, so only about twice as many are ranked, whatever a language's share.
    bounds = [(r.l, -(1 << 63) + (1 << 64) * 2 * per_language // r.n) for r in usable.groupBy("l").agg(F.count("*").alias("n")).collect() if r.n > 2 * per_language]
    if bounds:
        below = labelled.sparkSession.createDataFrame(bounds, "bl string, bound long")
        below = F.broadcast(below) if len(bounds) <= BROADCAST_LANGUAGES else below
        usable = usable.join(below, F.col("l") == F.col("bl"), "left").filter(F.col("bound").isNull() | (F.col("r") < F.col("bound"))).drop("bl", "bound")
    # Only the highest chosen hash of a language is collected.
    ranked = usable.select("l", "r", F.row_number().over(Window.partitionBy("l").orderBy("r")).alias("n")).filter(F.col("n") <= per_language)
    cuts = ranked.groupBy("l").agg(F.max("r").alias("cut")).collect()
    if not cuts:
        return Model({})
    known = labelled.sparkSession.createDataFrame([(c.l, c.cut) for c in cuts], "cl string, cut long")
    # One short row per language, counted here.
    known = F.broadcast(known) if len(cuts) <= BROADCAST_LANGUAGES else known
    sample = usable.join(known, (F.col("l") == F.col("cl")) & (F.col("r") <= F.col("cut")))
    start = F.pmod("r", F.greatest(F.length("t") - TRAIN_CHARS, F.lit(0)) + 1) + 1
    sample = sample.select("l", F.substring("t", start.cast("int"), F.lit(TRAIN_CHARS)).alias("t")).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            at = 0
            for texts in text_slices(batch.column(1)):
                own = names[at : at + len(texts)]
                at += len(texts)
                for name in set(own):
                    keys, starts = grams([t for t, n in zip(texts, own, strict=True) if n == name])
                    inside = np.ones(len(keys), bool)
                    for back in range(1, ORDER + 1):
                        inside[starts[1:] - back] = False
                    found, n = np.unique(keys[inside], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["l", "k", "n"])

    counted = sample.select("l", "t").mapInArrow(count, "l string, k long, n long").groupBy("l", "k").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(counted.column("l").to_pylist(), object)
    keys, counts = counted.column("k").to_numpy().astype(np.uint32), counted.column("n").to_numpy()
    return Model({x: (keys[names == x], counts[names == x]) for x in sorted(set(names))})


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Each row of ``docs`` with lang_pred and score.

    Null, empty and letterless texts are ``und`` with score 0.  Whole texts are read, ties go to the first
    language by name, repeated rows stay, columns of the two names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    predict = text_function(lambda: held.value.predict, "lang_pred string, score double")
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*[F.col(f"`{c}`") for c in kept], predict(F.col(text)).alias("_p")).select(*[F.col(f"`{c}`") for c in kept], "_p.lang_pred", "_p.score")
