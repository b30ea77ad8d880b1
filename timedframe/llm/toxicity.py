"""Toxicity: a linear classifier of byte n-grams, regularised by counterfactuals.

Training takes a bounded sample of labelled documents.  Besides the usual loss, every sentence that names a group
of people is paired with itself after the name is swapped for another of its kind, and the squared difference of the
two scores is added to the loss.  So a name as such cannot carry weight, which keeps neutral mentions neutral.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timedframe.llm.common import joined_bytes, sigmoid, text_function
from timedframe.llm.jaccard import shingles

#: Interchangeable names; a parameter of ``train``.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "citizens", "refugees", "foreigners"),
    ("old", "young"),
    ("disabled", "blind", "deaf"),
)
#: Training documents of each label, and the largest size of one.
TRAIN_DOCS = 2000
TRAIN_CHARS = 20_000
GRAM = 6
FEATURES = 1500
#: A feature must stand out: chi-square of its documents by label.
MIN_CHI_SQUARE = 30.0
SWAP_WEIGHT = 10.0
MAX_SWAPS = 20_000
THRESHOLD = 0.7
BITS = 22
#: Letters stay, in lower case; all other ASCII characters separate words.
FOLD = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256)).lower()
DRAWS = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 10)]
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ``GRAM`` bytes around each start as one number, first those after the blank before a text, and the start of each text."""
    raw, starts = joined_bytes(texts, gap=b" " * (GRAM + 1))
    raw = np.frombuffer((b" " + raw.tobytes() + b" " * GRAM).translate(FOLD), np.uint8).astype(np.uint64)
    out = np.zeros(len(raw) - GRAM, np.uint64)
    for k in range(GRAM):
        out = (out << np.uint64(8)) | raw[k : k + len(out)]
    return out, starts


def slot(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


class Features:
    """A set of n-grams that can be found in many bytes at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of each feature that a text has, once."""
        found, starts = grams(texts)
        mark = np.zeros(1 << BITS, bool)
        mark[slot(self.keys)] = True
        at = np.flatnonzero(mark[slot(found)])
        if not len(self.keys) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, found[at]), len(self.keys) - 1)
        right = self.keys[k] == found[at]
        at, k = at[right], k[right]
        row = np.searchsorted(starts, at, side="right") - 1
        inside = at <= starts[row + 1] - GRAM - 1  # grams that start further on reach into the next text
        pair = np.unique(row[inside] * len(self.keys) + k[inside])
        return pair // len(self.keys), pair % len(self.keys)

    def matrix(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.keys)), np.float32)
        r, c = self.find(texts)
        out[r, c] = 1
        return out


class Model:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.features, self.weights, self.bias = Features(keys), weights[order], float(bias)

    def score(self, texts: list[str]) -> np.ndarray:
        rows, columns = self.features.find(texts)
        return sigmoid(self.bias + np.bincount(rows, self.weights[columns] if len(columns) else None, minlength=len(texts)))


def unlike(texts: list[str]) -> list[int]:
    """Positions of texts of which no near copy came before, so that the copies of one text don't pass for evidence.

    Two texts count as near copies if three least hashes of their word shingles agree, in one of three drawings.
    """
    seen: set[tuple[int, ...]] = set()
    out = []
    for i, found in enumerate(shingles(texts)):
        if not len(found):
            continue
        least = [int(((found ^ (found >> np.uint64(29))) * np.uint64(m)).min()) for m in DRAWS]
        marks = {(k, *least[k : k + 3]) for k in (0, 3, 6)}
        if not marks & seen:
            out.append(i)
        seen |= marks
    return out


def swaps(texts: list[str], terms=IDENTITY_TERMS, limit: int = MAX_SWAPS) -> list[tuple[str, str]]:
    """Sentences that name a group, each with the names swapped for the next of their kind."""
    after = {t: g[(i + 1) % len(g)] for g in terms for i, t in enumerate(g)}
    out: list[tuple[str, str]] = []
    for t in texts:
        if after.keys().isdisjoint(w.lower() for w in WORD.findall(t)):
            continue
        for s in SENTENCE.findall(t):
            other = WORD.sub(lambda m: after.get(m[0].lower(), m[0]), s)
            if other != s:
                out.append((s, other))
                if len(out) >= limit:
                    return out
    return out


def fit(texts: list[str], labels: np.ndarray, terms=IDENTITY_TERMS, swap_weight: float = SWAP_WEIGHT, steps: int = 200) -> Model:
    """The classifier from texts and labels 0 and 1; without both labels it gives every text the same score.

    Only n-grams that toxic documents have more often are used, with weights of at least 0: length and harmless words are no excuse.
    """
    labels = np.asarray(labels, np.float32)
    kept = unlike(texts)
    texts, labels = [texts[i] for i in kept], labels[kept]
    positive, negative = float(labels.sum()), float(len(labels) - labels.sum())
    if not positive or not negative:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 4.0 if positive else -4.0)
    # Documents of each label that have an n-gram.
    sets = [np.unique(grams([t])[0]) for t in texts]
    keys, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(labels, [len(s) for s in sets])
    have, toxic = np.bincount(at), np.bincount(at, owner)
    del sets, at, owner
    total = positive + negative
    difference = toxic * negative - (have - toxic) * positive
    chi = total * difference**2 / (positive * negative * have * np.maximum(total - have, 1e-9))
    strong = np.flatnonzero((chi >= MIN_CHI_SQUARE) & (have >= 3) & (difference > 0))
    chosen = strong[np.argsort(-chi[strong], kind="stable")[:FEATURES]]
    features = Features(keys[chosen])
    x = features.matrix(texts)
    pairs = swaps(texts, terms)
    delta = features.matrix([a for a, _ in pairs]) - features.matrix([b for _, b in pairs]) if pairs else None
    weight = np.where(labels == 1, total / (2 * positive), total / (2 * negative)).astype(np.float32) / total
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        error = ((sigmoid(x @ w + b) - labels) * weight).astype(np.float32)
        grad = error @ x + 1e-5 * w
        if delta is not None:
            grad = grad + swap_weight * 2 / len(delta) * (delta.T @ (delta @ w))
        both = np.append(grad, error.sum())
        first, second = 0.9 * first + 0.1 * both, 0.999 * second + 0.001 * both**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0).astype(np.float32), np.float32(b - move[-1])
    return Model(features.keys, w, b)


def sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int, id_column: str = "doc_id", text: str = "text", largest: int = TRAIN_CHARS) -> tuple[list[str], np.ndarray]:
    """Up to ``per_label`` texts of each label, chosen by a hash of the id, of at most ``largest`` characters; for the driver.

    Ids are chosen from ``labels`` first (a top-n that each task cuts); only their texts are fetched.  An id labelled twice
    counts once, with its larger label; null ids, labels and texts teach nothing.
    """
    marked = labels.filter(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    order = [F.xxhash64("_id"), F.col("_id")]
    # Twice as many ids as texts, as some texts may be missing or too long.
    picked = None
    for y in (0, 1):
        part = marked.filter(F.col("_y") == y).orderBy(*order).limit(2 * per_label)
        picked = part if picked is None else picked.unionByName(part)
    # At most 4 * per_label rows of two numbers, whatever the size of the tables.
    picked = F.broadcast(picked)
    texts = docs.select(F.col(id_column).alias("_doc"), F.col(text).alias("_t")).filter(F.length("_t") <= largest)
    found = texts.join(picked, F.col("_doc") == F.col("_id")).groupBy("_id").agg(F.max("_y").alias("_y"), F.min("_t").alias("_t"))
    rows = None
    for y in (0, 1):
        part = found.filter(F.col("_y") == y).orderBy(*order).limit(per_label)
        rows = part if rows is None else rows.unionByName(part)
    table = rows.select("_y", "_t").toArrow()
    return table.column("_t").to_pylist(), table.column("_y").to_numpy().astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = TRAIN_DOCS, terms=IDENTITY_TERMS) -> Model:
    return fit(*sample(docs, labels, label, per_label), terms=terms)


def score_texts(docs: DataFrame, model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Each row of ``docs`` with ``score`` and ``predicted``, from a model with ``score(texts)``.

    Null and empty texts get the score of no evidence.  Whole texts are scored, repeated rows each by themselves;
    an empty table gives an empty one; columns of the two names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    score = text_function(lambda: lambda texts: (np.asarray(held.value.score(texts), np.float64),), "score double")
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], score(F.col(text)).alias("_s"))
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col("_s.score").alias("score"), (F.col("_s.score") >= threshold).cast("int").alias("predicted"))
