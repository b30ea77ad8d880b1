"""Quality: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage is described by numbers and encoded; gated
attention weighs the encodings, and the weighted sum is scored.  Only documents have labels; which passages decide is
learned with the rest.  Training is plain numpy on a bounded sample, scoring runs over all passages of all texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from timedframe.llm.common import sigmoid
from timedframe.llm.toxicity import sample

PASSAGE_WORDS = 64
TRAIN_DOCS = 1500
THRESHOLD = 0.5
HIDDEN, ATTENTION = 16, 8
CLASSES = ["upper", "lower", "digit", "blank", "line", "mark", "bang", "symbol", "bar", "high"]
FEATURES = [*CLASSES, "word_length", "longest", "distinct", "repeats", "words", "line_repeats"]


def _classes() -> np.ndarray:
    out = np.full(256, CLASSES.index("symbol"), np.uint8)
    for name, letters in (("blank", b" \t\r\x0b\x0c"), ("line", b"\n"), ("mark", b".,;:'\"()-?"), ("bang", b"!"), ("bar", b"|")):
        out[list(letters)] = CLASSES.index(name)
    for name, a, b in (("upper", 65, 91), ("lower", 97, 123), ("digit", 48, 58), ("high", 128, 256)):
        out[a:b] = CLASSES.index(name)
    return out


OF_BYTE = _classes()


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of numbers per passage, and the first passage of each text plus the end.  A text without words is one row of zeros."""
    rows, firsts, parts = [], [0], []
    for t in texts:
        words = t.encode("utf-8", "replace").split(b" ")
        previous: set[bytes] = set()
        for a in range(0, len(words), PASSAGE_WORDS):
            own = words[a : a + PASSAGE_WORDS]
            raw = b" ".join(own)
            real = raw.split()
            n = max(1, len(real))
            distinct = set(real)
            longest = max(map(len, real), default=0)
            pairs = len(set(zip(real, real[1:])))
            rows.append((len(raw) / n / 10, min(longest, 100) / 50, len(distinct) / n, (len(real) - 1 - pairs) / n if real else 0.0, n / PASSAGE_WORDS, len(distinct & previous) / max(1, len(distinct))))
            previous = distinct
            parts.append(raw)
        firsts.append(len(rows))
    raw = np.frombuffer(b"".join(p + b" " for p in parts), np.uint8)
    starts = np.zeros(len(parts), np.int64)
    np.cumsum([len(p) + 1 for p in parts[:-1]], out=starts[1:])
    kinds = OF_BYTE[raw]
    sizes = np.diff(np.append(starts, len(raw))).astype(np.float32)
    shares = np.stack([np.add.reduceat(kinds == c, starts, dtype=np.int32) / sizes for c in range(len(CLASSES))], axis=1)
    return np.concatenate([shares, np.array(rows, np.float32)], axis=1).astype(np.float32), np.array(firsts)


class Model:
    """Encoder tanh(x E + e), attention over w (tanh(h V) * sigmoid(h U)), score sigmoid(z c + b)."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        d = len(FEATURES)
        size = {"E": (d, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "w": (ATTENTION,), "c": (HIDDEN,), "b": ()}
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k in "wc" and s else np.zeros(s)).astype(np.float64) for k, s in size.items()}
        self.mean, self.spread = np.zeros(d, np.float32), np.ones(d, np.float32)

    def forward(self, x: np.ndarray, firsts: np.ndarray) -> dict[str, np.ndarray]:
        p, bag = self.p, np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        a = (v * u) @ p["w"]
        a = np.exp(a - np.maximum.reduceat(a, firsts[:-1])[bag])
        a /= np.add.reduceat(a, firsts[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, firsts[:-1], axis=0)
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "bag": bag, "y": sigmoid(z @ p["c"] + p["b"])}

    def gradient(self, x: np.ndarray, firsts: np.ndarray, error: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the loss whose derivative by the logit of each bag is ``error``."""
        f, p = self.forward(x, firsts), self.p
        h, v, u, a, bag = f["h"], f["v"], f["u"], f["a"], f["bag"]
        dz = error[:, None] * p["c"]
        inner = (h * dz[bag]).sum(1)
        da = a * (inner - np.add.reduceat(a * inner, firsts[:-1])[bag])
        dv = da[:, None] * p["w"] * u * (1 - v * v)
        du = da[:, None] * p["w"] * v * u * (1 - u)
        dh = (a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u * da[:, None]).sum(0), "c": f["z"].T @ error, "b": error.sum()}

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x, firsts = passages(texts)
        return self.forward((x - self.mean) / self.spread, firsts)["y"]


def fit(texts: list[str], labels: np.ndarray, epochs: int = 60, batch: int = 64, seed: int = 3) -> Model:
    """The model from texts and labels 0 and 1; without both labels it gives nearly the same score to every text."""
    model, labels = Model(seed), np.asarray(labels, np.float64)
    if not len(texts) or labels.min() == labels.max():
        model.p["c"][:] = 0
        model.p["b"] = np.array(4.0 if len(texts) and labels[0] else -4.0 if len(texts) else 0.0)
        return model
    x, firsts = passages(texts)
    model.mean, model.spread = x.mean(0), x.std(0) + 0.01
    x = (x - model.mean) / model.spread
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    rng, step = np.random.default_rng(seed), 0
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            rows = np.concatenate([np.arange(firsts[i], firsts[i + 1]) for i in own])
            ends = np.concatenate([[0], np.cumsum(firsts[own + 1] - firsts[own])])
            bag = x[rows]
            error = (model.forward(bag, ends)["y"] - labels[own]) * weight[own] / len(own)
            step += 1
            for k, g in model.gradient(bag, ends, error).items():
                g = g + 1e-4 * model.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.p[k] = model.p[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = TRAIN_DOCS) -> Model:
    return fit(*sample(docs, labels, label, per_label))
