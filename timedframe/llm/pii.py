"""Personal data: patterns for plain forms, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans: those that the patterns find in a bounded sample of documents, and
the same spans rewritten to forms that no pattern covers (``VARIANTS``).  Texts are read in overlapping windows.
A span of the network must hold a digit, an ``@`` or a spelled-out one, so windows without any of these cannot yield
one and are computed only where a span goes on in them; the result is the same.  Spans of all windows of a text are reconciled together:
pieces of a span that crosses windows are joined, whatever its length, an address whose ends no window shows is completed, of overlapping spans the surest stays, and none may touch a pattern's span.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timedframe.llm.common import text_function

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 128, 64
#: Characters after a window's start where the window before knows better whether a span begins.
EDGE = 8
HIDDEN = 16
#: Documents that are labelled for training, their largest size, and windows taken from them.
TRAIN_DOCS = 1500
TRAIN_CHARS = 20_000
TRAIN_WINDOWS = 2400
EPOCHS = 6
#: Mean probability of a span's tags under the CRF.
SURE = 0.9
TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
DIGIT = re.compile(r"[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Quantifiers that give nothing back: within a run of digits no later start or shorter run can match.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _significant(digits: str) -> str:
    return digits.lstrip("0")


def emails(text: str) -> list[Span]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if at >= end and (m := DOMAIN.match(text, at + 1)):
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                out.append(("email", start, end))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind and then start; failing matches are dropped."""
    out = emails(text)
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in map(_significant, m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def letters(text: str) -> np.ndarray:
    """Class of each character: ASCII with digits and letter case merged, other letters, the rest."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return TABLE[np.minimum(codes, 0x24F)]


def _table() -> np.ndarray:
    out = np.zeros(0x250, np.int64)
    for c in range(0x250):
        s = chr(c)
        out[c] = ord("0") if "0" <= s <= "9" else ord(s.lower()) if c < 128 else 128 if s.isalpha() else 129
    out[0x24F] = 128
    return out


TABLE = _table()
CLASSES = 131  # the last one fills windows at a text's end
TAGS = 1 + 2 * len(KINDS)  # outside, then first and inner of each kind


def allowed() -> np.ndarray:
    """Which tag may follow which: an inner tag only its kind's first or inner one."""
    out = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = False
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return out


ALLOWED = allowed()


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Model:
    """Two LSTMs over a window, a linear layer on both states, CRF transitions between tags."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (CLASSES, 4 * h))
            self.p["h" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            self.p["x" + d][:, h : 2 * h] += 1.0  # remember by default
        self.p["o"] = rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, TAGS))
        self.p["ob"] = np.zeros(TAGS)
        self.p["t"] = np.zeros((TAGS, TAGS))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def lstm(self, d: str, c: np.ndarray) -> tuple[np.ndarray, list]:
        """States after each character, in reading order of ``d``; what the gradient needs."""
        n, t = c.shape
        h = HIDDEN
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, kept = np.zeros((t, n, h), np.float32), []
        wx, wh = self.p["x" + d], self.p["h" + d]
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            g = wx[c[:, i]] + state @ wh
            gates = 1 / (1 + np.exp(-np.clip(g[:, : 3 * h], -30, 30)))
            new = np.tanh(g[:, 3 * h :])
            before, was = state, cell
            cell = gates[:, h : 2 * h] * was + gates[:, :h] * new
            squashed = np.tanh(cell)
            state = gates[:, 2 * h :] * squashed
            out[i] = state
            kept.append((i, gates, new, was, squashed, before))
        return out, kept

    def lstm_gradient(self, d: str, c: np.ndarray, kept: list, dout: np.ndarray, into: dict[str, np.ndarray]) -> None:
        h, wh = HIDDEN, self.p["h" + d]
        dstate, dcell = np.zeros((len(c), h), np.float32), np.zeros((len(c), h), np.float32)
        for i, gates, new, was, squashed, before in reversed(kept):
            dh = dout[i] + dstate
            dc = dcell + dh * gates[:, 2 * h :] * (1 - squashed**2)
            dgates = np.concatenate([dc * new, dc * was, dh * squashed], axis=1) * gates * (1 - gates)
            dg = np.concatenate([dgates, dc * gates[:, :h] * (1 - new**2)], axis=1)
            np.add.at(into["x" + d], c[:, i], dg)
            into["h" + d] += before.T @ dg
            dstate, dcell = dg @ wh.T, dc * gates[:, h : 2 * h]

    def moves(self) -> np.ndarray:
        return np.where(ALLOWED, self.p["t"], -1e4)

    def emissions(self, c: np.ndarray):
        f, kept_f = self.lstm("f", c)
        b, kept_b = self.lstm("b", c)
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["o"] + self.p["ob"], both, kept_f, kept_b

    def forward_backward(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log weights of all paths up to and after each tag, and of all paths."""
        m, t = self.moves(), len(e)
        a, b = np.zeros(e.shape), np.zeros(e.shape)
        a[0] = e[0]  # a window may begin within a span
        for i in range(1, t):
            a[i] = log_sum(a[i - 1][:, :, None] + m, 1) + e[i]
        for i in range(t - 2, -1, -1):
            b[i] = log_sum(m + (e[i + 1] + b[i + 1])[:, None, :], 2)
        return a, b, log_sum(a[-1], 1)

    def gradient(self, c: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        e, both, kept_f, kept_b = self.emissions(c)
        a, b, z = self.forward_backward(e)
        n, t = c.shape
        into = {k: np.zeros_like(v) for k, v in self.p.items()}
        de = np.exp(a + b - z[None, :, None])
        m = self.moves()
        for i in range(1, t):
            pair = np.exp(a[i - 1][:, :, None] + m + (e[i] + b[i])[:, None, :] - z[:, None, None])
            into["t"] += pair.sum(0).astype(np.float32)
            np.add.at(into["t"], (tags[:, i - 1], tags[:, i]), -1)
        de[np.arange(t)[:, None], np.arange(n)[None, :], tags.T] -= 1
        de = de.astype(np.float32)
        into["o"] = np.einsum("tnh,tnk->hk", both, de)
        into["ob"] = de.sum((0, 1))
        dboth = de @ self.p["o"].T
        self.lstm_gradient("f", c, kept_f, dboth[:, :, :HIDDEN], into)
        self.lstm_gradient("b", c, kept_b, dboth[:, :, HIDDEN:], into)
        return {k: v / n for k, v in into.items()}

    def decode(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window and the probability of each tag on that path."""
        e = self.emissions(c)[0]
        a, b, z = self.forward_backward(e)
        m, t = self.moves(), len(e)
        best, back = a[0], []
        for i in range(1, t):
            step = best[:, :, None] + m
            back.append(step.argmax(1))
            best = step.max(1) + e[i]
        tags = np.zeros(c.shape, np.int64)
        tags[:, -1] = best.argmax(1)
        rows = np.arange(len(c))
        for i in range(t - 2, -1, -1):
            tags[:, i] = back[i][rows, tags[:, i + 1]]
        share = np.exp(a + b - z[None, :, None])
        return tags, share[np.arange(t)[:, None], rows[None, :], tags.T].T


def windows(text: str) -> list[int]:
    """Starts of the windows of the grid over the text that hold a trigger."""
    last = max(0, (len(text) - 1) // STRIDE)
    held = {k for m in TRIGGER.finditer(text) for k in (m.start() // STRIDE - 1, m.start() // STRIDE) if 0 <= k <= last}
    return [k * STRIDE for k in sorted(held)]


def window_classes(classes: np.ndarray, start: int) -> np.ndarray:
    out = np.full(WINDOW, CLASSES - 1, np.int64)
    own = classes[start : start + WINDOW]
    out[: len(own)] = own
    return out


def spans_of(tags: np.ndarray, share: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, mean probability) of each span in one window's tags; the first may have begun before the window."""
    out = []
    begins = (tags % 2 == 1) | ((np.arange(len(tags)) == 0) & (tags > 0))
    for i in np.flatnonzero(begins):
        kind, end = int(tags[i] - 1) // 2, i + 1
        while end < len(tags) and tags[end] == 2 + 2 * kind:
            end += 1
        out.append((kind, int(i), int(end), float(share[i:end].mean())))
    return out


Piece = tuple[int, int, int, float, bool, bool]


def joined(pieces: dict[int, list[tuple[int, int, int, float]]], length: int) -> list[Piece]:
    """The spans of one text from the pieces in its windows, by window start: (kind, start, end, probability, open before, open after).

    A piece that ends with its window goes on in the next one, which begins within it; so a span of any length is put together from
    as many windows as it crosses.  Its probability is the mean over its pieces' characters.  It is open where the neighbour disagrees.
    """
    out: list[Piece] = []
    going, before = None, None

    def end(kind: int, a: int, total: float, n: int, early: bool, b: int, late: bool) -> None:
        out.append((kind, a, b, round(total / n, 6), early, late))

    for s in sorted(pieces):
        chain, going = going, None
        for kind, a, b, sure in pieces[s]:
            held = (kind, a, sure * (b - a), b - a, a == s and s > 0)
            if a < s + EDGE and chain is not None and s == before + STRIDE and chain[0] == kind:
                held, chain = (kind, chain[1], chain[2] + held[2], chain[3] + held[3], chain[4]), None
            if b == s + WINDOW and b < length:
                going = held
            elif b <= length:
                end(*held, b, False)
        if chain is not None:
            end(*chain, before + WINDOW, True)
        before = s
    if going is not None:
        end(*going, before + WINDOW, True)
    return out


NAME, HOST = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"[A-Za-z0-9.-]*[A-Za-z0-9-]")


def completed(text: str, found: list[Piece]) -> list[tuple[int, int, int, float]]:
    """An open end of an address is where its run of characters ends, as names and hosts may be longer than what a window shows; others that are open go."""
    out, last = [], (0, -1)
    for kind, a, b, sure, early, late in sorted(found):
        if (early or late) and KINDS[kind] != "email":
            continue
        if early and a:
            if not last[0] <= a <= last[1]:  # one walk for all pieces of a run
                start = a
                while start and text[start - 1] in LOCAL:
                    start -= 1
                last = (start, m.end() if (m := NAME.match(text, a)) else a)
            a = last[0]
        if late and (m := HOST.match(text, b)):
            b = m.end()
        out.append((kind, a, b, sure))
    return out


def plausible(kind: str, found: str) -> bool:
    """Forms that a span of the network must have."""
    digits = len(DIGIT.findall(found))
    if not TRIGGER.search(found) or found != found.strip():
        return False
    if kind == "email":
        return "." in found and bool(re.fullmatch(r"\S+ ?[(\[]at[)\]] ?\S+|[^\s@]+ ?@ ?[^\s@]+", found))
    if not re.fullmatch(r"[0-9+(][\x20().0-9-]*[0-9]", found):
        return False
    if kind == "ip":
        return digits >= 4 and found.count(".") == 3
    return 13 <= digits <= 19 if kind == "card" else 10 <= digits <= 15


def reconcile(text: str, found: list[tuple[int, int, int, float]], base: list[Span]) -> list[Span]:
    """Of all windows' spans those that are sure, plausible, and clear of patterns' spans and of surer ones."""
    kept: list[Span] = []
    taken = [(a, b) for _, a, b in base]
    for kind, a, b, share in sorted(set(found), key=lambda s: (-s[3], s[1], -s[2])):
        if share >= SURE and plausible(KINDS[kind], text[a:b]) and all(b <= x or y <= a for x, y in taken):
            if DIGIT.match(text, b) or (a and DIGIT.match(text, a - 1)):
                continue  # a part of a longer number
            kept.append((KINDS[kind], a, b))
            taken.append((a, b))
    return kept


def find(texts: list[str], model: Model | None, chunk: int = 256) -> tuple[list[list[Span]], list[list[Span]]]:
    """The patterns' spans and the network's of each text."""
    base = [base_spans(t) for t in texts]
    if model is None:
        return base, [[] for _ in texts]
    pieces: list[dict[int, list[tuple[int, int, int, float]]]] = [{} for _ in texts]
    places = [(i, s) for i, t in enumerate(texts) for s in windows(t)]
    held = (-1, None)
    while places:
        cut = set()
        for a in range(0, len(places), chunk):
            batch = []
            for i, s in places[a : a + chunk]:
                if held[0] != i:
                    held = (i, letters(texts[i]))
                batch.append(window_classes(held[1], s))
            tags, share = model.decode(np.array(batch))
            for (i, s), own, p in zip(places[a : a + chunk], tags, share, strict=True):
                pieces[i][s] = [(kind, s + x, s + y, sure) for kind, x, y, sure in spans_of(own, p)]
                # What is cut goes on in a neighbour, whether that holds a trigger or not.
                cut |= {(i, s - STRIDE) for _, x, _, _ in pieces[i][s] if x < s + EDGE and s > 0}
                cut |= {(i, s + STRIDE) for _, _, y, _ in pieces[i][s] if y == s + WINDOW and y < len(texts[i])}
        places = sorted((i, s) for i, s in cut if s not in pieces[i])
    raw = [completed(t, joined(p, len(t))) for p, t in zip(pieces, texts, strict=True)]
    return base, [reconcile(t, r, b) if r else [] for t, r, b in zip(texts, raw, base, strict=True)]


def _long(times: int):
    """A spelled-out address whose name and host are repeated."""
    return lambda s: "-".join([s.split("@", 1)[0]] * times) + " (at) " + ".".join([s.split("@", 1)[1]] * times)


#: Rewritings of a labelled span to a form that its pattern doesn't cover.
VARIANTS = {
    "email": (lambda s: s.replace("@", " (at) "), lambda s: s.replace("@", "[at]"), lambda s: s.replace("@", " @ "), _long(3), _long(8)),
    "ip": (lambda s: s.replace(".", " . "), lambda s: s.replace(".", "(.)")),
    "card": (lambda s: ".".join(re.findall("[0-9]{1,4}", re.sub("[^0-9]", "", s))),),
    "phone": (lambda s: s.split(" ", 1)[-1], lambda s: s.split(" ", 1)[-1].replace("(", "").replace(") ", "-")),
}


def examples(texts: list[str], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows of labelled texts, some with a span rewritten: classes and tags."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for text in texts:
        base = base_spans(text)
        for rewrite in (False, True):
            now, labels, shift = text, [], 0
            if rewrite:
                if not any(k in VARIANTS for k, _, _ in base):
                    continue
                free = [s for s in sorted(base, key=lambda s: s[1])]
                if any(b > c for (_, _, b), (_, c, _) in zip(free, free[1:])):
                    continue
                for kind, a, b in free:
                    forms = VARIANTS.get(kind, (lambda s: s,))
                    new = forms[rng.integers(len(forms))](text[a:b])
                    now = now[: a + shift] + new + now[b + shift :]
                    labels.append((kind, a + shift, a + shift + len(new)))
                    shift += len(new) - (b - a)
            else:
                labels = base
            tags = np.zeros(len(now) + WINDOW, np.int64)
            for kind, a, b in labels:
                k = KINDS.index(kind)
                tags[a:b] = 2 + 2 * k
                tags[a] = 1 + 2 * k
            classes = letters(now)
            for s in windows(now):
                own = tags[s : s + WINDOW]
                xs.append(window_classes(classes, s))
                ys.append(own)
    order = rng.permutation(len(xs))[:TRAIN_WINDOWS]
    return np.array(xs, np.int64).reshape(-1, WINDOW)[order], np.array(ys, np.int64).reshape(-1, WINDOW)[order]


def fit(texts: list[str], epochs: int = EPOCHS, batch: int = 32, seed: int = 5) -> Model | None:
    """The network from labelled texts; None if they hold no window to learn from."""
    x, y = examples(sorted(texts))
    if not len(x):
        return None
    model, rng, step = Model(seed), np.random.default_rng(seed), 0
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(order), batch):
            own, step = order[a : a + batch], step + 1
            rate = 0.02 * (1 - epoch / epochs) + 0.002
            for k, g in model.gradient(x[own], y[own]).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.p[k] = model.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, text: str = "text", id_column: str = "doc_id", limit: int = TRAIN_DOCS) -> Model | None:
    """From up to ``limit`` documents with a digit or an @, of at most ``TRAIN_CHARS`` characters, chosen by a hash."""
    usable = docs.select(F.col(text).alias("t"), F.xxhash64(F.col(id_column), F.col(text)).alias("r")).filter((F.length("t") <= TRAIN_CHARS) & F.col("t").rlike("[0-9@]"))
    cut = usable.select("r").orderBy("r").limit(limit).agg(F.max("r")).first()[0]
    if cut is None:
        return None
    return fit([r.t for r in usable.filter(F.col("r") <= cut).select("t").distinct().orderBy(F.xxhash64("t")).limit(limit).collect()])


def detect(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Each row of ``docs`` with n_email, n_ip, n_card, n_phone and base_sha256 of the patterns' spans, and ``spans`` of all.

    Null and empty texts have none.  Whole texts are read; repeated rows stay; an empty table gives an empty one;
    columns of these names are replaced.
    """
    added = [*[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        def apply(texts):
            base, more = find(texts, held.value)
            counts = [[sum(s[0] == k for s in b) for b in base] for k in KINDS]
            return [*counts, [hashlib.sha256(as_text(b).encode()).hexdigest() for b in base], [as_text(b + m) for b, m in zip(base, more, strict=True)]]

        return apply

    found = text_function(work, ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    return docs.select(*kept, found(F.col(text)).alias("_p")).select(*kept, "_p.*")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every run of overlapping spans replaced by its first kind in angle brackets."""
    out, end = [], 0
    held: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if held and a < held[-1][2]:
            held[-1][2] = max(held[-1][2], b)
        else:
            held.append([kind, a, b])
    for kind, a, b in held:
        out += [text[end:a], f"<{kind}>"]
        end = b
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with all spans replaced in ``text``; null stays null."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        def apply(texts):
            base, more = find(texts, held.value)
            return ([redacted(t, b + m) for t, b, m in zip(texts, base, more, strict=True)],)

        return apply

    clean = text_function(work, "text string")
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), clean(F.col(text))["text"]))


