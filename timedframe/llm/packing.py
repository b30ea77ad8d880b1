"""Hierarchical multi-length packing.

A document longer than the largest window gives full windows; what remains is routed to the smallest tier
(context size) that holds it.  Each tier is packed from its own documents, longest first.  The gap that a
window of a longer tier is left with is filled from shorter tiers, cutting the document that would overshoot;
its rest goes on as a shorter document.  So windows are full, and only what is left when a task ends is padded
to the largest window.  A step group takes windows of one tier, the more the shorter they are, so that every full
group has the same number of tokens.

A task packs the documents of its own partition in buffers of bounded size: nothing is shuffled, the ids are made
once, and a lost task repeats the same windows from the same rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from timedframe.llm.common import text_slices
from timedframe.llm.token_counts import load

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
TIERS = (512, 1024, 2048, 4096)
#: Tokens that a task collects before it packs them, and tokens of a step group.
BUFFER_TOKENS = 1 << 21
STEP_TOKENS = 1 << 16
CACHED_WORDS = 1_000_000
#: ASCII marks, and the letters whose case and composition fold one at a time.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LATIN = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Ids(dict):
    """Ids of words as little-endian 32-bit bytes; the pattern drops white space, so words between blanks are independent.

    A word of Latin letters with marks after it is two words for the pattern, and letter case is folded; so letters and
    marks are looked up by themselves in ``parts``.  Plain words are encoded many at a time in one text.
    """

    def __init__(self, name: str):
        self.tokenizer = load(name)
        self.parts: dict[str, bytes] = {}

    def encode_each(self, words: list[str], into: dict[str, bytes]) -> None:
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                into[w] = np.asarray(e.ids, "<u4").tobytes()

    def encode_plain(self, words: list[str], size: int = 1000) -> None:
        """Words of letters only, each of which is one word for the pattern."""
        for a in range(0, len(words), size):
            part = words[a : a + size]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            cuts = (4 * (np.flatnonzero(np.diff(found.word_ids)) + 1)).tolist()
            raw = np.asarray(found.ids, "<u4").tobytes()
            if len(cuts) + 1 != len(part):
                self.encode_each(part, self.parts)
                continue
            self.parts.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts], [*cuts, len(raw)])), strict=True))

    def learn(self, words: set[str]) -> None:
        if len(self) + len(words) > CACHED_WORDS:
            self.clear()
        if len(self.parts) + 2 * len(words) > CACHED_WORDS:
            self.parts.clear()
        plain, letters, marks, other = [], [], [], []
        for w in words:
            a = w.rstrip(MARKS)
            if a.isalpha() and (a.isascii() or LATIN.fullmatch(a)):
                plain.append(w)
                letters.append(a.lower())
                marks.append(w[len(a) :])
            else:
                other.append(w)
        self.encode_each(other, self)
        self.encode_plain(list(set(letters).difference(self.parts)))
        self.encode_each(list(set(marks).difference(self.parts)), self.parts)
        parts = self.parts
        for w, a, b in zip(plain, letters, marks, strict=True):
            self[w] = parts[a] + parts[b]

    def texts(self, texts: list[str], end: int) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        found = [list(map(self.get, s)) for s in split]
        unknown: set[str] = set()
        for s, f in zip(split, found, strict=True):
            if None in f:
                unknown.update([w for w, b in zip(s, f, strict=True) if b is None])
        if unknown:
            self.learn(unknown)
            found = [[self[w] if b is None else b for w, b in zip(s, f, strict=True)] if None in f else f for s, f in zip(split, found, strict=True)]
        last = np.asarray([end], "<u4").tobytes()
        return [b"".join(f) + last for f in found]


_held: dict[str, Ids] = {}


class Packer:
    """Packs (row, start, length) pieces into windows; keeps what doesn't fill one for the next buffer."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.largest = tuple(sorted(tiers)), max(tiers)
        if any(t & (t - 1) for t in self.tiers):
            raise ValueError("tiers are powers of two, so that full windows need no padding")
        self.open: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}

    def route(self, length: int) -> int:
        return next(t for t in self.tiers if length <= t)

    def add(self, row: int, length: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Full windows of a long document at once; its rest waits in its tier."""
        start = 0
        while length - start >= self.largest:
            yield self.largest, [(row, start, self.largest)]
            start += self.largest
        if length > start:
            self.open[self.route(length - start)].append((row, start, length - start))

    def pack(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Windows of the waiting pieces, longest tier first; a window that cannot be filled goes back."""
        for waiting in self.open.values():
            waiting.sort(key=lambda p: (p[2], p[0], p[1]))
        for tier in reversed(self.tiers):
            below = [t for t in reversed(self.tiers) if t <= tier]
            while self.open[tier]:
                window, gap = [], tier
                while gap:
                    source = next((t for t in below if self.open[t] and (t <= gap or not window)), None)
                    source = source or next((t for t in reversed(below) if self.open[t]), None)
                    if source is None:
                        break
                    row, start, length = self.open[source].pop()
                    taken = min(length, gap)
                    window.append((row, start, taken))
                    gap -= taken
                    if length > taken:
                        rest = self.open[self.route(length - taken)]
                        rest.append((row, start + taken, length - taken))
                if gap:
                    for row, start, length in window:
                        self.open[self.route(length)].append((row, start, length))
                    break
                yield tier, window

    def finish(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """What is left: less than two windows of each tier, poured into windows of the largest size."""
        yield from self.pack()
        rest = [p for t in reversed(self.tiers) for p in self.open[t]]
        self.open = {t: [] for t in self.tiers}
        window, gap = [], self.largest
        while rest:
            row, start, length = rest.pop(0)
            taken = min(length, gap)
            window.append((row, start, taken))
            gap -= taken
            if length > taken:
                rest.insert(0, (row, start + taken, length - taken))
            if not gap:
                yield self.largest, window
                window, gap = [], self.largest
        if window:
            yield self.largest, window


def pack_documents(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS
) -> DataFrame:
    """One row per piece: the id, the piece's place in its document and in its window, tier and step group.

    A null or empty text is the end id alone.  Repeated rows and null ids are packed like any other row, each by
    itself.  Texts of any length are packed whole.  An empty table gives no pieces.  Other columns are not read.
    A window holds a power of two of tokens, or it is padded to the largest tier.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _held.get(tokenizer) or _held.setdefault(tokenizer, Ids(tokenizer))
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        packer, number, dealt = Packer(tiers), 0, dict.fromkeys(tiers, 0)
        order = {t: i for i, t in enumerate(sorted(tiers))}
        names: dict[int, object] = {}
        held: dict[int, tuple[bytes, int]] = {}
        left: dict[int, int] = {}
        rows, waiting = 0, 0
        id_type = None

        def emit(windows) -> pa.RecordBatch | None:
            nonlocal number
            out: list[tuple] = []
            for tier, window in windows:
                offset, group = 0, part | order[tier] << 30 | dealt[tier] * tier // STEP_TOKENS
                for row, start, length in window:
                    raw, total = held[row]
                    out.append((names[row], start, length, zlib.crc32(memoryview(raw)[4 * start : 4 * (start + length)]), total, part | number, offset, tier, group))
                    offset += length
                    left[row] -= length
                    if not left[row]:
                        del held[row], names[row], left[row]
                number += 1
                dealt[tier] += 1
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(9)]
            types = [id_type, *[pa.int64()] * 6, pa.int32(), pa.int64()]
            schema = pa.schema([(n, t) for n, t in zip([id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"], types, strict=True)])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema=schema)

        for batch in batches:
            id_type = batch.schema.field(0).type
            keys, at = batch.column(0).to_pylist(), 0
            for texts in text_slices(batch.column(1)):
                windows = []
                for raw in ids.texts(texts, end_id):
                    names[rows], held[rows], left[rows] = keys[at], (raw, len(raw) // 4), len(raw) // 4
                    windows.extend(packer.add(rows, len(raw) // 4))
                    waiting += len(raw) // 4 % packer.largest
                    rows, at = rows + 1, at + 1
                if waiting > BUFFER_TOKENS:
                    windows.extend(packer.pack())
                    waiting = 0
                yield emit(windows)
        if id_type is not None:
            yield emit(packer.finish())

    chosen = docs.select(docs[id_column], docs[text].cast("string"))
    return chosen.mapInArrow(run, f"`{id_column}` {kind}, {COLUMNS}")
