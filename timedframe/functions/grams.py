"""Grams of texts that may begin a match of some term: a Bloom filter over the terms' anchors, applied to Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Characters of the longest gram; longer terms are looked up by one gram of this size.
GRAM = 16
#: The filter has 64 bits a term, up to 2^28 bits (32 MB); beyond that it lets more through, which the join then drops.
BITS_PER_TERM = 64
MOST_BITS = 28
FLUSH_ROWS = 20_000
BASE = 0x9E3779B97F4A7C15
STIR = np.uint64(0xD6E8FEB86659FD93)
POWERS = {n: np.uint64(pow(BASE, n, 1 << 64)) for n in (1, 2, 4, 8, 16)}


def kind_of(size: Column) -> Column:
    """Class of a term by its length: the length itself up to ``GRAM``, beyond that one class for each doubling."""
    return F.when(size <= GRAM, size).otherwise(F.length(F.bin(size.cast("bigint"))) + GRAM - 4)


def gram_size(kind: int) -> int:
    return min(kind, GRAM)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def hashes(chars: np.ndarray, sizes: set[int]) -> dict[int, np.ndarray]:
    """For each size the hash of the gram that starts at each character: a polynomial, put together from sizes that are powers of two."""
    doubled, h, width = [], chars + np.uint64(1), 1
    while len(h) and width <= max(sizes):
        doubled.append((width, h))
        h = h[: max(0, len(h) - width)] * POWERS[width] + h[width:]
        width *= 2
    out = {}
    for size in sizes:
        if size > len(chars):
            continue
        at, whole = 0, np.zeros(len(chars) - size + 1, np.uint64)
        for width, h in doubled:
            if size & width:
                whole = whole * POWERS[width] + h[at : at + len(whole)]
                at += width
        out[size] = whole
    return out


def stirred(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * STIR + np.uint64(kind * BASE % (1 << 64))
    h = (h ^ (h >> np.uint64(29))) * STIR
    return h ^ (h >> np.uint64(32))


def spots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of the filter for each hash."""
    mask = np.uint64((1 << bits) - 1)
    return [(h >> np.uint64(s)) & mask for s in (0, 18, 36)]


def filter_bits(terms: int) -> int:
    return min(MOST_BITS, max(15, (terms * BITS_PER_TERM - 1).bit_length()))


def anchor_places(bits: int) -> Callable[[Column, Column], Column]:
    """Places (from 1) of an anchor (gram, kind) in the filter."""

    def run(gram: pa.Array, kind: pa.Array) -> pa.Array:
        out = []
        for g, k in zip(gram.to_pylist(), kind.to_pylist(), strict=True):
            size = gram_size(k)
            out.append([int(s[0]) + 1 for s in spots(stirred(hashes(points(g), {size})[size], k), bits)])
        return pa.array(out, pa.list_(pa.int64()))

    run.__annotations__ = {"gram": pa.Array, "kind": pa.Array, "return": pa.Array}
    return arrow_udf(run, returnType="array<long>")


def bloom(anchors: DataFrame, bits: int) -> np.ndarray:
    """The filter of all anchors (``_g, _k``), put together on executors; its size is fixed by ``bits``."""
    place = anchors.select(F.explode(anchor_places(bits)("_g", "_k")).alias("p"))
    parts = place.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in parts.toLocalIterator():
        at = (row.b - 1) * 4096
        out[at : at + 4096] = np.frombuffer(row.m, np.uint8)
    return out


def candidates(chunks: DataFrame, marks: np.ndarray, reach: dict[int, int]) -> DataFrame:
    """Per text (``media_id, chunk``) the grams that the filter knows: kind ``_k``, gram ``_g``, and the text about it, ``_w``.

    ``reach`` gives the longest term of each kind; ``_w`` holds every stretch of that length which covers the gram, and ``_i``
    tells where in it the gram begins (from 0).
    """
    held = chunks.sparkSession.sparkContext.broadcast(marks)
    sizes = {gram_size(k) for k in reach}
    bits = int(marks.size * 8).bit_length() - 1
    media = chunks.schema["media_id"]
    one, eight = np.uint8(1), np.uint64(7)

    def made(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        n, kind, gram, near, at = zip(*rows)
        cols = [ids.take(pa.array(n)), pa.array(kind, pa.int32()), pa.array(gram, pa.string()), pa.array(near, pa.string()), pa.array(at, pa.int32())]
        return pa.RecordBatch.from_arrays(cols, names=["media_id", "_k", "_g", "_w", "_i"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column("media_id")
            for n, text in enumerate(batch.column("chunk").to_pylist()):
                own: set[tuple] = set()
                by_size = hashes(points(text), sizes)
                for kind, longest in reach.items():
                    size = gram_size(kind)
                    if size not in by_size:
                        continue
                    seen = np.ones(len(by_size[size]), bool)
                    for s in spots(stirred(by_size[size], kind), bits):
                        seen &= (held.value[s >> np.uint64(3)] >> (s & eight).astype(np.uint8)) & one == 1
                    for i in np.flatnonzero(seen).tolist():
                        low = max(0, i - longest + size)
                        own.add((n, kind, text[i : i + size], text[low : i + longest], i - low))
                rows += own
                if len(rows) >= FLUSH_ROWS:
                    yield made(ids, rows)
                    rows = []
            if rows:
                yield made(ids, rows)

    return chunks.select("media_id", "chunk").mapInArrow(run, f"media_id {media.dataType.simpleString()}, _k int, _g string, _w string, _i int")
