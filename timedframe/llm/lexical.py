"""Ranked lexical search with hashed max-sketches.

Each document is folded into a sketch: every term is hashed to one of WIDTH coordinates, and a coordinate keeps the
largest impact of its terms.  A query looks its terms' coordinates up; the weighted sum bounds the score from above, since
a coordinate is never below the impact of the term looked up.  All queries of a block are looked up in all sketches of a block
of documents at once.  Documents are then scored exactly in descending order of their bounds, until the bound falls
below the score of the k-th best so far.  Each task keeps its k best per query; the k best of all tasks are the answer.

The score, for document length n, N documents with terms and L terms altogether, in whole numbers:
``sum of weight * (10**9 * tf div (1000 * tf + 8 * (25 + 75 * n * N div L)))``.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 10
#: Coordinates of a sketch, and cells (documents x looked-up terms) of one batched look-up.
WIDTH = 4096
CELLS = 2_000_000
BLOCK = 512
#: Characters of query texts that a task holds; more queries are searched in several blocks.
QUERY_CHARS = 2_000_000
#: Terms whose coordinates a worker remembers.
CACHED_TERMS = 1_000_000

_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b in _LETTERS else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII; A-Z in lower case."""
    return text.translate(_FOLD).split() if text else []


class Coordinates(dict):
    """Coordinate of each term, remembered."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= CACHED_TERMS:
            self.clear()
        self[term] = at = zlib.crc32(term) % WIDTH
        return at


def slowing(length: int, documents: int, all_terms: int) -> int:
    """What a document's length adds under each term count: 8 m."""
    return 8 * (25 + 75 * length * documents // all_terms)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def sketch(counts: Counter, slow: int, coordinates: Coordinates, out: np.ndarray) -> None:
    """Folds the impacts of one document's terms into ``out`` by maxima."""
    at = np.fromiter(map(coordinates.__getitem__, counts), np.int64, len(counts))
    tf = np.fromiter(counts.values(), np.int64, len(counts))
    # An impact grows with its count, and the last of several writes to a coordinate stays.
    order = np.argsort(tf, kind="stable")
    tf = tf[order]
    out[at[order]] = 1_000_000_000 * tf // (1000 * tf + slow)


class Batch:
    """A block of queries: their terms with repeats, as (term, weight times repeats), laid out for look-ups."""

    def __init__(self, queries: Sequence[tuple[int, Counter]], df: dict[bytes, int], documents: int):
        self.names, self.own = [], []
        for name, counts in queries:
            known = [(t, q * weight(documents, df[t])) for t, q in counts.items() if df.get(t)]
            if known:
                self.names.append(name)
                self.own.append(known)
        flat = [(t, w) for own in self.own for t, w in own]
        coordinates = Coordinates()
        self.at = np.array([coordinates[t] for t, _ in flat], np.int64)
        self.weights = np.array([w for _, w in flat], np.int64)
        self.starts = np.cumsum([0, *(len(own) for own in self.own)])[:-1]

    def bounds(self, sketches: np.ndarray) -> np.ndarray:
        """Upper bounds, documents x queries."""
        return np.add.reduceat(sketches[:, self.at] * self.weights, self.starts, axis=1)


class Best:
    """The k best documents of one query: higher scores first, then lower ids; a null id is lowest."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    @property
    def least(self) -> int:
        """No document with a lower score can enter."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def add(self, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is None, -doc_id if doc_id is not None else 0)
        if len(self.heap) < self.k:
            heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapreplace(self.heap, entry)

    def rows(self) -> Iterator[tuple[int | None, int]]:
        for score, null, negative in self.heap:
            yield None if null else -negative, score


class Search:
    """One task's search: takes blocks of documents, keeps the k best of each query."""

    def __init__(self, batch: Batch, documents: int, all_terms: int, k: int = TOP):
        self.batch, self.documents, self.all_terms = batch, documents, all_terms
        self.best = [Best(k) for _ in batch.own]
        self.coordinates = Coordinates()
        self.scored = 0

    def block(self, ids: list[int | None], texts: list[bytes | None]) -> None:
        counted = [Counter(terms(t)) for t in texts]
        slow = [slowing(c.total(), self.documents, self.all_terms) for c in counted]
        sketches = np.zeros((len(counted), WIDTH), np.int64)
        for c, s, row in zip(counted, slow, sketches, strict=True):
            sketch(c, s, self.coordinates, row)
        bounds = self.batch.bounds(sketches)
        least = np.array([b.least for b in self.best], np.int64)
        docs, queries = np.nonzero(bounds >= least)
        order = np.lexsort((-bounds[docs, queries], queries))
        done = -1
        for d, q in zip(docs[order].tolist(), queries[order].tolist()):
            if q == done:
                continue
            best = self.best[q]
            if bounds[d, q] < best.least:
                done = q  # all that follow have lower bounds still
                continue
            self.scored += 1
            counts, below = counted[d], slow[d]
            score = 0
            for t, w in self.batch.own[q]:
                if tf := counts.get(t):
                    score += w * (1_000_000_000 * tf // (1000 * tf + below))
            if score > 0:
                best.add(score, ids[d])


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _statistics(docs: DataFrame, wanted: set[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with terms, all terms, and how many documents hold each wanted term; one count per task and term is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        documents = all_terms = 0
        for batch in _blocks(batches, BLOCK):
            for text in batch.column(1).to_pylist():
                found = terms(text)
                if found:
                    documents += 1
                    all_terms += len(found)
                    df.update(wanted.intersection(found))
        names = [None, None, *df]
        yield pa.RecordBatch.from_pydict(
            {"term": pa.array(names, pa.binary()), "part": pa.array([0, 1, *[2] * len(df)], pa.int32()), "n": pa.array([documents, all_terms, *df.values()], pa.int64())}
        )

    rows = docs.mapInArrow(run, "term binary, part int, n long").groupBy("part", "term").agg(F.sum("n").alias("n")).collect()
    of_part = {r.part: r.n for r in rows if r.part < 2}
    return of_part.get(0, 0), of_part.get(1, 0), {bytes(r.term): r.n for r in rows if r.part == 2}


def _search_block(docs: DataFrame, queries: list[tuple[int, Counter]], k: int) -> DataFrame:
    """The k best documents of each task for each query of one block: query, doc_id, score."""
    schema = "query long, doc_id long, score long"
    documents, all_terms, df = _statistics(docs, set().union(*[c for _, c in queries]))
    batch = Batch(queries, df, documents)
    if not batch.own:
        return docs.sparkSession.createDataFrame([], schema)
    size = max(1, min(BLOCK, CELLS // len(batch.at)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(batch, documents, all_terms, k)
        for part in _blocks(batches, size):
            search.block(part.column(0).to_pylist(), part.column(1).to_pylist())
        for name, best in zip(batch.names, search.best, strict=True):
            ids, scores = zip(*best.rows()) if best.heap else ((), ())
            yield pa.RecordBatch.from_pydict({"query": pa.array([name] * len(ids), pa.int64()), "doc_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    return docs.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", block_chars: int = QUERY_CHARS) -> DataFrame:
    """The ``k`` best documents with a score above 0 for each row of ``items``: item_id, rank, doc_id, score.

    ``docs``: doc_id, text; ``items``: item_id, text.  Null texts and texts without a term have no terms: such documents don't count
    in N, such items have no rows, nor have items whose terms occur nowhere.  Texts of any length are read whole.  Equal scores are
    ordered by ascending doc_id, a null id first.  Repeated documents are documents of their own; repeated items count once, and
    an item_id with several texts is one query per text.  Empty tables give an empty result; further columns are ignored.

    Items are held by the tasks in blocks of about ``block_chars`` characters (a longer item is a block of its own); each
    block reads the documents twice, once for the counts and once for the search.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("binary").alias("text"))
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text")).distinct()
    chars = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-chars // block_chars))
    found, names = [], []
    for b in range(n_blocks):
        part = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b)
        rows = sorted(part.collect(), key=lambda r: (r.item_id is not None, r.item_id, r.text or b""))
        queries = [((b << 32) + i, Counter(terms(bytes(r.text) if r.text is not None else None))) for i, r in enumerate(rows)]
        names += [((b << 32) + i, r.item_id) for i, r in enumerate(rows)]
        if any(c for _, c in queries):
            found.append(_search_block(docs, queries, k))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = spark.createDataFrame(names, "query long, item_id long")
    return ranked.join(named, "query").select("item_id", "rank", "doc_id", "score")
