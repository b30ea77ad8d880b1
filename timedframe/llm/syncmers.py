"""Document fingerprints from closed syncmers.

A text's tokens are its runs of non-blanks, cut after ``TOKEN_CHARS`` characters.  A k-mer is K tokens in a row;
its inner substrings are the S-token runs within it.  A k-mer whose smallest inner substring, by hash, lies at
either edge is a closed syncmer.  Whether one is chosen depends on its own tokens only, so an edit changes the
anchors that touch it and no others.  ``anchors`` gives them with their positions.  A fingerprint is the
``SKETCH`` smallest hashes of a text's distinct anchors; the likeness of two is the estimated share of anchors
that the texts have in common.  All of it is DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timedframe.llm.common import cut_lineage
from timedframe.llm.rules import let

TOKEN_CHARS = 8
K, S = 3, 1
SKETCH = 64
#: Characters of text that one block of neighbours holds.
BLOCK_CHARS = 8_000_000
#: Quantiles of the keys that the driver holds; more blocks than that divide the range between two evenly.
QUANTILES = 1024
BROADCAST_BLOCKS = 100_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^\\x20\\x09-\\x0D]{{1,{TOKEN_CHARS}}}"), F.lit(0))


def _smers(found: Column, s: int) -> Column:
    if s == 1:
        return F.transform(found, lambda x: F.xxhash64(x))
    return F.transform(F.slice(found, 1, F.greatest(F.size(found) - (s - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(found, i + d) for d in range(1, s)]))


def _chosen(h: Column, k: int, s: int) -> Column:
    """Hash of each k-mer of the s-mer hashes ``h``, null where the smallest inner one lies inside."""
    inner = k - s + 1

    def pick(x: Column, i: Column) -> Column:
        others = [F.get(h, i + d) for d in range(1, inner)]
        least = F.least(x, *others) if others else x
        edge = (x == least) | (others[-1] == least) if others else F.lit(True)
        return F.when(edge, F.xxhash64(x, *others))

    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (inner - 1), F.lit(0))), pick)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of (position, hash) of the closed syncmers; positions count k-mers from 0."""
    return let(
        _smers(tokens(text), s),
        lambda h: F.filter(F.transform(_chosen(h, k, s), lambda x, i: F.struct(i.alias("position"), x.alias("hash"))), lambda a: a["hash"].isNotNull()),
    )


def sketch(text: Column, k: int = K, s: int = S, size: int = SKETCH) -> Column:
    """The ``size`` smallest distinct anchor hashes in order.

    A text of fewer than ``k`` tokens has the hash of all its tokens as only anchor; without a token it has none.
    """
    inner = k - s + 1

    def of(h: Column) -> Column:
        chosen = F.array_distinct(F.filter(_chosen(h, k, s), lambda x: x.isNotNull()))
        few = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))
        return F.when(F.size(h) < inner, few).otherwise(F.slice(F.sort_array(chosen), 1, size))

    return let(_smers(tokens(text), s), of)


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    """Share of the smallest hashes of both that both have; 1 for two empty fingerprints."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    return let(
        F.struct(union.alias("u"), F.array_intersect(a, b).alias("i")),
        lambda v: F.when(F.size(v["u"]) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(v["u"], v["i"])) / F.size(v["u"])),
    )


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.hex(x))), "-")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row of ``docs`` with ``fingerprint``, the text form of its sketch.

    Null and empty texts have the empty fingerprint; equal texts have equal ones.  Whole texts of any length
    are read, repeated rows stay, an empty table gives an empty one, a column of that name is replaced.
    """
    return docs.withColumn("fingerprint", as_text(sketch(F.col(text))))


def _block(key: Column, cuts: list[int], low: int, high: int, parts: int) -> Column:
    """Number of the block of consecutive keys: a binary search among quantiles, then ``parts`` even ranges between two of them."""
    if not cuts:
        at, first, last = F.lit(0), F.lit(low), F.lit(high)
    else:
        bounds = F.lit(cuts)
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
        at = F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.coalesce(F.get(bounds, n + s - 1) <= key, F.lit(False)), n + s).otherwise(n))
        edges = F.lit([low, *cuts, high + 1])
        return let(at, lambda n: n.cast("long") * parts + _part(key, F.get(edges, n), F.get(edges, n + 1), parts))
    return at.cast("long") * parts + _part(key, first, last + 1, parts)


def _part(key: Column, first: Column, last: Column, parts: int) -> Column:
    inside = F.floor((key - first).cast("double") / F.greatest((last - first).cast("double"), F.lit(1.0)) * parts)
    return F.coalesce(F.least(F.greatest(inside, F.lit(0)), F.lit(parts - 1)).cast("long"), F.lit(0).cast("long"))


def follow(docs: DataFrame, key: str, text: str, derived: dict[str, Column]) -> DataFrame:
    """Each row's ``_row`` and that of the row after it by ascending integer ``key``, as ``_next``; the last row is followed by the first.

    A row is a struct of ``key``, ``text`` (null as empty) and the ``derived`` columns.  Equal keys follow one another by a hash
    of their text; null keys come first.  Rows are dealt to blocks of consecutive keys and neighbours are found within
    a block; the first row of each block is also dealt, as a last row that is not returned, to the block before.
    """
    raw = docs.select(F.col(key).cast("long").alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    sizes = raw.agg(F.sum(F.length("_t")), F.min("_k"), F.max("_k")).first()
    blocks = max(1, math.ceil((sizes[0] or 0) / BLOCK_CHARS))
    quantiles = min(blocks, QUANTILES)
    cuts = raw.agg(F.percentile_approx("_k", [i / quantiles for i in range(1, quantiles)], 20 * quantiles)).first()[0] if quantiles > 1 else []
    place = _block(F.col("_k"), sorted(set(cuts or [])), sizes[1] or 0, sizes[2] or 0, math.ceil(blocks / QUANTILES))
    placed = raw.select("_k", "_t", place.alias("_b"), F.xxhash64("_t").alias("_h"))

    row = F.struct(F.col("_k").alias(key), F.col("_t").alias("text"), *[c.alias(n) for n, c in derived.items()])
    heads = placed.groupBy("_b").agg(F.min(F.struct("_k", "_h")).alias("_first"))
    around = Window.orderBy("_b")  # one small row per block
    before = F.coalesce(F.lag("_b").over(around), F.max("_b").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = cut_lineage(heads.select("_b", "_first", before.alias("_before")))
    known = heads.withColumnRenamed("_b", "_hb")
    # One row of numbers per block; their number was counted above.
    known = F.broadcast(known) if blocks <= BROADCAST_BLOCKS else known
    firsts = (
        placed.join(known, (F.col("_b") == F.col("_hb")) & F.struct("_k", "_h").eqNullSafe(F.col("_first")))
        .dropDuplicates(["_b"])
        .select(F.col("_before").alias("_b"), "_k", "_h", F.lit(1).alias("_last"), row.alias("_row"))
    )
    rows = placed.select("_b", "_k", "_h", F.lit(0).alias("_last"), row.alias("_row")).unionByName(firsts)
    order = Window.partitionBy("_b").orderBy("_last", "_k", "_h")
    return rows.select("_last", "_row", F.lead("_row").over(order).alias("_next")).filter("_last = 0").select("_row", "_next")


def compare_with_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text whose second half is replaced by the start of the next one's.

    Null texts are read as empty.  The only row of a table is its own next one.  Repeated keys are rows of their own.
    """
    pairs = follow(docs, key, text, {"sketch": sketch(F.col("_t"))})
    n = F.length("_row.text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("_row.text"), n - half), F.left(F.col("_next.text"), half))
    both = pairs.select(
        F.col(f"_row.{key}").alias(key),
        n.cast("long").alias("n_chars"),
        F.col("_row.sketch").alias("_a"),
        F.col("_next.sketch").alias("_n"),
        let(edited, lambda e: F.struct(F.sha2(e.cast("binary"), 256).alias("sha"), sketch(e).alias("sketch"))).alias("_e"),
    )
    return both.select(
        key,
        "n_chars",
        F.col("_e.sha").alias("edited_sha256"),
        as_text(F.col("_a")).alias("fingerprint"),
        as_text(F.col("_e.sketch")).alias("edited_fingerprint"),
        likeness(F.col("_a"), F.col("_e.sketch")).alias("near_edited"),
        likeness(F.col("_a"), F.col("_n")).alias("near_next"),
    )
