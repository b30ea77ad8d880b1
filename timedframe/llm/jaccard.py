"""Exact Jaccard self-join of word shingle sets by a grouped prefix join.

Two sets can only reach the threshold if they share an element of their prefixes under one global order.  The order puts
frequent elements last, so that passages which many documents share don't meet in prefixes.  Frequencies are counted over
all documents; they only steer the order, so counting truncated hashes is enough, and the number of elements that count as
frequent is bounded by their share of all elements.

Documents with equal sets form one class.  Classes with the same size and prefix form one group, and only groups are
looked up by prefix elements; groups that meet are expanded to their classes, which are verified on whole sets.  As only
connected components are asked for, classes that are connected already need no comparison: first every list of classes that share an element is
compared with one class of the list (``STAR_ROUNDS`` times), then, in lists that still hold several components, every two
classes of different components are compared.  No link between different texts is lost by that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from timedframe.llm.common import cut_lineage, discard, joined_bytes, text_slices
from timedframe.llm.components import connected

WORDS = 5
#: Least similarity as a fraction, compared in integers.
NEAR, OF = 4, 5
STAR_ROUNDS = 4
#: Elements before a common one that tell whether two classes have met already.
RECENT = 8
#: A shingle is frequent if it is in more than this many documents, and in more than one per so many characters of the corpus.
FREQUENT_DOCS = 50
FREQUENT_CHARS = 1 << 23
#: Pairs or ids that are broadcast at most (a few dozen bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
CHUNK = 1 << 20
SLICE = 2 << 20
FLUSH = 1 << 20
FOLD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray, by: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * FOLD[by]
    return x ^ (x >> np.uint64(29))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number per byte, the same for a letter in either case, and which bytes are blanks."""
    numbers = mixed(mixed(np.arange(1, 257, dtype=np.uint64) * FOLD[1], 2), 3)
    numbers[65:91] = numbers[97:123]
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    return numbers, blank


NUMBERS, BLANK = _tables()
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((int(FOLD[0]), pow(int(FOLD[0]), -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word in bytes: a polynomial of the word's bytes, from sums over all bytes of a chunk."""
    hashes, starts, a = [], [], 0
    while a < len(raw):
        b = min(len(raw), a + CHUNK)
        while b < len(raw) and not BLANK[raw[b]]:  # a word is not cut
            b += 1
        part = raw[a:b]
        up, down = powers(max(len(part), CHUNK))
        edge = np.diff(np.concatenate([[False], ~BLANK[part], [False]]).view(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(NUMBERS[part] * up[: len(part)], out=sums[1:])
        hashes.append(mixed((sums[last] - sums[first]) * down[first], 4))
        starts.append(first + a)
        a = b
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each whole text; only A-Z are folded, only ASCII blanks separate words."""
    raw, bounds = joined_bytes(texts)
    h, starts = word_hashes(raw)
    first = np.searchsorted(starts, bounds)
    size = max(0, len(h) - words + 1)
    whole = np.full(size, words, np.uint64)
    for i in range(words if size else 0):
        whole += h[i : i + size] * FOLD[i % len(FOLD)]
    whole = mixed(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        elif b > a:
            few = np.uint64(b - a) + (h[a:b] * FOLD[np.arange(b - a) % len(FOLD)]).sum(dtype=np.uint64)
            out.append(mixed(np.array([few], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(n):
    """Elements of a set of n that any partner must share: the least overlap with a partner of any size."""
    return (NEAR * n + OF - 1) // OF


class Order:
    """The global order: shingles that are not frequent by hash, then frequent ones from rare to common."""

    def __init__(self, bits: int, keys: np.ndarray, levels: np.ndarray):
        self.shift, self.keys, self.levels = np.uint64(64 - bits), keys, levels
        self.mark = np.zeros(1 << 22, bool)
        self.mark[keys & np.uint64((1 << 22) - 1)] = True

    def prefix(self, found: np.ndarray) -> tuple[np.ndarray, int]:
        """The prefix and how many of its elements are not frequent."""
        size = len(found) - needed(len(found)) + 1
        short = found >> self.shift
        maybe = np.flatnonzero(self.mark[short & np.uint64((1 << 22) - 1)])
        level = np.zeros(len(found), np.uint8)
        if len(maybe) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, short[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == short[maybe]
            level[maybe[hit]] = self.levels[at[hit]]
        order = np.argsort(level, kind="stable")[:size] if level.any() else np.arange(size)
        return found[order], int((level[order] == 0).sum())


def frequent(texts: DataFrame) -> Order:
    """Counts shingles over all rows of ``texts`` (column t) by truncated hashes, in buckets; a task counts its own first."""
    chars = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    bits = min(60, max(24, int(chars).bit_length() + 3))
    buckets = min(20, max(4, int(chars).bit_length() - 21))
    rest = np.uint64(bits - buckets)
    width = -(-int(rest) // 8)
    limit = max(FREQUENT_DOCS, chars // FREQUENT_CHARS)
    flush = max(FLUSH, 1 << (buckets + 4))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def emit():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            home = (keys >> rest).astype(np.int64)
            cuts = np.flatnonzero(np.diff(home)) + 1
            starts, ends = np.append([0], cuts), np.append(cuts, len(keys))
            low = (keys & ((np.uint64(1) << rest) - np.uint64(1))).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
            some = counts > 1
            rows = [(int(home[a]), low[a:b][~some[a:b]].tobytes(), low[a:b][some[a:b]].tobytes(), counts[a:b][some[a:b]].astype("<i8").tobytes()) for a, b in zip(starts, ends)]
            b, once, more, c = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary()), pa.array(c, pa.binary())], names=["b", "once", "more", "c"])

        for batch in batches:
            for part in text_slices(batch.column(0), SLICE):
                for found in shingles(part):
                    s = found >> np.uint64(64 - bits)
                    held.append(s)
                    n += len(s)
                    if n >= flush:
                        yield emit()
                        held, n = [], 0
        if n:
            yield emit()

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        def numbers(raw: bytes) -> np.ndarray:
            out = np.zeros((len(raw) // width, 8), np.uint8)
            out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
            return out.view("<u8").ravel()

        once = [numbers(x) for x in table.column("once").to_pylist()]
        more = [numbers(x) for x in table.column("more").to_pylist()]
        c = [np.frombuffer(x, "<i8") for x in table.column("c").to_pylist()]
        keys = np.concatenate([*once, *more])
        counts = np.concatenate([np.ones(sum(map(len, once)), np.int64), *c])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.append([True], keys[1:] != keys[:-1]))
        total = np.add.reduceat(counts, starts)
        keep = total > limit
        full = keys[starts][keep] | (np.uint64(key[0].as_py()) << rest)
        return pa.table({"k": full.astype(np.int64), "n": total[keep]})

    found = texts.mapInArrow(count, "b int, once binary, more binary, c binary").groupBy("b").applyInArrow(merge, "k long, n long").toArrow()
    keys = found.column("k").to_numpy().astype(np.uint64)
    levels = np.minimum(np.log2(np.maximum(found.column("n").to_numpy(), 2)).astype(np.uint8), 60)
    order = np.argsort(keys)
    return Order(bits, keys[order], levels[order])


def prefixes(docs: DataFrame, order: Order) -> DataFrame:
    """Per row: id, n, node (its set's identity), prefix identity and elements, and how many of these are not frequent."""
    held = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for part in text_slices(batch.column(1), SLICE):
                rows = []
                for s in shingles(part):
                    first, light = held.value.prefix(s) if len(s) else (s, 0)
                    rows.append((len(s), *identity(s), *identity(first), light, first.astype("<u8").tobytes()))
                n, s1, s2, p1, p2, light, raw = zip(*rows)
                cols = [ids.slice(at, len(part)), pa.array(n, pa.int64()), *[pa.array(x, pa.int64()) for x in (s1, s2, p1, p2)], pa.array(light, pa.int64()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "s1", "s2", "p1", "p2", "light", "prefix"])
                at += len(part)

    made = docs.select("id", "t").mapInArrow(run, "id long, n long, s1 long, s2 long, p1 long, p2 long, light long, prefix binary")
    return made.select("id", "n", node(), F.xxhash64("n", "p1", "p2").alias("g"), "light", "prefix")


def identity(found: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    return tuple(int(mixed(found, k).sum(dtype=np.uint64).astype(np.int64)) for k in (3, 4))


def node() -> Column:
    return F.xxhash64("n", "s1", "s2").alias("node")


def places(sizes: list[int]) -> np.ndarray:
    """0, 1, 2, ... for each of several lists."""
    sizes = np.asarray(sizes, np.int64)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def shared_elements(groups: DataFrame) -> DataFrame:
    """(token, gid, pos) of prefix elements that two or more groups have, with their place in the group's prefix.

    Elements that are not frequent are brought together in buckets of bounded lists and only shared ones come out; frequent ones
    are rows at once.
    """
    chars = groups.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    bits = min(20, max(4, int(chars).bit_length() - 21))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gids = batch.column(0).to_numpy()
            light, raw = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            parts = [np.frombuffer(r, "<u8")[:k] for r, k in zip(raw, light, strict=True)]
            if not len(gids):
                continue
            tokens, base = np.concatenate(parts), int(gids.min())
            if not len(tokens):
                continue
            owner = np.repeat((gids - base).astype(np.uint64), light)
            place = places(light)
            home = (tokens >> np.uint64(64 - bits)).astype(np.int64)
            by = np.argsort(home, kind="stable")
            tokens, owner, place, home = tokens[by], owner[by], place[by], home[by]
            cuts = np.flatnonzero(np.diff(home)) + 1
            # 40 bits after the bucket's tell elements apart well enough: whoever meets by chance fails verification.
            low = ((tokens << np.uint64(bits)) >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            wide = 4 if int(owner.max()) < 1 << 32 else 8
            own = owner.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]
            pos = place.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
            rows = [(int(home[a]), base, wide, low[a:b].tobytes(), own[a:b].tobytes(), pos[a:b].tobytes()) for a, b in zip(np.append([0], cuts), np.append(cuts, len(home)))]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=["b", "base", "w", "t", "o", "p"])

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        def numbers(raw: bytes, width: int) -> np.ndarray:
            out = np.zeros((len(raw) // width, 8), np.uint8)
            out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
            return out.view("<u8").ravel()

        tokens = np.concatenate([numbers(t, 5) for t in table.column("t").to_pylist()])
        owner = np.concatenate([numbers(o, w).astype(np.int64) + b for o, w, b in zip(table.column("o").to_pylist(), table.column("w").to_pylist(), table.column("base").to_pylist(), strict=True)])
        place = np.concatenate([numbers(p, 3).astype(np.int64) for p in table.column("p").to_pylist()])
        by = np.argsort(tokens, kind="stable")
        tokens, owner, place = tokens[by], owner[by], place[by]
        same = tokens[1:] == tokens[:-1]
        keep = np.append(same, False) | np.append(False, same)
        full = tokens[keep] | (np.uint64(key[0].as_py()) << np.uint64(40))
        return pa.table({"token": full.astype(np.int64), "gid": owner[keep], "pos": place[keep]})

    dealt = groups.select("gid", "light", "prefix").mapInArrow(deal, "b int, base long, w int, t binary, o binary, p binary")
    rare = dealt.groupBy("b").applyInArrow(meet, "token long, gid long, pos long")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            light = batch.column(1).to_pylist()
            parts = [np.frombuffer(r, "<u8")[k:] for r, k in zip(batch.column(2).to_pylist(), light, strict=True)]
            if parts:
                sizes = [len(p) for p in parts]
                owner, place = np.repeat(batch.column(0).to_numpy(), sizes), places(sizes) + np.repeat(light, sizes)
                # Bit 62 keeps them apart from the 60 bits or fewer of the others.
                tokens = (np.concatenate(parts) >> np.uint64(2)).astype(np.int64) | np.int64(1 << 62)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(owner), pa.array(place.astype(np.int64))], names=["token", "gid", "pos"])

    common = groups.filter(F.col("light") * 8 < F.octet_length("prefix")).select("gid", "light", "prefix").mapInArrow(spread, "token long, gid long, pos long")
    # Classes of one group meet under an element of their own.
    own = groups.filter("members > 1").select((-F.col("gid") - 1).alias("token"), "gid", F.lit(0).cast("long").alias("pos"))
    return rare.unionByName(common).unionByName(own)


def packed(found: np.ndarray) -> bytes:
    """The upper 48 bits of each element; within two sets that tells elements apart."""
    return (found >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the threshold."""

    def near(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(x, y, strict=True):
            a, b = unpacked(a.as_buffer()), unpacked(b.as_buffer())
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(OF * both >= NEAR * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    near.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    check = arrow_udf(near, returnType="boolean")
    held = both_sides(pairs, sets, "s")
    return held.filter(check("sa", "sb")).select("a", "b")


def checked_broadcast(rows: DataFrame) -> DataFrame:
    """Short rows, marked for a broadcast if a count of them allows it."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def both_sides(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Each pair (a, b) with the columns of ``table`` of both nodes, as sa and sb and so on; only rows that a pair asks for move."""
    wanted = checked_broadcast(pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node")))
    side = lambda c, end: F.max(F.when(F.col("node") == F.col(end), F.col(c))).alias(c + end)
    held = table.join(wanted, "node").groupBy("a", "b").agg(*[side(c, end) for c in columns for end in "ab"])
    return held.filter(F.col(columns[0] + "a").isNotNull() & F.col(columns[0] + "b").isNotNull())


def plausible(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """The pairs whose prefixes have enough in common; ``elements``: node, n and the shared elements ``e`` of its prefix.

    Of the two sets, the one whose prefix ends first in the order has all its elements that lie in both prefixes or behind its own.
    So the overlap is at most the number of common prefix elements plus the larger of the two rests.  Sets of one group (they
    share an element of the group's own, which is negative) have whole prefixes in common.
    """
    held = both_sides(pairs, elements, "e", "n")
    common = F.array_intersect("ea", "eb")
    rest = F.greatest(F.ceil(F.col("na") * NEAR / OF), F.ceil(F.col("nb") * NEAR / OF)) - 1
    enough = (NEAR + OF) * (F.size(common) + rest) >= NEAR * (F.col("na") + F.col("nb"))
    return held.filter(enough | F.exists(common, lambda x: x < 0)).select("a", "b")


def may_link(n: Column, pos: Column, lone: Column, m: Column, at: Column, alone: Column) -> Column:
    """Whether sets of n and m elements can be near, whose first common prefix elements are at ``pos`` and ``at``.

    Elements before the first common one are not in the other set.  The ``lone`` and ``alone`` ones are not in the other prefix,
    but those of the smaller set can lie behind the prefix of the larger one, whose rest is longer by the difference of ``needed``.
    """
    more = F.ceil(m * NEAR / OF) - F.ceil(n * NEAR / OF)
    most = F.least(n - pos, n - lone + F.greatest(more, F.lit(0)), m - at, m - alone + F.greatest(-more, F.lit(0)))
    return (NEAR + OF) * most >= NEAR * (n + m)


def may_link_any(n: Column, pos: Column, lone: Column, shortest: Column, longest: Column) -> Column:
    """Whether a set can be near any set of a size from shortest to longest; true wherever ``may_link`` is for one of them."""
    # 5 times ``needed`` is 4 n to 4 n + 4, so the bound grows with the larger partner's size, which is at most 5/4 of n.
    largest = F.least(longest, F.floor(n * OF / NEAR))
    behind = (NEAR + OF) * (OF * (n - lone) + NEAR * (largest - n) + OF - 1) >= NEAR * OF * (n + largest)
    alike = (NEAR + OF) * (n - lone) >= NEAR * (n + shortest)
    return ((NEAR + OF) * (n - pos) >= NEAR * (n + shortest)) & (alike | (largest > n) & behind)


def classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: id_column, n_shingles and component_id.

    Null and empty texts have 0 shingles and are linked with nothing.  A row with a null id is linked with nothing either, and its
    component is null.  Rows that share an id are rows of their own with that id.  Texts of any length are read whole;
    an empty table gives an empty one; other columns are not read.
    """
    base = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    order = frequent(base.select("t"))
    rows = cut_lineage(prefixes(base, order))
    usable = rows.filter("n > 0 and id is not null")
    nodes = usable.groupBy("node", "n", "g", "light").agg(F.min("id").alias("label"))
    groups = usable.groupBy("g", "n", "light").agg(F.first("prefix").alias("prefix"), F.min("node").alias("least"), F.max("node").alias("most"))
    groups = cut_lineage(groups.select("g", "n", "light", "prefix", (F.when(F.col("least") == F.col("most"), 1).otherwise(2)).alias("members"), F.monotonically_increasing_id().alias("gid")))
    shared = cut_lineage(shared_elements(groups))
    # Elements of a prefix that are in no other prefix bound the overlap by ``may_link``.
    counted = shared.filter("token >= 0").groupBy("gid").agg(F.count("*").alias("met"))
    reached = shared.select("gid").distinct()
    size = (F.octet_length("prefix") / 8).cast("long")
    # Not so within a group of several classes, which have the whole prefix in common.
    lone = F.when(F.col("members") == 1, F.col("p") - F.coalesce("met", F.lit(0))).otherwise(F.lit(0)).cast("long")
    known = groups.select("gid", "g", "members", size.alias("p")).join(reached, "gid").join(counted, "gid", "left").select("gid", "g", lone.alias("lone"))
    nodes = cut_lineage(nodes)
    member = cut_lineage(nodes.join(known, "g").select("gid", "node", "n", "light", "label", "lone"))
    # Elements before the first common one are not in the overlap; each pair need only pass where it first meets.
    lists = cut_lineage(shared.join(member, "gid").select("token", "node", "n", "light", "pos", "lone", F.col("node").alias("comp")))

    elements = cut_lineage(lists.groupBy("node", "n").agg(F.collect_set("token").alias("e")))

    wanted = checked_broadcast(cut_lineage(member.select("label").distinct()))
    held = base.join(wanted, base["id"] == wanted["label"], "left_semi")
    # Repeated rows give a set twice and other texts of the same id one that nobody asks for; neither changes a verdict.
    sets = cut_lineage(sets_of(held))
    discard(groups, shared)

    roots = None
    for turn in range(STAR_ROUNDS + 1):
        # Lists that hold several components, without classes that can be near no member of the list.
        span = [F.min("n").alias("shortest"), F.max("n").alias("longest")]
        sizes = lists.groupBy("token").agg(*span, F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2")
        sizes = sizes.select(F.col("token").alias("k"), "shortest", "longest")
        useful = may_link_any(*[F.col(c) for c in ("n", "pos", "lone", "shortest", "longest")])
        was, lists = lists, cut_lineage(lists.join(sizes, F.col("token") == F.col("k")).filter(useful).drop("k", "shortest", "longest"))
        discard(was)
        # At first the class with the fewest elements of its own, which is near most copies of one text; later any.
        central = ["light", F.col("lone").alias("own")] if turn == 0 else []
        first = F.min(F.struct(*central, F.xxhash64("node", F.lit(turn)).alias("by"), "node", "n", "pos", "lone", "comp")).alias("first")
        leads = lists.groupBy("token").agg(first, F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2").select(F.col("token").alias("k"), "first")
        if turn < STAR_ROUNDS:
            f = F.col("first")
            tested = lists.join(leads, F.col("token") == F.col("k")).filter((F.col("comp") != f["comp"]) & may_link(F.col("n"), F.col("pos"), F.col("lone"), f["n"], f["pos"], f["lone"]))
            pairs = tested.select(F.least("node", f["node"]).alias("a"), F.greatest("node", f["node"]).alias("b")).distinct()
        else:
            # Two classes need only pass where they first meet; they aren't paired again where an element shortly before is common too.
            recent = Window.partitionBy("node").orderBy("pos", "token").rowsBetween(-RECENT, -1)
            placed = lists.withColumn("before", F.collect_list("token").over(recent))
            x, y = placed.alias("x"), placed.alias("y")
            meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))
            meet &= may_link(*[F.col(f"{side}.{c}") for side in "xy" for c in ("n", "pos", "lone")])
            meet &= ~F.arrays_overlap("x.before", "y.before")
            pairs = x.join(y, meet).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
        met = cut_lineage(pairs)
        pairs = cut_lineage(plausible(met, elements))
        found = cut_lineage(verify(pairs, sets))
        discard(met, pairs)
        if found.isEmpty():
            discard(found)
            continue
        old = roots
        roots = connected(found if old is None else found.unionByName(old.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        if turn < STAR_ROUNDS:
            named = roots.withColumnRenamed("node", "k2")
            now = lists.join(named, F.col("node") == F.col("k2"), "left")
            was, lists = lists, cut_lineage(now.select("token", "node", "n", "light", "pos", "lone", F.coalesce("root", "comp").alias("comp")))
            discard(was)
        discard(found, old)
    discard(sets, elements)
    if roots is None:
        roots = lists.select("node", F.col("node").alias("root")).limit(0)

    labelled = nodes.join(roots.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left").select("node", "label", F.coalesce("root", "node").alias("comp"))
    least = labelled.groupBy("comp").agg(F.min("label").alias("component"))
    named = labelled.join(least, "comp").select(F.col("node").alias("k"), "component")
    out = rows.select("id", "n", "node").join(named, (F.col("node") == F.col("k")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def sets_of(rows: DataFrame) -> DataFrame:
    """(node, s) of each row's whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column(0), SLICE):
                found = shingles(part)
                s1, s2 = zip(*[identity(s) for s in found])
                cols = [pa.array([len(s) for s in found], pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array([packed(s) for s in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["n", "s1", "s2", "s"])

    return rows.select("t").mapInArrow(run, "n long, s1 long, s2 long, s binary").select(node(), "s")
