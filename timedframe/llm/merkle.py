"""Merkle manifest of a dataset, built by streaming appends with incremental witnesses.

Every row is a leaf.  Leaves of one group stand in order; runs of ``arity`` consecutive nodes become their hash, level by
level, until one node is left, the group's subroot; the subroots in group order form a further tree that ends in the root.

``Appender`` takes leaves one after another.  A leaf's witness is attached to the open subtree that holds the leaf, and each
run that completes above it adds one step (its place in the run and the digests beside it).  Blocks of ``arity ** height``
aligned leaves are appended in parallel tasks; their roots are appended to the next tree as if they were leaves, so what a
task holds is one block, whatever the size of a group.  On the way down each block takes the witness of its root as the
continuation of its own witnesses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timedframe.llm.common import cut_lineage, discard

ARITY = 8
#: Levels that one task climbs: a block has at most ARITY ** HEIGHT nodes.
HEIGHT = 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

#: One step of a witness: the node's place in its run and the other digests of the run, from left to right.
WITNESS = "array<struct<place: int, beside: array<string>>>"
Step = tuple[int, list[str]]


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_above(nodes: int, arity: int = ARITY) -> int:
    """Levels from ``nodes`` leaves up to one root."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // arity), levels + 1
    return levels


class Appender:
    """A tree that grows by appended leaves.

    ``open[l]`` is the run of level l that isn't complete: pairs of a digest and the witnesses of the leaves below it.
    A tree of known height ``levels`` stops there; otherwise ``close`` climbs until one node is left.
    """

    def __init__(self, arity: int = ARITY, levels: int | None = None):
        self.arity, self.levels = arity, levels
        self.open: list[list[tuple[str, list[list[Step]]]]] = [[]]

    def append(self, leaf: str) -> list[Step]:
        """Adds a leaf; its witness is returned and grows with every run that completes above it."""
        witness: list[Step] = []
        self._add(0, leaf, [witness])
        return witness

    def _add(self, level: int, node: str, below: list[list[Step]]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((node, below))
        if len(self.open[level]) == self.arity and level != self.levels:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [n for n, _ in run]
        for place, (_, below) in enumerate(run):
            step = (place, nodes[:place] + nodes[place + 1 :])
            for witness in below:
                witness.append(step)
        self._add(level + 1, digest(nodes), [w for _, below in run for w in below])

    def close(self) -> str:
        """Completes what is open and gives the root; at least one leaf must have been appended."""
        level = 0
        while not self._is_root(level):
            if self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0][0]

    def _is_root(self, level: int) -> bool:
        if self.levels is not None:
            return level == self.levels
        return len(self.open[level]) == 1 and not any(self.open[level + 1 :])


def fold(leaf: str, witness: Iterable[Step]) -> str:
    """The root that a leaf and its witness lead to."""
    for place, beside in witness:
        leaf = digest([*beside[:place], leaf, *beside[place:]])
    return leaf


def leaf_digest(columns: Sequence[str | Column]) -> Column:
    """Hash of a row: each value as its UTF-8 byte count, a colon and itself, or a dash for null."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def positions(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0, in order within a key) and ``total`` (rows of the key), written once.

    Range partitions by (key, order) spread a key that holds most rows; only one count per key and partition is summed.
    """
    spread = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(key, *order, "_tie")
    parted = cut_lineage(spread.withColumn("_part", F.spark_partition_id()))
    counts = parted.groupBy(key, "_part").count()
    own = Window.partitionBy(key)
    starts = counts.select(
        key,
        "_part",
        (F.sum("count").over(own.orderBy("_part")) - F.col("count")).alias("_start"),
        F.sum("count").over(own).alias("total"),
    )
    row = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order, "_tie"))
    placed = parted.withColumn("_row", row).join(starts, [key, "_part"])
    out = cut_lineage(placed.withColumn("pos", F.col("_start") + F.col("_row") - 1).drop("_start", "_row", "_part", "_tie"))
    discard(parted)
    return out


def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {size}"))


def _block_roots(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """One node per block, which is a leaf of the tree above: key, pos, total, node."""
    size = arity**height

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        total = table["total"][0].as_py()
        tree = Appender(arity, min(height, levels_above(total, arity)))
        for node in table["node"].to_pylist():
            tree.append(node)
        return pa.table(
            {"key": table["key"][:1], "pos": table["block"][:1], "total": pa.array([-(-total // size)], pa.int64()), "node": [tree.close()]}
        )

    held = _blocks(nodes.select("key", "pos", "total", "node"), size)
    return held.groupBy("key", "block").applyInArrow(run, "key string, pos long, total long, node string")


def _climb(leaves: DataFrame, arity: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round of blocks, leaves first, and one root per key (key, node)."""
    largest = leaves.agg(F.max("total")).first()[0] or 0
    rounds = [leaves]
    while largest > arity**height:
        rounds.append(cut_lineage(_block_roots(rounds[-1], arity, height)))
        largest = -(-largest // arity**height)
    return rounds, cut_lineage(_block_roots(rounds[-1], arity, height).select("key", "node"))


#: What a block knows from above: the continuation of its witnesses and the roots that they lead to.
ABOVE = f"witness {WITNESS}, subroot string, root string"


def _witnesses(nodes: DataFrame, above: DataFrame, arity: int, height: int, finish, schema: str) -> DataFrame:
    """``finish(table, witnesses, above)`` over each block: its nodes in order, their whole witnesses and the block's row above.

    ``above``: key, block and the columns ABOVE, one row for each block.
    """
    size = arity**height

    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        table, top = table.sort_by("pos"), upper.to_pylist()[0]
        tree = Appender(arity, min(height, levels_above(table["total"][0].as_py(), arity)))
        witnesses = [tree.append(node) for node in table["node"].to_pylist()]
        tree.close()
        rest = [(s["place"], s["beside"]) for s in top["witness"]]
        for w in witnesses:
            w.extend(rest)
        return finish(table, witnesses, top)

    return _blocks(nodes, size).groupBy("key", "block").cogroup(above.groupBy("key", "block")).applyInArrow(run, schema)


def _as_rows(witnesses: list[list[Step]]) -> list[list[dict]]:
    return [[{"place": p, "beside": b} for p, b in w] for w in witnesses]


STEPS = pa.list_(pa.struct([("place", pa.int32()), ("beside", pa.list_(pa.string()))]))


def _pass_down(table: pa.Table, witnesses: list[list[Step]], top: dict) -> pa.Table:
    n = table.num_rows
    return pa.table(
        {
            "key": table["key"],
            "block": table["pos"],
            "witness": pa.array(_as_rows(witnesses), STEPS),
            "subroot": pa.array([top["subroot"]] * n, pa.string()),
            "root": pa.array([top["root"]] * n, pa.string()),
        }
    )


def _finish(with_witness: bool):
    def run(table: pa.Table, witnesses: list[list[Step]], top: dict) -> pa.Table:
        n = table.num_rows
        shown = table["shown"].to_pylist()
        folded = [fold(leaf, w) for leaf, w in zip(shown, witnesses, strict=True)]
        out = {
            "key": table["key"],
            "doc_id": table["doc_id"],
            "leaf": table["node"],
            "subroot": pa.array([top["subroot"]] * n, pa.string()),
            "root": pa.array([top["root"]] * n, pa.string()),
            "proof_sha256": [digest(d for _, beside in w for d in beside) for w in witnesses],
            "folded_root": folded,
            "verified": [f == top["root"] for f in folded],
        }
        if with_witness:
            out["witness"] = pa.array(_as_rows(witnesses), STEPS)
        return pa.table(out)

    return run


RESULT = "key string, doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    group: str = "lang",
    order: str = "doc_id",
    shown: Sequence[str | Column] | None = None,
    arity: int = ARITY,
    height: int = HEIGHT,
    with_witness: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id (the order column), leaf, subroot, root, proof_sha256, folded_root and verified.

    ``columns`` make the leaf.  ``shown`` are the values that a holder of the data presents (the same ones if not given): the
    hash of those is folded with the witness of the original leaf and compared with the root.  ``with_witness`` adds the
    witness itself.  A null value is a dash in the leaf; a null group is a group of its own and comes first; a null id comes first
    in its group.  Empty and long texts are hashed whole.  Rows of one id are ordered by their leaf, so repeated rows change
    nothing but the number of leaves.  An empty table gives an empty result, further columns are ignored.
    """
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("key"),
        F.col(order).cast("long").alias("doc_id"),
        leaf_digest(columns).alias("node"),
        (leaf_digest(shown) if shown else leaf_digest(columns)).alias("shown"),
    )
    leaves = positions(leaves, "key", ["doc_id", "node"])
    rounds, subroots = _climb(leaves, arity, height)

    # The tree over the groups: its leaves are the subroots, in the order of their groups.
    tops = positions(subroots.select(F.lit("").alias("key"), F.col("key").alias("name"), "node"), "key", ["name"])
    top_rounds, root = _climb(tops, arity, height)
    above = root.select("key", F.lit(0).cast("long").alias("block"), F.expr(f"cast(array() as {WITNESS})").alias("witness"), F.col("node").alias("root"))
    above = above.withColumn("subroot", F.lit(None).cast("string"))
    schema = f"key string, block long, {ABOVE}"
    for nodes in reversed(top_rounds):
        above = _witnesses(nodes, above, arity, height, _pass_down, schema)
    above = tops.alias("t").join(above.alias("a"), F.col("t.pos") == F.col("a.block"))
    above = above.select(F.col("t.name").alias("key"), F.lit(0).cast("long").alias("block"), "witness", F.col("t.node").alias("subroot"), "root")

    for nodes in reversed(rounds[1:]):
        above = _witnesses(nodes, above, arity, height, _pass_down, schema)
    result = RESULT + (f", witness {WITNESS}" if with_witness else "")
    return _witnesses(leaves, above, arity, height, _finish(with_witness), result)


def tampered(text: str = "text") -> Column:
    """A third of the texts, by the id's checksum, with A-Z in lower case."""
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    return F.when(chosen, lowered).otherwise(F.col(text))
