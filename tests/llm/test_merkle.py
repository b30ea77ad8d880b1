"""The manifest against plain Python: leaves, roots, proofs, tampering, and witnesses of a growing tree."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from timedframe.llm import merkle, registry

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, lower=False):
    def part(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    text = row.text.translate(A_TO_Z) if lower and row.text is not None else row.text
    return sha("".join(map(part, (row.doc_id, row.source, row.lang, row.n_chars, text))))


def paths(nodes, arity=8):
    """Root of a list of digests, and for each of them the list of (place, others) up to it."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a // arity * arity : a // arity * arity + arity]
            steps[i].append((a % arity, run[: a % arity] + run[a % arity + 1 :]))
        at = [a // arity for a in at]
        nodes = [sha("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
    return nodes[0], steps


def folded(leaf, steps):
    for place, others in steps:
        leaf = sha("".join(others[:place] + [leaf] + others[place:]))
    return leaf


def expected(rows, arity=8):
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    of_lang, subroots = {}, []
    for lang in langs:
        own = sorted(groups[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r)))
        subroot, steps = paths([leaf_of(r) for r in own], arity)
        subroots.append(subroot)
        of_lang[lang] = own, steps
    root, tops = paths(subroots, arity)
    out = []
    for lang, subroot, top in zip(langs, subroots, tops):
        for r, steps in zip(*of_lang[lang]):
            whole = steps + top
            tampered = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 0
            end = folded(leaf_of(r, tampered), whole)
            out.append((r.doc_id, leaf_of(r), subroot, root, sha("".join(d for _, o in whole for d in o)), end, end == root))
    return out


def by_text(rows):
    return sorted(map(repr, rows))


def found(df):
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()]


def shown(df):
    return ["doc_id", "source", "lang", "n_chars", merkle.tampered()]


def test_query(shared, sf, documents):
    rows = found(registry.op11_merkle(shared, sf))
    assert by_text(rows) == by_text(expected(documents.collect()))
    changed = [r for r in documents.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text != r.text.translate(A_TO_Z)]
    assert sum(not r[-1] for r in rows) == len(changed) > 0


@pytest.mark.parametrize("arity,height", [(2, 1), (2, 3), (3, 2), (8, 1)])
def test_block_sizes_change_nothing(shared, documents, arity, height):
    rows = found(merkle.manifest(documents, shown=shown(documents), arity=arity, height=height))
    assert by_text(rows) == by_text(expected(documents.collect(), arity))


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 513])
def test_one_group_of_each_size(shared, n):
    docs = shared.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("l").alias("lang"), F.lit(1).alias("n_chars"), F.lit("T").alias("text"))
    rows = found(merkle.manifest(docs, shown=shown(docs), height=1))
    assert by_text(rows) == by_text(expected(docs.collect()))
    if n == 1:
        assert rows[0][1] == rows[0][2] == rows[0][3] and rows[0][4] == sha("")


def test_many_groups(shared):
    docs = shared.range(300).select(
        F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.when(F.col("id") % 40 > 0, F.concat(F.lit("ß"), F.col("id") % 40)).alias("lang"),
        F.lit(1).alias("n_chars"), F.lit("Text").alias("text"))
    assert by_text(found(merkle.manifest(docs, shown=shown(docs), height=1))) == by_text(expected(docs.collect()))


def test_witnesses_grow_with_later_appends():
    leaves = [sha(str(i)) for i in range(150)]
    tree = merkle.Appender()
    witnesses = []
    for n, leaf in enumerate(leaves, 1):
        witnesses.append(tree.append(leaf))
        # What is attached so far is the beginning of the final witness: whole runs only.
        assert all(len(beside) == 7 for w in witnesses for _, beside in w)
        assert len(witnesses[0]) == (0 if n < 8 else 1 if n < 64 else 2)
    root = tree.close()
    assert (root, witnesses) == paths(leaves)
    assert all(merkle.fold(leaf, w) == root for leaf, w in zip(leaves, witnesses))
    assert merkle.fold(leaves[1], witnesses[0]) != root


def test_kept_witness_leads_to_the_root(shared, documents):
    rows = merkle.manifest(documents, with_witness=True).collect()
    for r in rows[:50]:
        assert merkle.fold(r.leaf, [(s.place, s.beside) for s in r.witness]) == r.root
    assert all(r.verified for r in rows)


def test_awkward_rows(awkward, nothing):
    docs = awkward.withColumn("root", F.lit("clash")).withColumn("pos", F.lit(1)).withColumn("key", F.lit(2))
    rows = found(merkle.manifest(docs, shown=shown(docs)))
    assert by_text(rows) == by_text(expected(awkward.collect()))
    assert merkle.manifest(nothing).count() == 0
