"""Costly texts are made and searched once per row (findings of round 3)."""

import random

from pyspark.sql import functions as F

from timedframe.operators import corpus as cp
from timedframe.operators import intervals as iv
from timedframe.operators.corpus import balanced_chunks
from timedframe.sources.transcripts import parse_corpus


def counted(spark, df, column):
    """``df`` with a column that counts how often a row of it is made."""
    calls = spark.sparkContext.accumulator(0)

    def seen(text):
        calls.add(1)
        return text

    return df.withColumn(column, F.udf(seen, "string")(column)), calls


def test_parse_corpus_makes_a_line_once(spark):
    """F17, F22."""
    df, calls = counted(spark, spark.createDataFrame([("a|b|[1,2]",), ("a|b|c",), ("none",), (None,), ("x|y|",)], "value string"), "value")
    got = [tuple(r) for r in parse_corpus(df).collect()]
    assert sorted(got, key=str) == [("a", "b", [1, 2]), ("a", "b|c", None), ("x", "y", None)]
    assert calls.value == 5


def test_chapters_are_searched_once_per_pattern(spark):
    """the second pattern is searched where the first found nothing, and numbering reads what was found."""
    data = [(1, "0:00 - a\n1:00 - b", 100.0), (2, "c - 0:05", 100.0), (3, "nothing", 100.0), (4, None, 100.0), (5, "9:00 - late", 100.0)]
    df, calls = counted(spark, spark.createDataFrame(data, "media_id long, description string, duration double"), "description")
    got = [(r.media_id, r.start_time, r.title) for r in iv.chapters_from_text(df).orderBy("media_id", "idx").collect()]
    assert got == [(1, 0.0, "a"), (1, 60.0, "b"), (2, 5.0, "c")]
    assert calls.value <= 10  # all for the first pattern, the others for the second


def test_pack_training_rows_by_slices(spark):
    """labels and mask equal a plain loop, nulls and pads among the ids included, and labels need no function per token."""
    r = random.Random(3)
    rows = [(i, [r.choice([0, 1, 5, 6, 7, None]) for _ in range(r.randrange(0, 14))]) for i in range(60)] + [(60, None), (61, [])]
    df = spark.createDataFrame(rows, "id long, ids array<int>")
    for pad in (0, 5):
        out = cp.pack_training_rows(df, 8, pad, 1)
        for row in out.collect():
            if row.ids is None:
                assert row.input_ids is None and row.labels is None and row.attention_mask is None
                continue
            want = (row.ids + [pad] * 8)[:8] if len(row.ids) < 8 else row.ids[:8]
            at = want.index(1) if 1 in want else 8
            assert row.input_ids == want
            assert row.labels == [-100] * at + want[at:]
            assert row.attention_mask == [0 if x is None or x == pad else 1 for x in want]
        assert out.select("labels")._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction") == 0


def test_chunk_balanced_gives_out_chunks_as_it_goes(spark, monkeypatch):
    """what a task holds is bounded by characters, and chunks stay the same."""
    df = spark.createDataFrame([(0, "x")], "k long, text string")
    sizes = []
    whole = cp.pd.DataFrame

    def frame(rows, columns):
        sizes.append(len(rows))
        return whole(rows, columns=columns)

    monkeypatch.setattr(cp.pd, "DataFrame", frame)
    texts = [("Hello there, my friend. " * 30).strip() for _ in range(8)]
    pdf = whole({"k": list(range(8)), "_t": texts})
    caught = {}
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, schema: caught.update(f=f))
    monkeypatch.setattr(cp, "FLUSH_CHARS", 1000)
    cp.chunk_balanced(df, "k")
    got = [c for part in caught["f"](iter([pdf])) for c in part["chunk"]]
    assert got == [c for t in texts for c, _ in balanced_chunks(t, cp.CHUNK_CHARS, cp.MIN_CHUNK_CHARS)]
    assert len(sizes) > 3 and max(sizes) < len(got)
