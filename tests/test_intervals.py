import random

import pytest
from timedframe.operators import intervals as iv

IV = "media_id long, kind string, start_time double, end_time double, title string, category string, remove boolean"


def chap(m, s, e, t):
    return (m, "chapter", float(s), float(e), t, None, False)


def spon(m, s, e, c, remove=False):
    return (m, "sponsor", float(s), float(e), c.title(), c, remove)


def cut(m, s, e):
    return (m, "cut", float(s), float(e), "cut", "manually_removed", True)


def run(spark, cases, fold=False):
    """All cases in one job, each as a media of its own."""
    data = [(m, *r[1:]) for m, (rows, _) in enumerate(cases.values()) for r in rows]
    pieces = iv.overlay_intervals(spark.createDataFrame(data, IV).repartition(3))
    if fold:
        rows = [(r.media_id, r.chapter, r.start_time, r.end_time, r.title) for r in iv.fold_tiny(pieces).collect()]
    else:
        rows = [(r.media_id, r.piece, r.start_time, r.end_time, r.title if r.cats is None else "+".join(c.category for c in r.cats)) for r in pieces.collect()]
    return {name: [r[2:] for r in sorted(rows) if r[0] == m] for m, name in enumerate(cases)}


def wanted(cases):
    return {name: [(float(a), float(b), t) for a, b, t in want] for name, (_, want) in cases.items()}


CASES = {
    "no sponsors": ([chap(1, 0, 10, "a"), chap(1, 10, 20, "b")], [(0, 10, "a"), (10, 20, "b")]),
    "sponsor inside a chapter": ([chap(1, 0, 30, "a"), spon(1, 10, 20, "ad")], [(0, 10, "a"), (10, 20, "ad"), (20, 30, "a")]),
    "sponsor over a border": ([chap(1, 0, 10, "a"), chap(1, 10, 20, "b"), spon(1, 5, 15, "ad")], [(0, 5, "a"), (5, 15, "ad"), (15, 20, "b")]),
    "overlapping sponsors": ([chap(1, 0, 40, "a"), spon(1, 5, 20, "ad"), spon(1, 10, 30, "intro")], [(0, 5, "a"), (5, 10, "ad"), (10, 20, "ad+intro"), (20, 30, "intro"), (30, 40, "a")]),
    "cut inside a chapter shortens it": ([chap(1, 0, 30, "a"), chap(1, 30, 40, "b"), cut(1, 10, 15)], [(0, 25, "a"), (25, 35, "b")]),
    "touching cuts over a border": ([chap(1, 0, 10, "a"), chap(1, 10, 20, "b"), cut(1, 5, 10), cut(1, 10, 12)], [(0, 5, "a"), (5, 13, "b")]),
    "cut inside a sponsor keeps it whole": ([chap(1, 0, 40, "a"), spon(1, 10, 30, "ad"), cut(1, 15, 20)], [(0, 10, "a"), (10, 25, "ad"), (25, 35, "a")]),
    "cut hides a chapter": ([chap(1, 0, 10, "a"), chap(1, 10, 20, "b"), cut(1, 9, 21)], [(0, 9, "a")]),
    "cut ends at a new sponsor set": ([chap(1, 0, 50, "a"), spon(1, 10, 30, "ad"), spon(1, 25, 40, "intro"), cut(1, 20, 30)], [(0, 10, "a"), (10, 20, "ad"), (20, 30, "intro"), (30, 40, "a")]),
    "removed sponsor is a cut": ([chap(1, 0, 20, "a"), spon(1, 5, 10, "ad", True)], [(0, 15, "a")]),
}


def test_overlay(spark, grouping):
    assert run(spark, CASES) == wanted(CASES)


AD = "[SponsorBlock]: Ad"
TINY = {
    "before a first sponsor": ([chap(1, 0, 30, "a"), spon(1, 0.5, 10, "ad")], [(0, 10, AD), (10, 30, "a")]),
    "rest of a chapter joins the next past a sponsor": ([chap(1, 0, 10, "a"), chap(1, 10, 20, "b"), spon(1, 5, 9.5, "ad")], [(0, 5, "a"), (5, 9.5, AD), (9.5, 20, "b")]),
    "tiny from the start stays": ([chap(1, 0, 10, "a"), chap(1, 10, 10.5, "b")], [(0, 10, "a"), (10, 10.5, "b")]),
    "tiny last piece joins the one before": ([chap(1, 0, 20, "a"), spon(1, 5, 19.5, "ad")], [(0, 5, "a"), (5, 20, AD)]),
    "sponsors of one name unite": ([chap(1, 0, 30, "a"), spon(1, 5, 10, "ad"), spon(1, 10, 15, "ad")], [(0, 5, "a"), (5, 15, AD), (15, 30, "a")]),
}


def test_fold_tiny(spark):
    assert run(spark, TINY, fold=True) == wanted(TINY)


def test_keep_ranges_and_cuts_tile_media(spark, grouping):
    r = random.Random(2)
    cuts = [(m, float(s), float(s + r.randint(1, 9))) for m in range(4) for s in r.sample(range(90), 12)]
    df = spark.createDataFrame(cuts, "media_id long, start_time double, end_time double")
    media = spark.createDataFrame([(m, 100.0) for m in range(4)], "media_id long, duration double")
    kept, merged = iv.keep_ranges(df, media).collect(), iv.merge_cuts(df).collect()
    for m in range(4):
        parts = sorted((x.start_time, x.end_time) for x in [*kept, *merged] if x.media_id == m)
        assert parts[0][0] == 0.0 and parts[-1][1] == 100.0
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and all(a < b for a, b in parts)


def test_overlap_ratio_against_pairs(spark, grouping):
    r = random.Random(4)
    w = [(m, i, float(s), float(s + r.choice([0, 3, 8]))) for m in range(2) for i, s in enumerate(r.sample(range(60), 10))]
    v = [(m, float(s), float(s + r.randint(0, 6))) for m in range(2) for s in r.sample(range(60), 12)]
    got = iv.overlap_ratio(
        spark.createDataFrame(w, "media_id long, seg_id long, start double, end double"), spark.createDataFrame(v, "media_id long, start_time double, end_time double")
    )
    for row in got.collect():
        over = sum(max(0.0, min(row.end, e) - max(row.start, s)) for m, s, e in v if m == row.media_id)
        want = min(1.0, over / (row.end - row.start)) if row.end > row.start else 0.0
        assert row.score == pytest.approx(want)


def test_chapters_from_text(spark):
    text = "intro words\n0:00 Start\n1:05 - Middle\n 1:02:03  End \nnothing 99:99:99x"
    other = "Start 0:10\nMiddle - 2:00\ntoo late 9:59:59"
    df = spark.createDataFrame([(1, text, 5000.0), (2, other, 300.0)], "media_id long, description string, duration double")
    got = [(r.media_id, r.start_time, r.title) for r in iv.chapters_from_text(df).orderBy("media_id", "idx").collect()]
    assert got == [(1, 0.0, "Start"), (1, 65.0, "Middle"), (1, 3723.0, "End"), (2, 10.0, "Start"), (2, 120.0, "Middle")]


def test_sponsor_whole_video_option(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, "ad", 10.0, 10.0)], "media_id long, start_time double, end_time double, category string, duration double, video_duration double")
    assert iv.clean_sponsor_segments(df).count() == 1 and iv.clean_sponsor_segments(df, drop_whole=True).count() == 0


def test_overlay_gets_more_tasks_as_its_table_grows(spark, monkeypatch):
    """What a task holds follows from the stored bytes per task, not from Spark's fixed number of partitions."""
    from timedframe.operators import ordered

    monkeypatch.setattr(ordered, "TASK_BYTES", 512)
    rows = [(m, "chapter", float(10 * i), float(10 * i + 10), f"c{i}", None, i % 7 == 0) for m in range(40) for i in range(10)]
    df = spark.createDataFrame(rows, "media_id long, kind string, start_time double, end_time double, title string, category string, remove boolean")
    pieces = iv.overlay_intervals(df)
    assert pieces.rdd.getNumPartitions() > 4
    assert iv.fold_tiny(pieces).rdd.getNumPartitions() > 4
    assert pieces.count() == 40 * 8
