"""Side tables that repeat a key, exact sums after loud passages, and plans that start no job."""

import math

import pytest

from timedframe.operators import catalog, corpus, intervals, jobs, lookups, ordered
from timedframe.registry import all_queries


def test_last_side_row_counts(spark):
    segments = spark.createDataFrame([(1, 1, "a", 0.0, 1.0, None), (1, 2, "b", 1.0, 2.0, "x")], "media_id int, seg_id int, text string, start double, end double, speaker string")
    windows = spark.createDataFrame([(1, 1, 5.0, 6.0, 1), (1, 1, 3.0, 4.0, 2)], "media_id int, seg_id int, start double, end double, edit int")
    assert sorted((r.seg_id, r.start) for r in lookups.apply_windows(segments, windows, "edit").collect()) == [(1, 3.0), (2, 1.0)]
    assert sorted((r.seg_id, r.start) for r in lookups.apply_windows(segments, windows.drop("edit")).collect()) == [(1, 5.0), (2, 1.0)]
    texts = spark.createDataFrame([(1, 1, "old", 1), (1, 1, "new", 2), (1, 2, "c", 1), (1, 2, " ", 2)], "media_id int, seg_id int, text string, edit int")
    found = lookups.apply_revisions(segments, texts, "English", order="edit").collect()
    assert sorted((r.seg_id, r.text, r.review) for r in found) == [(1, "new", "accepted"), (2, "b", None)]
    tags = spark.createDataFrame([(1, 1, "p", 1), (1, 1, "q", 2), (1, 1, " ", 3), (1, 2, "r", 1)], "media_id int, seg_id int, speaker string, edit int")
    assert sorted((r.seg_id, r.speaker) for r in lookups.apply_speaker_tags(segments, tags, "edit").collect()) == [(1, "q"), (2, "r")]


def test_other_side_tables(spark):
    presets = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "name string, text string")
    new = spark.createDataFrame([("b", "4"), ("b", "5"), ("c", "6")], "name string, text string")
    assert sorted((r.name, r.text) for r in corpus.upsert_presets(presets, new, "b").collect()) == [("a", "2"), ("b", "5"), ("c", "6")]
    merged = catalog.merge_records(presets.withColumnRenamed("text", "x"), new.withColumnRenamed("text", "y"), ["name"]).collect()
    assert sorted((r.name, r.x, r.y) for r in merged) == [("a", "2", None), ("b", "3", "5"), ("c", None, "6")]
    items = spark.createDataFrame([(1, "reuse", "a", "j", None, None, None, 1.0), (2, "library", "a", None, "p", "t", None, 1.0)], "id int, type string, side string, ref_job string, music_project string, music_track string, ref string, duration double")
    outputs = spark.createDataFrame([("j", "/1"), ("j", "/2")], "job_id string, path string")
    tracks = spark.createDataFrame([("p", "t"), ("p", "t")], "project string, track string")
    assert sorted((r.id, r.source) for r in jobs.resolve_items(items, outputs, tracks).collect()) == [(1, "/2"), (2, "/music/p/t")]


def test_quiet_window_after_a_loud_past(spark, grouping):
    rows = [(1, i, 3e4 if i < 5000 else 2e-3, 3e4 if i < 5000 else 1e-3) for i in range(5200)]
    signal = spark.createDataFrame(rows, "series_id int, t_idx int, background double, voice double")
    windows = spark.createDataFrame([(1, 1, 5050, 5150), (1, 2, 10, 20), (1, 3, 4990, 5010)], "series_id int, seg_id int, start_i int, end_i int")
    found = {r.seg_id: r for r in intervals.window_gain(signal, windows).collect()}
    assert math.isclose(found[1].bg_rms, 2e-3, rel_tol=1e-9) and math.isclose(found[1].voice_rms, 1e-3, rel_tol=1e-9)
    assert found[1].gain == pytest.approx(2.0) and found[2].gain == 1.0
    assert math.isclose(found[3].bg_rms, math.sqrt((9e8 + 4e-6) / 2), rel_tol=1e-9)


def jobs_of(spark, build):
    """Jobs that start while a plan is built, without those that read a table's schema."""
    tracker, group = spark.sparkContext.statusTracker(), f"plan-{id(build)}"
    spark.sparkContext.setJobGroup(group, "plan")
    try:
        build()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return sum(not s.name.startswith("parquet at") for s in stages)


@pytest.mark.parametrize("name", ["wn1_estimate_timeline", "wn2_cascade", "pl1_cue_report", "wn23_autonumber", "ag15_window_gain", "jn9_assign_voices"])
def test_plans_over_small_tables_start_no_job(spark, name):
    assert jobs_of(spark, lambda: all_queries()[name](spark, "/root/testdata/sf0.001")) == 0


def test_large_tables_are_measured_once(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROW_BYTES", 0)
    table = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert jobs_of(spark, lambda: ordered.number_rows(table, ["o_custkey"], ["o_orderkey"], "n")) >= 1


def test_glossary_of_any_term_length(spark, grouping):
    import random

    rng = random.Random(3)
    lines = [(m, i, "".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 90)))) for m in range(6) for i in range(40)]
    joined = {m: "".join(t for k, _, t in lines if k == m) for m in range(6)}
    terms = {"a", "é", "zz", "ab", "q"} | {joined[rng.randrange(6)][p : p + n] for n in range(1, 70) for p in (rng.randrange(400),)} | {"ab" * 40}
    segments = spark.createDataFrame(lines, "media_id int, seg_id int, text string")
    found = lookups.match_glossary(segments, spark.createDataFrame([(t, t.upper()) for t in terms], "source string, target string")).collect()
    assert sorted((r.media_id, r.source, r.target) for r in found) == sorted((m, t, t.upper()) for m, text in joined.items() for t in terms if t and t in text)
    none = spark.createDataFrame([], "source string, target string")
    assert lookups.match_glossary(segments, none).count() == 0


def test_glossary_terms_alike_and_a_full_filter(spark, monkeypatch):
    from timedframe.functions import grams

    monkeypatch.setattr(grams, "MOST_BITS", 15)
    monkeypatch.setattr(grams, "FLUSH_ROWS", 3)
    start = "the same long beginning of many \U0001f600 terms, "
    terms = [f"{start}{i}" for i in range(3000)] + [start + "x" * 900, "\U0001f600", "\U0001f600\U0001f600"]
    lines = [(1, 0, f"so {start}"), (1, 1, "17 and"), (2, 0, "\U0001f600"), (2, 1, "\U0001f600" + start + "x" * 450), (2, 2, "x" * 449 + "y"), (3, 0, None), (3, 1, "")]
    joined = {m: "".join(t or "" for k, _, t in lines if k == m) for m in (1, 2, 3)}
    found = lookups.match_glossary(
        spark.createDataFrame(lines, "media_id long, seg_id int, text string"), spark.createDataFrame([(t, "t") for t in terms] * 2, "source string, target string")
    ).collect()
    assert sorted((r.media_id, r.source) for r in found) == sorted((m, t) for m, text in joined.items() for t in terms if t in text)


def test_corpus_lines_with_bars_come_back(spark):
    from timedframe.sources import transcripts as tr

    rows = [("a", "plain", [1, 2]), ("b", "one|two", None), ("c", "ends|[1,2]", None), ("d", "ends|", None), ("e", "x|y|z", []), ("f", "|", [3]), ("g", "a|[1, -2]|b", None)]
    df = spark.createDataFrame(rows, "filename string, text string, codes array<int>")
    assert sorted(map(tuple, tr.parse_corpus(tr.corpus_lines(df)).collect())) == sorted(rows)
    bare = df.filter("codes is null").drop("codes")
    assert sorted(tuple(r)[:2] for r in tr.parse_corpus(tr.corpus_lines(bare)).collect()) == sorted(r[:2] for r in rows if r[2] is None)
    assert tr.parse_corpus(spark.createDataFrame([("no bar",), ("",)], "value string")).count() == 0


def test_pairs_of_a_growing_table_take_more_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from timedframe.operators import lookups, ordered

    seg = spark.range(40).select((F.col("id") % 5).alias("media_id"), F.col("id").alias("seg_id"), F.concat(F.lit(" Ann met Bo "), F.col("id")).alias("text"))
    pairs = spark.createDataFrame([("Ann-Bo", "n"), ("Ann-Bo", "n"), ("Bo-Bo", "m"), ("Ann-Cy", "x")], "pair string, note string")
    out = lookups.match_pairs(seg, pairs)
    assert sorted(map(tuple, out.collect())) == sorted((m, p, n) for m in range(5) for p, n in (("Ann-Bo", "n"), ("Bo-Bo", "m")))
    assert out.rdd.getNumPartitions() == 4
    monkeypatch.setattr(ordered, "TASK_BYTES", max(1, ordered.input_bytes(seg) // 9))
    assert lookups.match_pairs(seg, pairs).rdd.getNumPartitions() in (9, 10)
