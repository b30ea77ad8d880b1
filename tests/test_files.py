"""Subtitle files: cuts at any byte, folders with equal names, commits, replaced and failed writes, streams."""

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from timedframe.sources import captions as cap
from timedframe.sources import files as fl
from timedframe.sources import transcripts as tr

BODY = "\n \n1\r\n00:00:01,000 --> 00:00:02,000\r\nHello\r\nyou\r\n\r\n\t\r\n2\n00:00:02,000 --> 00:00:03,500\nÄß\n\n" + "x" * 30 + "\n\n\n3\n00:00:04,000 --> 00:00:05,000\nlast"


@pytest.mark.parametrize("width", [1, 2, 7, 33, 1000])
def test_every_block_is_in_one_cut(tmp_path, width):
    p = tmp_path / "a.srt"
    raw = BODY.encode()
    p.write_bytes(raw)
    whole, parts = [], []
    with pafs.LocalFileSystem().open_input_file(str(p)) as f:
        whole = list(fl.chunks(f, 0, len(raw), 1))
        for a in range(0, len(raw), width):
            parts += fl.chunks(f, a, min(a + width, len(raw)), 1)
    assert parts == whole and len(whole) == 4
    assert [raw[a : a + len(t)] for a, t in whole] == [t for _, t in whole]


def cues(spark, rows):
    return spark.createDataFrame(rows, "media_id string, start double, end double, line string")


def seen(df):
    return sorted((r.media_id, r.start, r.end, r.text) for r in df.collect())


def test_round_trip_keeps_ids(spark, tmp_path):
    ids = ["a/x", "b/x", "x", "..", "a//b", "", "a/", "50%", "ü v.w", "x.srt"]
    rows = [(m, float(i), i + 0.5, f"line {i} of ({m})") for m in ids for i in range(5)]
    root = str(tmp_path / "out")
    cap.write_srt(cues(spark, rows), root, ["start"])
    assert seen(cap.read_srt(spark, root)) == sorted(rows)


def test_long_media_spreads_and_keeps_its_order(spark, tmp_path):
    rows = [("long", float(i), i + 0.5, f"{i}") for i in range(2000)]
    root = str(tmp_path / "out")
    cap.write_srt(cues(spark, rows).repartition(4), root, ["start"])
    back = fl.read_blocks(spark, root, partition_bytes=5000)
    assert back.rdd.getNumPartitions() > 3
    got = cap.parse_srt(back).orderBy("part", "at", "block").collect()
    assert [r.text for r in got] == [r[3] for r in rows]


def test_only_committed_files_count(spark, tmp_path):
    root = tmp_path / "out"
    cap.write_srt(cues(spark, [("a", 0.0, 1.0, "one")]), str(root), ["start"])
    left = root / ("t-00000-" + "0" * 32)
    left.mkdir()
    (left / "a.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\nleft over\n\n")
    (root / "folder").mkdir()
    (root / "folder" / "b.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\nby hand\n\n")
    assert seen(cap.read_srt(spark, str(root))) == [("a", 0.0, 1.0, "one"), ("folder/b", 0.0, 1.0, "by hand")]
    bad = cues(spark, [("c", 0.0, 1.0, "x"), (None, 0.0, 1.0, "y")])
    with pytest.raises(Exception, match="without media_id"):
        cap.write_srt(bad, str(root), ["start"])
    assert len(fl.commits(*fl.opened(str(root)))) == 1
    cap.write_srt(cues(spark, [("a", 2.0, 3.0, "two")]), str(root), ["start"], "overwrite")
    assert seen(cap.read_srt(spark, str(root / "folder" / "b.srt"))) == [("b", 0.0, 1.0, "by hand")]
    assert seen(cap.read_srt(spark, str(root)).filter("media_id = 'a'")) == [("a", 2.0, 3.0, "two")]


def test_stream_reads_each_commit_once(spark, tmp_path):
    root, point = str(tmp_path / "out"), str(tmp_path / "point")

    def run():
        got = cap.read_srt(spark, root, stream=True).writeStream.format("parquet").option("path", str(tmp_path / "seen")).option("checkpointLocation", point)
        got.trigger(availableNow=True).start().awaitTermination(120)
        return seen(spark.read.parquet(str(tmp_path / "seen")))

    cap.write_srt(cues(spark, [("a", 0.0, 1.0, "one"), ("b", 0.0, 1.0, "two")]), root, ["start"])
    first = [("a", 0.0, 1.0, "one"), ("b", 0.0, 1.0, "two")]
    assert run() == first
    cap.write_srt(cues(spark, [("a", 1.0, 2.0, "three")]), root, ["start"])
    assert run() == sorted([*first, ("a", 1.0, 2.0, "three")])
    assert run() == sorted([*first, ("a", 1.0, 2.0, "three")])


def test_empty(spark, tmp_path):
    root = str(tmp_path / "none")
    assert cap.read_srt(spark, root).count() == 0
    cap.write_srt(cues(spark, []), root, ["start"])
    assert cap.read_srt(spark, root).count() == 0


def test_transcripts_are_named_by_their_path(spark, tmp_path):
    for folder in ("a b", "c+d"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.json").write_text('{"language": "en", "segments": [{"id": 0, "start": 0, "end": 1, "text": "%s"}]}' % folder)
    for path in (f"{tmp_path}/*/x.json", f"{tmp_path}/*"):
        _, rows = tr.read_transcripts(spark, path)
        assert sorted(map(tuple, rows.select("media_id", "text").collect())) == [("a b/x", "a b"), ("c+d/x", "c+d")]
    assert tr.read_transcripts(spark, f"{tmp_path}/c+d/x.json")[1].select(F.first("media_id")).first()[0] == "x"


def test_small_files_are_read_as_blocks_are(tmp_path):
    import pyarrow.fs as pafs

    texts = [b"", b"\n \n", b" \t", b"1\na\n\n\n2\nb", b"\r\n \r\n1\r\na\r\n\r\n", b"x\n\n", b" x", b"\n\n  x \n \n"]
    fs = pafs.LocalFileSystem()
    for i, raw in enumerate(texts):
        path = tmp_path / f"{i}.srt"
        path.write_bytes(raw)
        with fs.open_input_file(str(path)) as f, fs.open_input_file(str(path)) as g:
            assert list(fl.small_file(f, len(raw))) == list(fl.chunks(g, 0, len(raw)))


def test_many_small_files_make_few_tasks():
    small = [(f"m{i}", 0, f"/m{i}.srt", 3000) for i in range(4000)]
    assert len(fl.bins(small, fl.PARTITION_BYTES)) == 4


def test_small_media_are_written_without_a_sample(spark, tmp_path):
    cues = spark.range(300).selectExpr("concat('m/', id % 7) AS media_id", "id AS seg_id", "CAST(id AS double) AS start", "id + 0.5D AS end", "concat('t', id) AS line")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("write"))
    seen = {}
    for bounded in (None, True):
        spark.sparkContext.setJobGroup("write", "write")
        before, path = jobs(), str(tmp_path / str(bounded))
        cap.write_srt(cues, path, ["seg_id"], bounded=bounded)
        made = jobs() - before
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        seen[bounded] = made, sorted(map(tuple, cap.read_srt(spark, path).select("media_id", "start", "end", "text").collect()))
    assert seen[True][1] == seen[None][1] and len(seen[True][1]) == 300
    assert seen[True][0] < seen[None][0]
