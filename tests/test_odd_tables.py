"""Registered queries against their SQL on tables with ties, large keys and half cents."""

from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from timedframe import fixtures
from timedframe.operators import formats as fm
from timedframe.functions import scalars as sc
from tools.check_oracles import normal

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
PARTS = "/root/testdata/sf0.01/part.parquet"
T0 = datetime(2024, 1, 1)
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def same_as_sql(spark, name, folder):
    """Rows of a query over the tables of a folder, after they are found equal to those of its SQL."""
    db = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    rel = db.execute(entry.oracle_sql()[name])
    want = normal([d[0] for d in rel.description], rel.fetchall())
    df = entry.queries()[name](spark, str(folder))
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    assert got == want and got[1]
    return got[1]


def write_events(folder, rows):
    """Events (event_id, seconds after the start, user_id, event_type, value) as one file."""
    db = duckdb.connect()
    db.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    db.executemany("insert into events values (?, ?, ?, ?, ?, ?)", [(i, T0 + timedelta(seconds=t), u, kind, v, '{"k": 1}') for i, t, u, kind, v in rows])
    db.execute(f"copy events to '{folder}/events.parquet'")


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """Twenty copies of the parts under shifted keys: many formats of a media share height and bitrate, and each media has a pair."""
    folder = tmp_path_factory.mktemp("parts")
    duckdb.sql(f"copy (select p.* replace (p_partkey + i * 2000 as p_partkey) from '{PARTS}' p, range(20) r(i)) to '{folder}/part.parquet'")
    return folder


@needs_data
@pytest.mark.parametrize("name", ["sr1_rank_formats", "sr4_select_best", "sr4_select_worst_video", "sr5_alternatives", "jn16_merge_formats"])
def test_formats_with_ties(spark, parts, name):
    same_as_sql(spark, name, parts)


@needs_data
def test_chosen_formats_with_ties(spark, parts):
    same_as_sql(spark, "pl3_choose_formats", parts)


def test_rank_without_defaults(spark):
    """The default order tells equal heights apart by frame rate; without it source order does."""
    rows = spark.createDataFrame([(1, 1, "avc1", "opus", 720, 60.0), (1, 2, "avc1", "opus", 720, 30.0)], "media_id long, format_idx long, vcodec string, acodec string, height int, fps double")
    rows = rows.withColumn("format_id", F.col("format_idx").cast("string"))
    rank = lambda **more: [r.format_idx for r in fm.rank_formats(rows, ["height"], **more).sort("rank").collect()]
    assert rank() == [2, 1] and rank(defaults=False) == [1, 2]


@needs_data
def test_format_numbers_of_large_keys(spark, tmp_path):
    duckdb.sql(f"copy (select o.* replace (o_orderkey + i * 400000 as o_orderkey) from '{SF}/orders.parquet' o, range(4) r(i)) to '{tmp_path}/orders.parquet'")
    same_as_sql(spark, "sc14_format_numbers", tmp_path)
    one = spark.range(1).select(fm.format_bytes(F.lit(2**41)), fm.format_bytes(F.lit(2**41), "Gi"), sc.decimal_suffix(F.lit(2 * 10**12)), sc.decimal_suffix(F.lit(2 * 10**12), "G")).first()
    assert tuple(one) == ("2.00TiB", "2048.00GiB", "2T", "2000G")


def test_sponsor_segments_of_half_cents(spark, tmp_path):
    rows = [(0, 0, 1, "view", 30.0)] + [(4 * i + 2, 1.005 + 7.13 * i, 1, "click", 0.01 * i) for i in range(400)]
    write_events(tmp_path, rows)
    same_as_sql(spark, "wn17_clean_sponsor_segments", tmp_path)


def test_rate_violations_of_one_instant(spark, tmp_path, grouping):
    """Seven requests of one instant see each other, and so does the first that comes a window later less a microsecond."""
    rows = [(i, 10, 1, "view", 1.0) for i in range(7)] + [(10, 3609.999999, 1, "view", 1.0), (11, 3610, 1, "view", 1.0), (12, 10, 1, "click", 1.0)]
    write_events(tmp_path, rows)
    got = same_as_sql(spark, "st6_rate_violations", tmp_path)
    assert len(got) == 8


@needs_data
def test_text_tables_take_more_tasks_as_they_grow(spark, monkeypatch):
    tasks = lambda: fixtures.text_table(spark, SF, "documents", "doc_id").rdd.getNumPartitions()
    assert tasks() == 4
    size = Path(SF, "documents.parquet").stat().st_size
    monkeypatch.setattr(fixtures, "TEXT_TASK_BYTES", size // 9)
    assert tasks() in (9, 10)
