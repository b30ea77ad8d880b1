"""The registered queries against DuckDB on the smallest data folder (set FULL=1 for all of them)."""

import os
from pathlib import Path

import duckdb
import pytest

from tools.check_oracles import TABLES, normal

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = [
    "wn2_cascade", "wn6_split_sentences", "jn4_match_glossary", "st1_job_state", "st6_rate_violations", "fl1_match_filter", "fl4_screen_entries", "sr6_playlist_items",
    "sr1_rank_formats", "jn16_merge_formats", "wn19_remap_chapters", "wn22_keep_ranges", "ag15_window_gain", "sc15_normalize_media", "sc22_clean_html", "cr4_pack_training_rows", "io10_parse_webvtt", "pl2_screen_playlist",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("FULL") else SOME

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    rel = db.execute(entry.oracle_sql()[name])
    want = normal([d[0] for d in rel.description], rel.fetchall())
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["media_id", "seg_id", "cue", "start", "end", "line"] and df.count() > 0
