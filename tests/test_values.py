"""Texts of many spellings and the values that they stand for."""

import pytest
from pyspark.sql import functions as F

from timedframe.functions import filters
from timedframe.functions import scalars as sc

# Spellings in use and what they mean
DATES = {
    "December 21, 2010": 1292889600, "8/7/2009": 1247011200, "Dec 14, 2012": 1355443200, "2012/10/11 01:56:38 +0000": 1349920598,
    "1968 12 10": -33436800, "1968-12-10": -33436800, "28/01/2014 21:00:00 +0100": 1390939200, "Feb 14th 2016 5:45PM": 1455471900,
    "25-09-2014": 1411603200, "27.02.2016 17:30": 1456594200, "UNKNOWN DATE FORMAT": None, "May 16, 2016 11:15 PM": 1463440500,
    "Feb 7, 2016 at 6:35 pm": 1454870100, "2017-03-30T17:52:41Q": 1490896361, "Sep 11, 2013 | 5:49 AM": 1378878540,
    "December 15, 2017 at 7:49 am": 1513324140, "2018-03-14T08:32:43.1493874+00:00": 1521016363, "Sunday, 26 Nov 2006, 19:00": 1164567600,
    "wed, aug 16, 2008, 12:00pm": 1218931200, "December 31 1969 20:00:01 EDT": 1, "Wednesday 31 December 1969 18:01:26 MDT": 86,
    "31-07-2022 20:00": 1659297600, "July 15th, 2013": 1373846400, "September 1st, 2013": 1377993600, "Sep 2nd, 2013": 1378080000,
    "November 3rd, 2019": 1572739200, "October 23rd, 2005": 1130025600, "20240131": 1706659200, "20240131235959": 1706745599,
    "31/12/69": -86400, "1/1/24": 1704067200, "32/1/2024": None, "2024-02-30": None, "17:30 2/3/2024": 1709400600, "": None, None: None,
}
MONTH_FIRST = {"11/26/2014 11:30:00 AM PST": 1417001400, "2/2/2015 6:47:40 PM": 1422902860, "12/31/1969 20:01:18 EDT": 78}
DURATIONS = {
    "invalid": None, "1": 1, "1337:12": 80232, "9:12:43": 33163, "12:00": 720, "00:01:01": 61, "x:y": None, "3h11m53s": 11513, "3h 11m 53s": 11513,
    "3 hours 11 minutes 53 seconds": 11513, "3 hours 11 mins 53 secs": 11513, "3 hours, 11 minutes, 53 seconds": 11513, "62m45s": 3765, "49s": 49,
    "0h0m0s": 0, "0s": 0, "01:02:03.05": 3723.05, "T30M38S": 1838, "5 s": 5, "3 min": 180, "2.5 hours": 9000, "02:03:04": 7384, "01:02:03:04": 93784,
    "1 hour 3 minutes": 3780, "87 Min.": 5220, "PT1H0.040S": 3600.04, "PT00H03M30SZ": 210, "P0Y0M0DT0H4M20.880S": 260.88, "01:02:03:050": 3723.05,
    "103:050": 103.05, "1HR 3MIN": 3780, "2hrs 3mins": 7380, "1:234": 1.234, "P1DT2H": 93600, "3m 2h": None, "1.5s 2m": None, "12:": None,
    "1:2:3:4:5:6": None, "Z": None, "": None, None: None,
}
PODCASTS = {
    "https://www.podtrac.com/pts/redirect.mp3/chtbl.com/track/5899E/traffic.megaphone.fm/HSW7835899191.mp3": "https://traffic.megaphone.fm/HSW7835899191.mp3",
    "https://play.podtrac.com/npr-344098539/edge1.pod.npr.org/a/b.mp3": "https://edge1.pod.npr.org/a/b.mp3",
    "https://pdst.fm/e/2.gum.fm/chtbl.com/track/chrt.fm/track/34D33/pscrb.fm/rss/p/traffic.megaphone.fm/I.mp3?updated=1": "https://traffic.megaphone.fm/I.mp3?updated=1",
    "https://pdst.fm/e/https://mgln.ai/e/441/www.buzzsprout.com/1121972/1.mp3": "https://www.buzzsprout.com/1121972/1.mp3",
    "https://example.com/a.mp3": "https://example.com/a.mp3", None: None,
}
CALLS = {
    'cb ([ {"id":1}\n]\n);': '[ {"id":1}\n]\n', 'parse({"S":"OK"})\n\n//epc': '{"S":"OK"}', 'ping && ping({"S":"OK"});': '{"S":"OK"}',
    'window.cb && window.cb({"S":1});': '{"S":1}', '{"a": "(x)"}': '{"a": "(x)"}', "": "", None: None,
}


def check(spark, make, values):
    rows = [(k, None if v is None else str(v)) for k, v in values.items()]
    found = spark.createDataFrame(rows, "text string, wanted string").select("text", make(F.col("text")).alias("got")).collect()
    assert {r.text: r.got for r in found} == (pytest.approx(values) if any(isinstance(v, float) for v in values.values()) and None not in values.values() else values)


def test_dates(spark):
    check(spark, sc.unified_timestamp, DATES)
    check(spark, lambda c: sc.unified_timestamp(c, False), MONTH_FIRST)
    days = {k: None if v is None else v // 86400 for k, v in DATES.items() if k and "pm" not in k.lower() and "EDT" not in k and "MDT" not in k}
    check(spark, lambda c: F.unix_date(F.to_date(sc.unified_date(c), "yyyyMMdd")), {k: v for k, v in days.items() if k != "28/01/2014 21:00:00 +0100"})


def test_durations(spark):
    micro = {k: None if v is None else round(v * 1e6) for k, v in DURATIONS.items()}
    check(spark, lambda c: F.bround(sc.parse_duration(c) * 1e6).cast("long"), micro)


def test_addresses_calls_and_languages(spark):
    check(spark, sc.clean_podcast_url, PODCASTS)
    check(spark, sc.strip_jsonp, CALLS)
    check(spark, sc.long_language, {"ca": "cat", "bn": "ben", "en-US": "eng", "iw": "heb", "yo": "yor", "xx": None, None: None})
    check(spark, sc.short_language, {"cat": "ca", "heb": "he", "ind": "id", "yid": "yi", "hin": "hi", "qqq": None})
    assert len(sc.LANGUAGES) == 188


def test_filter_terms():
    term = lambda t: (x := filters.read_term(t, filters.MATCH_KEY)) and (x.key, x.negated, x.operator, x.unknown_passes, x.value)
    assert term(" title !*= ? 'a \\'b\\' c' ") == ("title", True, "*=", True, "a 'b' c")
    assert term("view_count>=?10k") == ("view_count", False, ">=", True, "10k")
    assert term("! is_live") == ("is_live", True, None, False, None)
    assert term('title = "a') == ("title", False, "=", False, '"a')
    for bad in ("", "!", "a <=", "!a = 1", "9 = 1", "a b"):
        with pytest.raises(ValueError):
            filters.read_term(bad, filters.MATCH_KEY)


def test_durations_in_filters_follow_the_column_grammar(spark):
    from timedframe.functions.filters import duration_literal
    from timedframe.functions.scalars import parse_duration

    texts = ["1:234", "1:02:03.5", "0:1:0:2:3", "1:2:3:4:5:6", "P1DT2H", "1h 5m", "5m 1h", "2.5 hours", "2.5h", "90 min", "45 min.", "3 weeks", "10.5s", "", "t", "x", "1..2 min", "07z"]
    rows = spark.createDataFrame([(t, duration_literal(t)) for t in texts], "t string, held double")
    assert [tuple(r) for r in rows.withColumn("c", parse_duration(F.col("t"))).filter("not (c <=> held)").collect()] == []


def test_marks_counts_and_sizes(spark):
    from timedframe.functions.scalars import parse_age, parse_bitrate, parse_count, parse_resolution
    from timedframe.operators.corpus import clean_punctuation

    one = lambda f, t: spark.range(1).select(f(F.lit(t)).alias("v")).first().v
    assert [one(clean_punctuation, t) for t in ("a,.. b ?! c ; d", "so ? ! yes", "3.14, ok;.", " , x", "..?")] == ["a. b ! c d", "so ! yes", "3.14, ok.", "x", "?"]
    assert [one(parse_count, t) for t in ("1.2M views", "views: 1,234", "12x", "3kk", "900")] == [1_200_000, 1234, None, 3_000_000, 900]
    assert [tuple(one(parse_resolution, t)) for t in ("at 1920 x 1080, 720p60", "720p60 4k", "4k", "x4k")] == [(1920, 1080, None), (None, 720, 60), (None, 2160, None), (None, None, None)]
    assert [one(parse_bitrate, t) for t in ("at 128 kbps", "v128kbps", "1kbps2")] == [128, None, 1]
    assert [one(parse_age, t) for t in ("18+", "tv_ma", "TV14", "pg-13", "-5", "100")] == [18, 17, 14, 13, None, None]


def test_strip_knows_the_white_space_of_patterns(spark):
    from timedframe.semantics import strip

    chars = spark.range(0x3100).filter("id NOT BETWEEN 55296 AND 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    text = chars.select(F.concat("c", F.lit("a \n b"), "c", F.lit("\r\n")).alias("t"))
    assert text.filter(~strip("t").eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
    plan = text.select(strip("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_corpus_report_reads_no_codes(spark):
    from timedframe.plans.media import build_speech_corpus

    lines = spark.createDataFrame([("a|One two.|[1,2]",), ("b|One two.|[3]",), ("c|No 1.",)], "value string")
    audio = spark.createDataFrame([("a", 5.0), ("c", 5.0)], "filename string, duration double")
    rows, report = build_speech_corpus(lines, audio, F.col("codes"), 5, 1, 4)
    assert sorted((r.reason, r.clips) for r in report.collect()) == [("audio_not_found", 1), ("text_invalid", 1), ("valid", 1)]
    assert [(r.filename, r.input_ids) for r in rows.collect()] == [("a", [1, 2, 0, 0])]
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "from_json" not in plan
