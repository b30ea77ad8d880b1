import pytest
from pyspark.sql import functions as F

from timedframe.functions import filters as fl
from timedframe.functions import scalars as sc
from timedframe.functions.ranking import parse_spec
from timedframe.functions.templates import interpret, template
from timedframe.functions.traverse import traverse, variant_path
from timedframe.operators import catalog as ct
from timedframe.operators import extensions as ex
from timedframe.operators import formats as fm

ENTRY = "id long, title string, like_count long, is_live boolean, size long, dur double"


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(
        [(1, "cats & dogs", 190, True, 2_000_000, 90.0), (2, "no likes", None, False, 500, 30.0), (3, None, 50, None, None, None)], ENTRY
    )


@pytest.mark.parametrize(
    "expr,want",
    [
        ("like_count > 100", [1]), ("like_count >? 100", [1, 2]), ("like_count!=190", [3]), ("like_count", [1, 3]), ("!like_count", [2]),
        ("is_live", [1]), ("!is_live", [2, 3]), (r"title *= 'cats \& dogs'", [1]), ("title!*=likes", [1]), ("title!*=?likes", [1, 3]),
        ("title ~= ^no", [2]), ("title ^= cats & like_count < 200", [1]), ("size > 1M", [1]), ("size<1KiB", [2]), ("dur>=1:00", [1]), ("nothing", []), ("!nothing", [1, 2, 3]),
    ],
)
def test_match_filter(entries, expr, want):
    assert sorted(r.id for r in ct.match_filter(entries, expr).collect()) == want


def test_match_filter_reaches_the_scan(entries, tmp_path):
    path = str(tmp_path / "entries")
    entries.write.parquet(path)
    plan = ct.match_filter(entries.sparkSession.read.parquet(path), "like_count > 100 & title ^= cats").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(like_count,100)" in plan and "StringStartsWith(title,cats)" in plan
    assert "ReadSchema: struct<id:bigint,title:string,like_count:bigint>" in plan


def test_match_filter_incomplete_and_errors(entries):
    assert sorted(r.id for r in ct.match_filter(entries, "like_count > 100", incomplete=["like_count"]).collect()) == [1, 2]
    assert [r.id for r in ct.match_filter(entries, lambda df: F.col("id") == 3).collect()] == [3]
    with pytest.raises(ValueError):
        ct.match_filter(entries, "like_count *= 5")
    with pytest.raises(ValueError):
        ct.match_filter(entries, "a ? b")


def test_dates_and_slices():
    assert fl.playlist_slices("1,3:7:2,-1") == [(1, 1, 1), (3, 7, 2), (-1, -1, 1)]
    assert fl.playlist_slices("2-") == [(2, None, 1)]
    for bad in ("", "1,,2", "1:2:0", "x"):
        with pytest.raises(ValueError):
            fl.playlist_slices(bad)
    assert fl.size_literal("10KiB") == 10240 and fl.size_literal("1.5 MB") == 1_500_000 and fl.size_literal("10kB") == 10240 and fl.size_literal("5 x") is None


ITEMS = [("1:3", [1, 2, 3]), ("-2:", [9, 10]), ("::-3", []), ("10:1:-4", [10, 6, 2]), ("3,1,3", [3, 1]), ("8:inf", [8, 9, 10]), (":3,2", [1, 2, 3]), ("20", [])]


@pytest.mark.parametrize("spec,want", ITEMS)
def test_playlist_items(spark, spec, want):
    df = spark.range(1, 11).select(F.lit(1).alias("playlist_id"), F.col("id").alias("playlist_index"))
    want = list(range(10, 0, -3)) if spec == "::-3" else want
    assert [r.playlist_index for r in ct.playlist_items(df, spec).orderBy("position").collect()] == want


def test_take_until_and_failures(spark):
    df = spark.createDataFrame([(1, i, i in (3, 5)) for i in range(1, 8)] + [(2, i, False) for i in range(1, 4)], "p long, i long, bad boolean")
    assert ct.take_until(df, ["p"], ["i"], F.col("bad")).count() == 2 + 3
    assert ct.skip_after_failures(df, ["p"], ["i"], F.col("bad"), 2).count() == 5 + 3


def test_unique_names(spark):
    names = ["x", "x", "x-2", "x", "y", "x-4", "x"]
    df = spark.createDataFrame([("p", n, i) for i, n in enumerate(names)], "parent string, name string, ord int")
    got = [r.unique_name for r in ct.unique_names(df).orderBy("ord").collect()]
    assert got == ["x", "x-3", "x-2", "x-5", "y", "x-4", "x-6"] and len(set(got)) == len(got)


def test_old_ids_count_as_archived(spark):
    e = spark.createDataFrame([(1, None), (2, ["9"]), (3, ["8"])], "id long, old_ids array<string>")
    a = spark.createDataFrame([("site 9",)], "archive_id string")
    assert sorted(r.id for r in ct.not_archived(e, a, "Site").collect()) == [1, 3]


FMT = "media_id long, format_idx long, format_id string, ext string, vcodec string, acodec string, height int, width int, tbr double, fps double"


def ranked(spark, rows, spec=()):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows, 1)], FMT).withColumn("url", F.concat(F.lit("https://x/"), "format_id"))
    return fm.rank_formats(fm.fill_sort_fields(df), spec)


MIXED = [
    ("a-lo", "m4a", "none", "mp4a.40.2", None, None, 64.0, None), ("a-hi", "webm", "none", "opus", None, None, 160.0, None),
    ("v-480", "mp4", "avc1.4d", "none", 480, 854, 1000.0, 30.0), ("v-1080", "webm", "vp9", "none", 1080, 1920, 3000.0, 30.0),
    ("b-360", "mp4", "avc1.4d", "mp4a.40.2", 360, 640, 700.0, 30.0), ("b-720", "mp4", "avc1.4d", "mp4a.40.2", 720, 1280, 1500.0, 60.0),
]
PICKS = [
    ("best", ["b-720"]), ("worst", ["b-360"]), ("bv", ["v-1080"]), ("ba", ["a-hi"]), ("bv*", ["v-1080"]), ("wv", ["v-480"]), ("b.2", ["b-360"]), ("bv+ba", ["v-1080+a-hi"]),
    ("bv[height<=480]+ba[ext=m4a]", ["v-480+a-lo"]), ("3gp/mp4", ["b-720"]), ("3gp", []), ("v-480", ["v-480"]), ("best[height<300]/worst", ["b-360"]),
    ("ba,bv", ["a-hi", "v-1080"]), ("(bv,b)+ba", ["v-1080+a-hi", "b-720"]), ("mergeall", ["v-1080+a-hi"]), ("best[tbr>1.4k]", ["b-720"]), ("m4a", ["a-lo"]),
    ("all[vcodec=none]", ["a-hi", "a-lo"]), ("[fps>=60]", ["b-720"]), ("bv[vcodec^=avc]", ["v-480"]), ("bv[vcodec!^=avc]", ["v-1080"]),
]


@pytest.fixture(scope="module")
def mixed(spark):
    return ranked(spark, MIXED).cache()


@pytest.mark.parametrize("spec,want", PICKS)
def test_select_formats(mixed, spec, want):
    got = fm.select_formats(mixed, spec).orderBy("choice").collect()
    assert [r.format_id for r in got] == want


def test_best_falls_back_when_one_kind_only(spark):
    audio = ranked(spark, [r for r in MIXED if r[2] == "none"])
    assert [r.format_id for r in fm.select_formats(audio, "best").collect()] == ["a-hi"]
    split = ranked(spark, [r for r in MIXED if "none" in r])
    assert fm.select_formats(split, "best").count() == 0
    assert [r.format_id for r in fm.select_formats(split, "mp4").collect()] == ["v-480"]


def test_merged_container_and_bad_selectors(mixed):
    row = fm.select_formats(mixed, "bv+ba").first()
    assert (row.ext, row.vcodec, row.acodec, row.height, row.tbr) == ("webm", "vp9", "opus", 1080, 3160.0)
    assert fm.select_formats(mixed, "v-480+a-lo").first().ext == "mp4" and fm.select_formats(mixed, "v-480+a-hi").first().ext == "mkv"
    for bad in ("bv+", ",best", "(best", "best)"):
        with pytest.raises(ValueError):
            fm.select_formats(mixed, bad)


@pytest.mark.parametrize(
    "spec,best", [(["height:480"], "v-480"), (["+height"], "b-360"), (["height~500"], "v-480"), (["fps"], "b-720"), (["+tbr"], "b-360"), (["vcodec:avc"], "b-720"), ([], "v-1080")]
)
def test_sort_specs(spark, spec, best):
    top = ranked(spark, [r for r in MIXED if r[2] != "none"], spec).orderBy(F.col("rank").desc()).first()
    assert top.format_id == best


def test_spec_order():
    fields = [f for f, *_ in parse_spec(["res:720", "+codec"])]
    assert fields[:6] == ["hidden", "aud_or_vid", "hasvid", "ie_pref", "res", "vcodec"] and len(fields) == len(set(fields))


def test_template_forms(spark):
    df = spark.createDataFrame([(1, "a/b", 1234567, "20240229", ["x", "y"], None, ("in",))], "id long, title string, n long, day string, tags array<string>, gone string, info struct<deep:string>")
    forms = {
        "%(title)s-%(id)05d": "a/b-00001", "%(gone)s|%(gone|-)s": "NA|-", "%(gone,title)s": "a/b", "%(n)D": "1M", "%(n)B": "1.18MiB", "%(tags)l": "x, y", "%(tags)j": '["x","y"]',
        "%(tags.0)s%(tags.-1)s": "xy", "%(info.deep)s": "in", "%(n+1)d": "1234568", "%(n*2-id)d": "2469133", "%(day>%d.%m.%Y)s": "29.02.2024", "%(title&is {}|none)s": "is a/b",
        "%(gone&is {}|none)s": "none", "%(title)q": "a/b", "%(title)S": "a⧸b", "100%%": "100%", "%(title)6s|%(title)-6s|": "   a/b|a/b   |", "%(n).2f": "1234567.00", "%(title).1s": "a",
    }
    row = df.select(*[template(df, t).alias(str(i)) for i, t in enumerate(forms)]).first()
    assert list(row) == list(forms.values())
    for bad in ("%(a b)s", "%(n>%Q)s", "%(x)z"):
        with pytest.raises(ValueError):
            template(df, bad)


def test_interpret(spark):
    df = spark.createDataFrame([("Artist - Song",), ("plain",)], "title string")
    got = {r.title: (r.artist, r.song_name) for r in interpret(df, "title", "%(artist)s - %(song_name)s").collect()}
    assert got == {"Artist - Song": ("Artist", "Song"), "plain": (None, None)}
    assert interpret(df, "%(title)s!", r"(?P<word>\w+)!").filter("word = 'plain'").count() == 1


def test_traverse(spark):
    df = spark.sql("select named_struct('a', array(named_struct('k', 1, 'v', 'x'), named_struct('k', 2, 'v', 'y'), named_struct('k', 3, 'v', null)), 'm', map('p', 5)) as d, parse_json('{\"u\":[{\"w\":7}]}') as j")
    pick = lambda *p: df.select(traverse(df, *p).alias("x")).first().x
    assert pick(("d", "a", ..., "v")) == ["x", "y"] and pick(("d", "a", -1, "k")) == 3 and pick(("d", "a", slice(1, None), "k")) == [2, 3]
    assert pick(("d", "a", lambda r: r["k"] > 1, "v")) == ["y"] and pick(("d", "m", "p")) == 5 and pick(("d", "a", 9, "v"), ("d", "a", 0, ("z", "v"))) == "x" and pick(("d", "m", "q")) is None
    assert pick(("d", "none")) is None and df.select(variant_path("j", ("u", 0, "w"), "int").alias("x")).first().x == 7


def test_hooks_and_provider(spark):
    df = spark.range(4)
    hooks = {"post_process": [lambda d: d.withColumn("n", F.col("n") * 10)], "pre_process": [lambda d: d.withColumn("n", F.col("id") + 1)]}
    assert [r.n for r in ex.apply_hooks(df, hooks).orderBy("id").collect()] == [10, 20, 30, 40]
    assert [r.n for r in ex.apply_hooks(df, hooks, until="video").orderBy("id").collect()] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        ex.apply_hooks(df, {"nowhere": []})
    got = ex.apply_provider(df, lambda p: p.assign(text=p["id"].map(lambda i: f"said {i}")), "id long, text string")
    assert sorted(r.text for r in got.collect()) == [f"said {i}" for i in range(4)]


def test_provider_repeats_halves_and_reports(spark, tmp_path):
    def weak(batch):
        assert len(batch) <= 3
        if 5 in set(batch["id"]):
            raise RuntimeError("five")
        mark = tmp_path / str(batch["id"].iloc[0])
        if not mark.exists():  # the first call of every batch fails
            mark.write_text("")
            raise OSError("busy")
        return batch.assign(text=batch["id"].astype(str))

    df = spark.range(0, 10, 1, 2)
    got = ex.apply_provider(df, weak, "id long, text string, error string", rows=3, tries=2, errors="error").orderBy("id").collect()
    assert [(r.id, r.text, r.error) for r in got] == [(i, None if i == 5 else str(i), "RuntimeError: five" if i == 5 else None) for i in range(10)]
    with pytest.raises(Exception, match="five"):
        ex.apply_provider(df, weak, "id long, text string", rows=3, tries=2).collect()
    with pytest.raises(ValueError):
        ex.apply_provider(df, weak, "id long", errors="error")
    assert ex.apply_provider(df.limit(0), weak, "id long, text string").count() == 0


@pytest.mark.parametrize(
    "fn,cases",
    [
        (sc.parse_duration, {"1": 1.0, "1:02": 62.0, "1:02:03": 3723.0, "1:02:03:04": 93784.0, "3h 11m 53s": 11513.0, "87 Min.": 5220.0, "PT1H0.5S": 3600.5, "9:12:43.78": 33163.78, "T30M38S": 1838.0, "2.5 hours": 9000.0, "x": None, "": None}),
        (sc.parse_filesize, {"91 B": 91, "2 MiB": 2097152, "5 GB": 5000000000, "1.2tb": 1200000000000, "1,24 kB": 1270, "nope": None}),
        (sc.parse_count, {"1000": 1000, "1.000": 1000, "1.1k": 1100, "1,1kk": 1100000, "1.1kk ": 1100000, "views 5,000": 5000, "": None}),
        (sc.unified_date, {"December 21, 2010": "20101221", "8/7/2009": "20090708", "2012/10/11 01:56:38": "20121011", "1968 12 10": "19681210", "2 May 2024": "20240502", "junk": None}),
        (sc.parse_iso8601, {"2014-03-23T23:04:26+0100": 1395612266, "2014-03-23T22:04:26Z": 1395612266, "2014-03-23T22:04:26.1234Z": 1395612266, "x": None}),
        (sc.parse_age, {"18": 18, "21+": 21, "PG-13": 13, "TV-14": 14, "tvma": 17, "odd": None}),
        (sc.slugify, {"Nhạc buồn": "nhac-buon", "  A  b! ": "a-b", "!!!": None}),
        (sc.normalize_video_url, {"https://v.douyin.com/x?modal_id=12": "https://www.douyin.com/video/12", "https://notdouyin.com/?modal_id=1": "https://notdouyin.com/?modal_id=1", " a ": "a"}),
    ],
)
def test_scalars(spark, fn, cases):
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.v for r in df.select("t", fn(F.col("t")).alias("v")).collect()} == cases
