"""Interval algebra per media: chapters, cuts, sponsor segments, coverage and gains.

Times are DOUBLE seconds at the surface and whole microseconds inside, so running sums are exact.
Coverage questions are answered by prefix sums over sorted endpoints; no interval is paired with another.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedframe.operators.ordered import attach_group, first_per_key, fits, lag_lead, materialize, number_rows, run_last, run_max, run_sum, scan, shared_out
from timedframe.semantics import known

# Fixed values
POI_CATEGORIES = ["poi_highlight"]
TINY_S = 1.0
SPONSOR_TITLE = "[SponsorBlock]: "
UNTITLED = "<Untitled Chapter "
PEAK = 0.99
ACTIVE_EPS = 1e-4
RMS_EPS = 1e-6
CLOCK_WRAP = 2**33
CHAPTER_TIME = r"(?:\d+:)?\d{1,2}:\d{2}"

KEY = ["media_id"]


def us(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * 1_000_000).cast("bigint")


def sec(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c) / F.lit(1_000_000.0)


# ---- coverage ------------------------------------------------------------------------------------


def covered_before(points: DataFrame, intervals: DataFrame, key: str = "media_id", bounded: bool | None = None) -> DataFrame:
    """For points (``key, pid, x``) the total interval length before x, in microseconds.

    With N starts minus ends and T their times summed up to x, that length is ``x N - T``.
    """
    live = intervals.filter(F.col("e") > F.col("s"))
    steps = live.select(key, F.explode(F.array(F.struct(F.col("s").alias("x"), F.lit(1).alias("d")), F.struct(F.col("e").alias("x"), F.lit(-1).alias("d")))).alias("z"))
    steps = steps.select(key, "z.x", F.lit(None).cast("string").alias("pid"), F.col("z.d").alias("d"))
    asked = points.select(key, "x", F.col("pid").cast("string").alias("pid"), F.lit(0).alias("d"))
    big = F.col("d") * F.col("x").cast("decimal(38,0)")
    rows = scan(steps.unionByName(asked), [key], ["x", "d", "pid"], {"_n": run_sum(F.col("d").cast("bigint")), "_t": run_sum(big)}, bounded)
    rows = rows.filter(F.col("pid").isNotNull())
    return rows.select(key, "pid", (F.col("x").cast("decimal(38,0)") * F.col("_n") - F.col("_t")).cast("bigint").alias("covered"))


def covered_inside(ranges: DataFrame, intervals: DataFrame, key: str = "media_id", bounded: bool | None = None) -> DataFrame:
    """For ranges (``key, rid, s, e``) the interval length inside each (overlaps count as often as they lie)."""
    ends = ranges.select(key, F.explode(F.array(F.struct(F.concat(F.lit("s"), F.col("rid").cast("string")).alias("pid"), F.col("s").alias("x")), F.struct(F.concat(F.lit("e"), F.col("rid").cast("string")).alias("pid"), F.col("e").alias("x")))).alias("z")).select(key, "z.*")
    got = covered_before(ends, intervals, key, bounded)
    sign = F.when(F.col("pid").startswith("e"), F.col("covered")).otherwise(-F.col("covered"))
    return got.groupBy(key, F.expr("substring(pid, 2)").alias("rid")).agg(F.sum(sign).alias("covered"))


def overlap_ratio(windows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Voiced time inside each window (``media_id, seg_id, start, end``) over its length, at most 1; empty windows 0."""
    w = windows.select("media_id", F.col("seg_id").alias("rid"), us("start").alias("s"), us("end").alias("e"))
    i = intervals.select("media_id", us("start_time").alias("s"), us("end_time").alias("e"))
    got = covered_inside(w.filter(F.col("e") > F.col("s")), i).withColumn("seg_id", F.col("rid").cast(dict(windows.dtypes)["seg_id"]))
    out = windows.join(got.select("media_id", "seg_id", "covered"), ["media_id", "seg_id"], "left")
    ratio = F.least(F.lit(1.0), sec(F.coalesce("covered", F.lit(0))) / (F.col("end") - F.col("start")))
    return out.select(*windows.columns, F.when(F.col("end") > F.col("start"), ratio).otherwise(0.0).alias("score"))


def best_candidate(scores: DataFrame, keys: Sequence[str] = ("media_id", "seg_id")) -> DataFrame:
    """Lowest score wins; on a tie the candidate of lower ``priority`` stays."""
    at = F.struct("score", "priority")
    return scores.groupBy(*keys).agg(F.min_by("candidate", at).alias("candidate"), F.min("score").alias("score"))


# ---- chapters ------------------------------------------------------------------------------------


def fill_chapters(chapters: DataFrame, media: DataFrame) -> DataFrame:
    """Complete chapters (``media_id, idx, start_time, end_time, title``): a first chapter at 0, starts from the
    previous end, ends from the next start or the duration, and numbered titles."""
    heads = first_per_key(chapters.select("media_id", "idx", "start_time"), KEY, ["idx"]).filter(F.col("start_time") > 0)
    kinds = dict(chapters.dtypes)
    lead = heads.select(
        "media_id",
        (F.col("idx") - 1).cast(kinds["idx"]).alias("idx"),
        F.lit(0.0).alias("start_time"),
        F.lit(None).cast("double").alias("end_time"),
        F.lit(None).cast("string").alias("title"),
    )
    small = fits(chapters, KEY, 2)
    rows = chapters.select("media_id", "idx", "start_time", "end_time", "title").unionByName(lead)
    rows = number_rows(rows, KEY, ["idx"], "_no", small)
    rows = lag_lead(rows, KEY, ["idx"], bounded=small, lags={"_pe": F.struct(F.nullif("end_time", F.lit(0.0)).alias("e"))}, leads={"_ns": F.struct(F.col("start_time").alias("s"))})
    rows = rows.join(media.select("media_id", "duration"), "media_id", "left")
    end = F.coalesce(F.nullif("end_time", F.lit(0.0)), F.when(F.col("_ns").isNull(), F.col("duration")).otherwise(F.col("_ns.s")))
    start = F.coalesce("start_time", F.when(F.col("_pe").isNull(), F.lit(0.0)).otherwise(F.col("_pe.e")))
    title = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit(UNTITLED), F.col("_no").cast("string"), F.lit(">")))
    return rows.select("media_id", F.col("_no").alias("idx"), start.alias("start_time"), end.alias("end_time"), title.alias("title"))


def valid_chapters(chapters: DataFrame, media: DataFrame) -> DataFrame:
    """Chapters whose start lies between the last accepted start and the duration.

    Accepted starts never fall, so the last one equals the running maximum of all starts in range.
    """
    rows = chapters.join(media.select("media_id", "duration"), "media_id")
    fits = (F.col("start_time") >= 0) & (F.col("start_time") <= F.col("duration"))
    rows = scan(rows, KEY, ["idx"], {"_top": run_max(F.when(fits, F.col("start_time")), False)})
    return rows.filter(known(fits & (F.col("start_time") >= F.coalesce("_top", F.lit(0.0))))).select(*chapters.columns)


def clock_seconds(text: Column) -> Column:
    return F.aggregate(F.split(text, ":"), F.lit(0).cast("bigint"), lambda a, p: a * 60 + p.cast("bigint"))


def chapters_from_text(media: DataFrame, text: str = "description") -> DataFrame:
    """Chapters from lines such as ``1:02:03 - title`` or, when none of those fit, ``title - 1:02``."""

    def found(media: DataFrame, pattern: str, time: int, title: int) -> DataFrame:
        times = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), time)
        titles = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), title)
        # Not an inner one: Spark would search every text twice, once to drop those without a line.  A row without a time fails below.
        rows = media.select("media_id", "duration", F.explode_outer(F.arrays_zip(times.alias("t"), titles.alias("n"))).alias("z"))
        rows = rows.select("media_id", "duration", clock_seconds(F.col("z.t")).cast("double").alias("start_time"), F.col("z.n").alias("title"))
        return rows.filter(F.col("start_time").between(0, F.col("duration")))

    # Few and short, and read again below; the second pattern is searched only where the first one found nothing.
    first = materialize(found(media, rf"(?m)^\s*({CHAPTER_TIME})\b\W*\s(.+?)\s*$", 1, 2))
    rest = media.join(first.select("media_id").distinct(), "media_id", "left_anti")
    second = materialize(found(rest, rf"(?m)^\s*(.+?)\b\W*\s({CHAPTER_TIME})\s*$", 2, 1))
    rows = first.unionByName(second)
    return number_rows(rows, KEY, ["start_time", "title"], "idx").select("media_id", "idx", "start_time", "title")


def clean_sponsor_segments(df: DataFrame, drop_whole: bool = False) -> DataFrame:
    """Snap ends to the media, give points of interest a second, and keep segments of the same recording
    (``media_id, start_time, end_time, category, duration, video_duration``)."""
    d = F.col("duration")
    rows = df.filter(~((F.col("start_time") == 0) & (F.col("end_time") == 0))) if drop_whole else df
    start = F.when(F.col("start_time") <= 1, 0.0).otherwise(F.col("start_time"))
    end = F.col("end_time") + F.when(F.col("category").isin(POI_CATEGORIES), 1.0).otherwise(0.0)
    end = F.when(known((d > 0) & (d - end <= 1)), d).otherwise(end)
    rows = rows.withColumns({"_s": start, "_e": end})
    diff = F.when(F.coalesce(F.col("video_duration"), F.lit(0.0)) != 0, F.abs(d - F.col("video_duration"))).otherwise(0.0)
    near = (diff < 1) | ((diff < 5) & (F.try_divide(diff, F.col("_e") - F.col("_s")) < 0.05))
    swap = {"start_time": "_s", "end_time": "_e"}
    return rows.filter(known(near)).select(*[F.col(swap[c]).alias(c) if c in swap else F.col(c) for c in df.columns])


def mark_cuts(intervals: DataFrame, patterns: Sequence[str] = (), categories: Sequence[str] = (), ranges: Sequence[tuple[float, float]] = ()) -> DataFrame:
    """Adds ``remove`` to (``media_id, kind, start_time, end_time, title, category``) and the manual ranges of every media."""
    chapter = (F.col("kind") == "chapter") & (reduce(lambda a, b: a | b, [F.col("title").rlike(p) for p in patterns]) if patterns else F.lit(False))
    sponsor = (F.col("kind") == "sponsor") & F.col("category").isin(list(categories)) if categories else F.lit(False)
    rows = intervals.withColumn("remove", known(chapter | sponsor))
    if not ranges:
        return rows
    spans = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("s"), F.lit(float(b)).alias("e")) for a, b in ranges]))
    manual = intervals.select("media_id").distinct().select("media_id", spans.alias("z")).select(
        "media_id", F.lit("cut").alias("kind"), F.col("z.s").alias("start_time"), F.col("z.e").alias("end_time"),
        F.lit("Manually removed").alias("title"), F.lit("manually_removed").alias("category"), F.lit(True).alias("remove"),
    )
    return rows.unionByName(manual, allowMissingColumns=True)


def select_ranges(media: DataFrame, chapters: DataFrame, patterns: Sequence[str] = (), ranges: Sequence[tuple[float, float]] = ()) -> DataFrame:
    """Ranges to fetch: chapters with a matching title plus fixed ranges, where a negative time counts from the end."""
    hit = reduce(lambda a, b: a | b, [F.col("title").rlike(p) for p in patterns]) if patterns else F.lit(False)
    named = chapters.filter(known(hit)).select("media_id", "start_time", "end_time", "title")
    if not ranges:
        return named
    spans = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("s"), F.lit(float(b)).alias("e")) for a, b in ranges]))
    from_end = lambda t: F.when(t < 0, F.greatest(F.col("duration") + t, F.lit(0.0))).otherwise(t)
    fixed = media.select("media_id", "duration", spans.alias("z")).select("media_id", from_end(F.col("z.s")).alias("start_time"), from_end(F.col("z.e")).alias("end_time"), F.lit(None).cast("string").alias("title"))
    return named.unionByName(fixed)


def expand_sections(formats: DataFrame, ranges: DataFrame, media: DataFrame) -> DataFrame:
    """Selected formats times requested ranges of a media, moved by its own section start and clipped to its duration."""
    rows = formats.join(ranges, "media_id").join(media.select("media_id", "duration", "section_start"), "media_id", "left")
    offset, whole = F.coalesce("section_start", F.lit(0.0)), F.nullif("duration", F.lit(0.0))
    end = offset + F.least(F.coalesce("end_time", whole), F.coalesce(whole, F.col("end_time")))
    end = F.when(~known(end > offset + whole + 1), end)
    return rows.select(
        *formats.columns,
        F.col("range_no").alias("section_number"),
        (offset + F.coalesce("start_time", F.lit(0.0))).alias("section_start"),
        end.alias("section_end"),
        F.col("title").alias("section_title"),
    )


# ---- cuts ----------------------------------------------------------------------------------------


def merge_cuts(cuts: DataFrame) -> DataFrame:
    """Overlapping or touching cuts (``media_id, start_time, end_time``) united, numbered in order."""
    return _merged(cuts.select("media_id", us("start_time").alias("s"), us("end_time").alias("e"))).select(
        "media_id", "cut_no", sec("s").alias("start_time"), sec("e").alias("end_time")
    )


def _merged(rows: DataFrame, bounded: bool | None = None) -> DataFrame:
    bounded = fits(rows, KEY) if bounded is None else bounded
    rows = rows.groupBy("media_id", "s").agg(F.max("e").alias("e"))  # one row per start makes the order total
    rows = scan(rows, KEY, ["s"], {"_reach": run_max(F.col("e"), False)}, bounded)
    fresh = F.when(F.col("_reach") >= F.col("s"), 0).otherwise(1)
    rows = scan(rows, KEY, ["s"], {"cut_no": run_sum(fresh)}, bounded)
    return rows.groupBy("media_id", "cut_no").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def remap_chapters(chapters: DataFrame, cuts: DataFrame) -> DataFrame:
    """Chapters on the timeline without the cuts; what a cut covers whole disappears."""
    small = fits(cuts, KEY, 4) and fits(chapters, KEY, 4)
    merged = _merged(cuts.select("media_id", us("start_time").alias("s"), us("end_time").alias("e")), small)
    spans = chapters.select("media_id", F.col("idx").cast("string").alias("rid"), us("start_time").alias("s"), us("end_time").alias("e"))
    lost = covered_inside(spans, merged, bounded=small)
    rows = chapters.withColumn("rid", F.col("idx").cast("string")).join(lost, ["media_id", "rid"], "left")
    rows = rows.withColumn("_len", us("end_time") - us("start_time") - F.coalesce("covered", F.lit(0))).filter(F.col("_len") > 0)
    rows = scan(rows, KEY, ["start_time", "idx"], {"_until": run_sum(F.col("_len"))}, small)
    new = {"start_time": sec(F.col("_until") - F.col("_len")), "end_time": sec("_until")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in chapters.columns])


def keep_ranges(cuts: DataFrame, media: DataFrame) -> DataFrame:
    """What the merged cuts leave of each media, without empty pieces."""
    small = fits(cuts, KEY, 2)
    merged = _merged(cuts.select("media_id", us("start_time").alias("s"), us("end_time").alias("e")), small)
    stops = merged.select("media_id", "s", "e").unionByName(media.select("media_id", us("duration").alias("s"), F.lit(None).cast("bigint").alias("e")))
    rows = lag_lead(stops.withColumn("_tail", F.col("e").isNull()), KEY, ["_tail", "s"], lags={"_from": F.col("e")}, bounded=small)
    rows = rows.select("media_id", F.coalesce("_from", F.lit(0)).alias("s"), F.col("s").alias("e")).filter(F.col("s") < F.col("e"))
    return rows.select("media_id", sec("s").alias("start_time"), sec("e").alias("end_time"))


# ---- overlay of chapters, sponsors and cuts ------------------------------------------------------


def overlay_intervals(intervals: DataFrame) -> DataFrame:
    """Pieces on the timeline without cuts, where sponsor segments lie over chapters.

    Input (``media_id, kind, start_time, end_time, title, category, remove``) with kind chapter or sponsor.
    One scan over the sorted endpoints gives each elementary range its cut depth, its chapter and its group
    of touching sponsors; only ranges inside sponsors meet the sponsor rows of their own group.  Neighbours
    with the same cover unite, so a cut inside a piece does not split it.
    """
    rows = intervals.select("media_id", "kind", us("start_time").alias("s"), us("end_time").alias("e"), "title", "category", F.coalesce("remove", F.lit(False)).alias("remove"))
    rows = materialize(rows.filter(F.col("e") > F.col("s")))  # read by five branches below
    rows = shared_out(rows, rows, *KEY)
    cut, sponsor = F.col("remove"), ~F.col("remove") & (F.col("kind") == "sponsor")
    small = fits(rows, KEY, 4)
    groups = _merged(rows.filter(sponsor).select("media_id", "s", "e"), small).withColumnRenamed("cut_no", "grp")
    blank = F.lit(None).cast("string")
    step = lambda x, c, p, g, ch: F.struct(x.alias("x"), c.alias("c"), p.alias("p"), g.alias("g"), ch.alias("ch"))
    none_g, none_ch = F.lit(None).cast("bigint"), F.lit(None).cast("struct<e:bigint,s:bigint,title:string>")
    zero, one, minus = F.lit(0), F.lit(1), F.lit(-1)
    ones = lambda flag, v: F.when(flag, v).otherwise(zero)
    chap = F.when(~cut & (F.col("kind") == "chapter"), F.struct(F.col("e"), F.col("s"), F.coalesce("title", blank).alias("title")))
    steps = rows.select("media_id", F.explode(F.array(
        step(F.col("s"), ones(cut, one), ones(sponsor, one), none_g, chap),
        step(F.col("e"), ones(cut, minus), ones(sponsor, minus), none_g, none_ch),
    )).alias("z")).select("media_id", "z.*")
    marks = groups.select("media_id", F.col("s").alias("x"), zero.alias("c"), zero.alias("p"), F.col("grp").cast("bigint").alias("g"), none_ch.alias("ch"))
    at = steps.unionByName(marks).groupBy("media_id", "x").agg(F.sum("c").alias("c"), F.sum("p").alias("p"), F.max("g").alias("g"), F.max("ch").alias("ch"))
    at = scan(at, KEY, ["x"], {"cuts": run_sum(F.col("c")), "sponsors": run_sum(F.col("p")), "grp": run_last(F.col("g")), "chapter": run_last(F.col("ch"))}, small)
    at = lag_lead(at.select("media_id", "x", "cuts", "sponsors", "grp", "chapter"), KEY, ["x"], leads={"nx": F.col("x")}, bounded=small)
    atoms = at.filter((F.col("cuts") == 0) & F.col("nx").isNotNull())
    inside = atoms.filter(F.col("sponsors") > 0).select("media_id", "x", "nx", "grp")
    lists = _sponsor_lists(inside, rows.filter(sponsor), groups, small)
    plain = atoms.filter((F.col("sponsors") == 0) & (F.col("chapter.e") > F.col("x"))).select(
        "media_id", "x", "nx", F.col("chapter.title").alias("title"), F.col("chapter.s").alias("cs"), F.col("chapter.e").alias("ce"), F.lit(None).cast(SPONSOR_LIST).alias("cats")
    )
    pieces = plain.unionByName(lists.select("media_id", "x", "nx", F.lit(None).cast("string").alias("title"), F.lit(None).cast("bigint").alias("cs"), F.lit(None).cast("bigint").alias("ce"), "cats"))
    cover = F.struct("cs", F.to_json("cats").alias("j"))
    pieces = lag_lead(pieces.withColumn("_cover", cover), KEY, ["x"], lags={"_before": F.col("_cover")}, bounded=small)
    pieces = scan(pieces, KEY, ["x"], {"piece": run_sum(F.when(F.col("_before").eqNullSafe(F.col("_cover")), 0).otherwise(1))}, small)
    out = pieces.groupBy("media_id", "piece").agg(
        F.sum(F.col("nx") - F.col("x")).alias("len"), F.min("x").alias("x"), F.first("title").alias("title"), F.first("cats").alias("cats"),
        F.first("cs").alias("cs"), F.first("ce").alias("ce"),
    )
    out = scan(out, KEY, ["piece"], {"_until": run_sum(F.col("len"))}, small)
    # a chapter that is shorter than it was lost time to a cut or a sponsor
    return out.select(
        "media_id", "piece", sec(F.col("_until") - F.col("len")).alias("start_time"), sec("_until").alias("end_time"), "title", "cats",
        F.coalesce(F.col("len") < F.col("ce") - F.col("cs"), F.lit(False)).alias("was_cut"),
    )


SPONSOR_LIST = "array<struct<s:bigint,e:bigint,category:string,name:string>>"


def _sponsor_lists(inside: DataFrame, sponsors: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    """Ordered sponsor list of each elementary range, met by equality on the group of touching sponsors."""
    starts = groups.select("media_id", F.col("s").alias("x"), "grp").unionByName(sponsors.select("media_id", F.col("s").alias("x"), F.lit(None).cast("bigint").alias("grp")))
    starts = starts.groupBy("media_id", "x").agg(F.max("grp").alias("g"))
    starts = scan(starts, KEY, ["x"], {"grp": run_last(F.col("g"))}, small).select("media_id", F.col("x").alias("s"), "grp")
    rows = sponsors.select("media_id", "s", "e", "category", F.coalesce("title", "category").alias("name")).join(starts, ["media_id", "s"])
    met = inside.join(rows, ["media_id", "grp"]).filter((F.col("s") <= F.col("x")) & (F.col("e") >= F.col("nx")))
    return met.groupBy("media_id", "x", "nx").agg(F.array_sort(F.collect_list(F.struct("s", "e", "category", "name"))).alias("cats"))


def fold_tiny(pieces: DataFrame) -> DataFrame:
    """Pieces under a second that a cut or sponsor made join a neighbour; equal-titled sponsors unite.

    A piece of normal length ends every dependence on what came before it, so a normal piece and the tiny
    run behind it form one small group; what a run hands to the next piece is only a start time.
    """
    pieces = materialize(pieces)
    small = fits(pieces, KEY)
    pieces = shared_out(pieces, pieces, *KEY)
    sponsor = F.col("cats").isNotNull()
    s, e = us("start_time"), us("end_time")
    rows = pieces.select("media_id", "piece", s.alias("s"), e.alias("e"), "title", "cats", ((F.col("was_cut") | sponsor) & (e - s < int(TINY_S * 1e6))).alias("tiny"))
    rows = lag_lead(rows, KEY, ["piece"], leads={"next_sponsor": F.struct(F.col("cats").isNotNull().alias("v"))}, bounded=small)
    rows = scan(rows, KEY, ["piece"], {"run": run_sum(F.when(F.col("tiny"), 0).otherwise(1))}, small)
    item = F.struct("piece", "s", "e", "title", "cats", "tiny", "next_sponsor")
    runs = rows.groupBy("media_id", "run").agg(F.array_sort(F.collect_list(item)).alias("ps"))

    def step(acc: Column, p: Column) -> Column:
        begin = F.coalesce(acc["carry"], p["s"])
        have, last = F.size(acc["out"]) > 0, F.element_at(acc["out"], -1)
        still = p["tiny"] & (p["e"] - begin < int(TINY_S * 1e6))
        has_next = p["next_sponsor"].isNotNull()
        mine, before, after = p["cats"].isNotNull(), last["cats"].isNotNull(), p["next_sponsor"]["v"]
        forward = still & has_next & (~have | (~mine & before & ~after) | (mine & ~before & after))
        new = F.array(F.struct(p["piece"].alias("piece"), begin.alias("s"), p["e"].alias("e"), p["title"].alias("title"), p["cats"].alias("cats")))
        longer = F.array(last.withField("e", p["e"]))
        out = (
            F.when(forward, acc["out"])
            .when(still & have, F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), longer))
            .otherwise(F.concat(acc["out"], new))
        )
        return F.struct(out.alias("out"), F.when(forward, begin).alias("carry"))

    shape = f"array<struct<piece:bigint,s:bigint,e:bigint,title:string,cats:{SPONSOR_LIST}>>"
    zero = F.struct(F.array().cast(shape).alias("out"), F.lit(None).cast("bigint").alias("carry"))
    folded = runs.select("media_id", "run", F.aggregate("ps", zero, step).alias("f"))
    folded = lag_lead(folded, KEY, ["run"], lags={"handed": F.col("f.carry")}, bounded=small)
    flat = folded.select("media_id", "run", "handed", F.posexplode("f.out").alias("i", "p"))
    rows = flat.select(
        "media_id", "p.piece", F.when(F.col("i") == 0, F.coalesce("handed", "p.s")).otherwise(F.col("p.s")).alias("s"), "p.e", "p.title", "p.cats"
    )
    names = lambda f: F.array_distinct(F.transform("cats", lambda c: c[f]))
    shortest = F.array_min(F.transform("cats", lambda c, i: F.struct((c["e"] - c["s"]).alias("d"), i.alias("i"), c["category"].alias("c"))))["c"]
    is_sponsor = F.col("cats").isNotNull()
    rows = rows.select(
        "media_id", "piece", "s", "e", is_sponsor.alias("is_sponsor"),
        F.when(is_sponsor, F.concat(F.lit(SPONSOR_TITLE), F.array_join(names("name"), ", "))).otherwise(F.col("title")).alias("title"),
        F.when(is_sponsor, shortest).alias("category"), F.when(is_sponsor, names("category")).alias("categories"),
    )
    rows = lag_lead(rows, KEY, ["piece"], lags={"_p": F.struct("is_sponsor", "title")}, bounded=small)
    same = F.col("is_sponsor") & F.col("_p.is_sponsor") & (F.col("_p.title") == F.col("title"))
    rows = scan(rows, KEY, ["piece"], {"chapter": run_sum(F.when(known(same), 0).otherwise(1))}, small)
    out = rows.groupBy("media_id", "chapter").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("title", "piece").alias("title"), F.min_by("category", "piece").alias("category"), F.min_by("categories", "piece").alias("categories")
    )
    return out.select("media_id", "chapter", sec("s").alias("start_time"), sec("e").alias("end_time"), "title", "category", "categories")


# ---- clocks and signals --------------------------------------------------------------------------


def unwrap_clock(df: DataFrame, key: str = "media_id", order: str = "seq", clock: str = "clock") -> DataFrame:
    """Adds 2^33 after every backward jump of a 33-bit clock."""
    small = fits(df, [key])
    rows = lag_lead(df, [key], [order], lags={"_prev": F.col(clock)}, bounded=small)
    rows = scan(rows, [key], [order], {"_wraps": run_sum(F.when(F.col(clock) < F.col("_prev"), 1).otherwise(0))}, small)
    return rows.select(*df.columns, (F.col(clock) + F.col("_wraps") * F.lit(CLOCK_WRAP)).alias("unwrapped"))


SQUARE = "decimal(28,18)"


def window_gain(signal: DataFrame, windows: DataFrame, target: float = 1.0, lo: float = 1.0, hi: float = 4.0) -> DataFrame:
    """RMS of the background, active RMS of the voice and the gain inside windows ``[start_i, end_i)``.

    ``signal(series_id, t_idx, background, voice)``; prefix sums answer every window at its two ends.  Squares are summed as
    decimals, so a window is as exact after a long loud past as at the start: samples up to 10^5 in size, squares to 18 decimals.
    """
    zero = F.lit(0).cast(SQUARE)
    square = lambda c: (F.col(c) * F.col(c)).cast(SQUARE)
    act = F.abs(F.col("voice")) > ACTIVE_EPS
    samples = signal.select(
        "series_id", F.col("t_idx").alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("seg_id"), F.lit(0).alias("sign"),
        square("background").alias("b2"), F.lit(1).alias("n"), F.when(act, square("voice")).otherwise(zero).alias("v2"), F.when(act, 1).otherwise(0).alias("m"),
    )
    live = windows.select("series_id", F.col("seg_id").cast("bigint").alias("seg_id"), F.greatest("start_i", F.lit(0)).alias("a"), F.col("end_i").alias("b")).filter(F.col("b") > F.col("a"))
    ends = live.select("series_id", "seg_id", F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(-1).alias("sign")), F.struct(F.col("b").alias("x"), F.lit(1).alias("sign")))).alias("z"))
    ends = ends.select("series_id", "z.x", F.lit(0).alias("kind"), "seg_id", "z.sign", zero.alias("b2"), F.lit(0).alias("n"), zero.alias("v2"), F.lit(0).alias("m"))
    rows = samples.unionByName(ends)
    names = ("b2", "n", "v2", "m")
    rows = scan(rows, ["series_id"], ["x", "kind", "seg_id", "sign"], {f"_{c}": run_sum(F.col(c)) for c in names})
    # A window has one row at either end: the difference of two exact sums.
    at = lambda c, sign: F.max(F.when(F.col("sign") == sign, F.col(f"_{c}")))
    got = rows.filter(F.col("sign") != 0).groupBy("series_id", "seg_id").agg(*[(at(c, 1) - at(c, -1)).cast("double").alias(c) for c in names])
    rms = lambda q, n: F.when(F.col(n) > 0, F.sqrt(F.col(q) / F.col(n))).otherwise(F.lit(0.0))
    got = got.select("series_id", "seg_id", rms("b2", "n").alias("bg_rms"), rms("v2", "m").alias("voice_rms"))
    gain = F.least(F.greatest(F.lit(target) * F.col("bg_rms") / F.col("voice_rms"), F.lit(lo)), F.lit(hi))
    return got.withColumn("gain", F.when((F.col("voice_rms") > RMS_EPS) & (F.col("bg_rms") > RMS_EPS), gain).otherwise(1.0))


def peak_normalize(signal: DataFrame, key: str = "series_id", value: str = "value") -> DataFrame:
    """Scale a series to a peak of 0.99 when it goes above."""
    rows = attach_group(signal, [key], _peak=F.max(F.abs(value)))
    scaled = F.when(F.col("_peak") > PEAK, F.col(value) * (F.lit(PEAK) / F.col("_peak"))).otherwise(F.col(value))
    return rows.select(*[scaled.alias(c) if c == value else F.col(c) for c in signal.columns])
