"""Media formats: playable ones, derived fields, ranking, selection, merging and identifiers."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedframe.functions.filters import format_column
from timedframe.functions.ranking import sort_columns
from timedframe.operators.ordered import attach_group, first_per_key, number_rows, top_n

# Fixed values
AUDIO_EXTS = ["aiff", "alac", "flac", "m4a", "mka", "mp3", "ogg", "opus", "wav"]
VIDEO_EXTS = ["avi", "flv", "mkv", "mov", "mp4", "webm", "3gp"]
STORYBOARD_EXTS = ["mhtml"]
AUDIO_CODEC_EXTS = ["aac", "opus", "mp3", "flac", "vorbis"]
CONTAINER_CODECS = {
    "mp4": ["av1", "hevc", "avc1", "mp4a", "ac-4", "h264", "aacl", "ec-3"],
    "webm": ["av1", "vp9", "vp8", "opus", "vrbs", "vp9x", "vp8x"],
}
CONTAINER_EXTS = [["mp3", "mp4", "m4a", "m4p", "m4b", "m4r", "m4v", "ismv", "isma", "mov"], ["webm", "weba"]]
KEY = ["media_id"]


def _has(codec: str) -> Column:
    """A stream counts as present unless its codec is the word none; unknown counts as present."""
    return F.coalesce(F.col(codec) != "none", F.lit(True))


def playable_formats(df: DataFrame) -> DataFrame:
    """Without DRM (``maybe`` stays) and with a URL; ``images_only`` marks media where nothing else is left."""
    free = df.filter((F.col("has_drm").isNull() | (F.col("has_drm") == "maybe")) & (F.coalesce(F.length("url"), F.lit(0)) > 0))
    return attach_group(free, KEY, images_only=F.bool_and(~_has("vcodec") & ~_has("acodec")))


def fill_sort_fields(df: DataFrame) -> DataFrame:
    """Protocol, extension per stream and the bitrates that follow from the other two."""
    have = set(df.columns)
    opt = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    path_ext = F.regexp_extract("url", r"^[^?#]*\.([A-Za-z0-9]+)(?:[?#]|$)", 1)
    derived = (
        F.when(F.col("url").startswith("rtmp"), "rtmp")
        .when(path_ext == "m3u8", "m3u8_native")
        .when(path_ext == "f4m", "f4m")
        .otherwise(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    )
    no_video, no_audio = F.col("vcodec") == "none", F.col("acodec") == "none"
    silent = lambda c: F.coalesce(c, F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0.0)) == 0
    rows = df.withColumns(
        {
            "protocol": F.coalesce(F.nullif(opt("protocol", "string"), F.lit("")), derived),
            "ext": F.coalesce(F.nullif(F.col("ext"), F.lit("")), F.lower(path_ext)),
            "vbr": F.when(silent(no_video), 0.0).otherwise(opt("vbr", "double")),
            "abr": F.when(silent(no_audio), 0.0).otherwise(opt("abr", "double")),
        }
    )
    rows = rows.withColumns(
        {
            "audio_ext": F.when(silent(no_video), F.when(silent(no_audio), "none").otherwise(F.col("ext"))).otherwise("none"),
            "video_ext": F.when(silent(no_video), "none").otherwise(F.col("ext")),
            "preference": F.when(
                opt("preference", "int").isNull() & (F.col("ext") == "flv") & F.col("vcodec").rlike("^(?:[hx]265|he?vc?)"), -100
            ).otherwise(opt("preference", "int")),
            "vbr": F.when(zero(F.col("vbr")) & ~silent(no_video), F.nullif(F.col("tbr") - F.col("abr"), F.lit(0.0))).otherwise(F.col("vbr")),
        }
    )
    rows = rows.withColumn("abr", F.when(zero(F.col("abr")) & ~silent(no_audio), F.nullif(F.col("tbr") - F.col("vbr"), F.lit(0.0))).otherwise(F.col("abr")))
    return rows.withColumn("tbr", F.when(zero(F.col("tbr")), F.nullif(F.col("vbr") + F.col("abr"), F.lit(0.0))).otherwise(F.col("tbr")))


def rank_formats(
    df: DataFrame, sort_spec: Sequence[str] = (), source_spec: Sequence[str] = (), force: bool = False, free_first: bool = False, defaults: bool = True
) -> DataFrame:
    """``rank`` per media, ascending so that the best is last; equal formats keep their source order.

    Formats equal by the given fields are told apart by the default order, or without ``defaults`` by source order alone.
    """
    keys = sort_columns(df, sort_spec, source_spec, force, free_first, defaults)
    named = {f"_s{i}": k for i, k in enumerate(keys)}
    return number_rows(df.withColumns(named), KEY, [*named, "format_idx"], "rank").drop(*named)


def filter_formats(df: DataFrame, spec: str) -> DataFrame:
    return df.filter(format_column(df, spec))


# ---- selection -----------------------------------------------------------------------------------


def _selector_tree(spec: str):
    """Nested tuples of a selector: ``,`` lists, ``/`` alternatives, ``+`` merges, ``( )`` groups, ``[ ]`` filters."""
    tokens = re.findall(r"\[[^\]]*\]|[,/+()]|[^\s,/+()\[\]]+", spec)
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def listed():
        out = [choice()]
        while peek() == ",":
            take()
            out.append(choice())
        return ("list", out) if len(out) > 1 else out[0]

    def choice():
        out = [merged()]
        while peek() == "/":
            take()
            out.append(merged())
        return ("first", out) if len(out) > 1 else out[0]

    def merged():
        out = atom()
        if peek() == "+":
            take()
            return ("merge", out, merged())
        return out

    def atom():
        if peek() is None or peek() in ",/+)":
            raise ValueError(f"invalid selector {spec!r}")
        if peek() == "(":
            take()
            node = listed()
            if peek() != ")":
                raise ValueError(f"missing ) in {spec!r}")
            take()
        else:
            node = ("one", "best" if peek().startswith("[") else take())
        filters = []
        while peek() and peek().startswith("["):
            filters.append(take()[1:-1])
        return ("filter", node, filters) if filters else node

    tree = listed()
    if peek() is not None:
        raise ValueError(f"unexpected {peek()!r} in {spec!r}")
    return tree


FIELDS = ["format_id", "ext", "vcodec", "acodec", "width", "height", "fps", "tbr", "vbr", "abr", "filesize", "filesize_approx", "protocol"]


def _parts(df: DataFrame) -> Column:
    types = {"width": "int", "height": "int", "fps": "double", "tbr": "double", "vbr": "double", "abr": "double", "filesize": "bigint", "filesize_approx": "bigint"}
    cols = [(F.col(f) if f in df.columns else F.lit(None)).cast(types.get(f, "string")).alias(f) for f in FIELDS]
    return F.array(F.struct(*cols))


def _atom(name: str) -> tuple[Column, Column | None, str | None, bool, int]:
    """Condition of an atom, its fallback condition with the flag that allows it, best or worst, and the place."""
    v, a = _has("vcodec"), _has("acodec")
    m = re.fullmatch(r"(best|worst|b|w)(video|audio|v|a)?(\*)?(?:\.([1-9]\d*))?", name)
    if m:
        kind, star = (m[2] or "")[:1], bool(m[3])
        if kind:
            cond = (v if kind == "v" else a) if star else (~a if kind == "v" else ~v)
        else:
            cond = F.lit(True) if star else v & a
        plain = not kind and not star
        return cond & (v | a), (v | a) if plain else None, "lopsided" if plain else None, m[1][0] == "b", int(m[4] or 1)
    if name in AUDIO_EXTS:
        return (F.col("ext") == name) & a, None, None, True, 1
    if name in VIDEO_EXTS:
        return (F.col("ext") == name) & v & a, (F.col("ext") == name) & v, "unmerged", True, 1
    if name in STORYBOARD_EXTS:
        return (F.col("ext") == name) & ~a & ~v, None, None, True, 1
    return F.col("format_id") == name, None, None, True, 1


def _flags() -> dict[str, Column]:
    v, a = _has("vcodec"), _has("acodec")
    return {"_lopsided": F.bool_and(v & ~a) | F.bool_and(~v & a), "_unmerged": ~F.bool_or(v & a)}


def _atoms(node) -> list[str]:
    if node[0] == "one":
        return [node[1]]
    children = node[1] if node[0] in ("list", "first") else node[1:2] if node[0] == "filter" else node[1:]
    return [x for c in children for x in _atoms(c)]


CHOICE_LIST = (
    "array<array<struct<format_id:string,ext:string,vcodec:string,acodec:string,width:int,height:int,fps:double,"
    "tbr:double,vbr:double,abr:double,filesize:bigint,filesize_approx:bigint,protocol:string>>>"
)


class _Aggregated:
    """A selector without ``all`` and without places past the first needs one row per atom and media, so all
    atoms are aggregates of a single group-by and the tree above them is column arithmetic."""

    def __init__(self, df: DataFrame, allow_multi: bool):
        self.df, self.allow_multi, self.aggs = df, allow_multi, _flags()

    def _pick(self, cond: Column, best: bool) -> Column:
        name = f"_p{len(self.aggs)}"
        entry = F.when(cond, F.struct("rank", F.get(_parts(self.df), F.lit(0)).alias("part")))
        self.aggs[name] = F.max(entry) if best else F.min(entry)
        return F.col(name)

    @staticmethod
    def _choices(picked: Column) -> Column:
        nothing = F.array().cast(CHOICE_LIST)
        return F.when(picked.isNull(), nothing).otherwise(F.array(F.array(picked["part"])))

    def node(self, node, cond: Column) -> Column:
        kind = node[0]
        if kind == "filter":
            return self.node(node[1], reduce(lambda x, y: x & y, [format_column(self.df, f) for f in node[2]], cond))
        if kind == "list":
            return reduce(lambda x, y: F.concat(x, y), [self.node(c, cond) for c in node[1]])
        if kind == "first":
            options = F.array(*[self.node(c, cond) for c in node[1]])
            return F.coalesce(F.get(F.filter(options, lambda o: F.size(o) > 0), F.lit(0)), F.array().cast(CHOICE_LIST))
        if kind == "merge":
            left, right = self.node(node[1], cond), self.node(node[2], cond)
            join = (lambda x, y: F.concat(x, y)) if self.allow_multi else (lambda x, y: _one_of_each(F.concat(x, y)))
            return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: join(x, y))))
        if node[1] == "mergeall":
            v, a = _has("vcodec"), _has("acodec")
            best = self._pick(cond & (v | a), True)
            video, audio = self._pick(cond & v & ~a, True), self._pick(cond & a & ~v, True)
            every = F.filter(F.array(best["part"], video["part"], audio["part"]), lambda p: p.isNotNull())
            return F.when(best.isNull(), F.array().cast(CHOICE_LIST)).otherwise(F.array(_one_of_each(every)))
        main, spare, flag, best, _ = _atom(node[1])
        got = self._pick(cond & main, best)
        if spare is not None:
            got = F.coalesce(got, F.when(F.col(f"_{flag}"), self._pick(cond & spare, best)))
        return self._choices(got)


def _single(df: DataFrame, name: str) -> DataFrame:
    """Rows of one atom: (media_id, ord, parts)."""
    if name == "all":
        return df.select("media_id", F.array(-F.col("rank").cast("bigint")).alias("ord"), _parts(df).alias("parts"))
    main, spare, flag, best, nth = _atom(name)
    if name == "mergeall":
        raise ValueError("mergeall does not mix with all or with places past the first")
    cond = main | (F.col(f"_{flag}") & spare) if spare is not None else main
    got = top_n(df.filter(cond), KEY, [F.col("rank").desc() if best else F.col("rank").asc()], nth).filter(F.col("_rn") == nth)
    return got.select("media_id", F.array(F.lit(0).cast("bigint")).alias("ord"), _parts(df).alias("parts"))


def _one_of_each(parts: Column) -> Column:
    """Parts in order, at most one with video and one with audio, none without either."""
    has = lambda p, c: F.coalesce(p[c] != "none", F.lit(True))

    def add(acc: Column, p: Column) -> Column:
        v, a = has(p, "vcodec"), has(p, "acodec")
        clash = (F.exists(acc, lambda q: has(q, "vcodec")) & v) | (F.exists(acc, lambda q: has(q, "acodec")) & a) | (~v & ~a)
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(parts, F.slice(parts, 1, 0), add)


def _evaluate(df: DataFrame, node, allow_multi: bool) -> DataFrame:
    kind = node[0]
    if kind == "one":
        return _single(df, node[1])
    if kind == "filter":
        return _evaluate(df.filter(reduce(lambda x, y: x & y, [format_column(df, f) for f in node[2]])), node[1], allow_multi)
    if kind in ("list", "first"):
        tagged = []
        for i, child in enumerate(node[1]):
            got = _evaluate(df, child, allow_multi)
            tagged.append(got.select("media_id", F.concat(F.array(F.lit(i).cast("bigint")), "ord").alias("ord"), "parts"))
        every = reduce(DataFrame.unionByName, tagged)
        if kind == "first":
            every = attach_group(every, KEY, _alt=F.min(F.get("ord", F.lit(0))))
            every = every.filter(F.get("ord", F.lit(0)) == F.col("_alt")).drop("_alt")
        return every
    left = _evaluate(df, node[1], allow_multi)
    right = _evaluate(df, node[2], allow_multi)
    return merge_formats(left, right, allow_multi)


def merge_formats(a: DataFrame, b: DataFrame, allow_multi: bool = False) -> DataFrame:
    """Every pair of two selections of a media as one merged choice; both sides are selected rows already."""
    right = b.select("media_id", F.col("ord").alias("_ord"), F.col("parts").alias("_parts"))
    both = F.concat("parts", "_parts")
    return a.join(right, "media_id").select("media_id", F.concat("ord", "_ord").alias("ord"), (both if allow_multi else _one_of_each(both)).alias("parts"))


def compatible_ext(parts: Column) -> Column:
    """Container of a merged choice."""
    has = lambda p, c: F.coalesce(p[c] != "none", F.lit(True))
    videos, audios = F.filter(parts, lambda p: has(p, "vcodec")), F.filter(parts, lambda p: has(p, "acodec"))
    clean = lambda ps, c: F.lower(F.replace(F.get(F.split(F.get(ps, F.lit(0))[c], r"\."), F.lit(0)), F.lit("0"), F.lit("")))
    vc, ac = clean(videos, "vcodec"), clean(audios, "acodec")
    out = F.when((F.size(videos) > 1) | (F.size(audios) > 1), "mkv")
    for ext, codecs in CONTAINER_CODECS.items():
        out = out.when(F.coalesce(vc.isin(codecs), F.lit(False)) & F.coalesce(ac.isin(codecs), F.lit(False)), ext)
    exts = F.array_distinct(F.concat(F.transform(videos, lambda p: p["ext"]), F.transform(audios, lambda p: p["ext"])))
    first = F.get(F.transform(videos, lambda p: p["ext"]), F.lit(0))
    out = out.when(F.size(exts) == 1, first)
    for group in CONTAINER_EXTS:
        out = out.when(F.forall(exts, lambda e: e.isin(group)), first)
    return out.otherwise("mkv")


def describe_choices(choices: DataFrame) -> DataFrame:
    """Fields of each choice: a single format's own, or those of a merge."""
    has = lambda p, c: F.coalesce(p[c] != "none", F.lit(True))
    p = F.col("parts")
    videos, audios = F.filter(p, lambda x: has(x, "vcodec")), F.filter(p, lambda x: has(x, "acodec"))
    only = lambda ps, c: F.when(F.size(p) == 1, F.get(p, F.lit(0))[c]).when(F.size(ps) == 1, F.get(ps, F.lit(0))[c])
    total = lambda f: F.aggregate(F.transform(p, f), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    pick = lambda x, *cs: F.coalesce(*[F.nullif(x[c].cast("double"), F.lit(0.0)) for c in cs])
    return choices.select(
        "media_id",
        "ord",
        F.array_join(F.transform(p, lambda x: x["format_id"]), "+").alias("format_id"),
        F.when(F.size(p) == 1, F.get(p, F.lit(0))["ext"]).otherwise(compatible_ext(p)).alias("ext"),
        F.array_join(F.transform(p, lambda x: x["protocol"]), "+").alias("protocol"),
        only(videos, "vcodec").alias("vcodec"),
        only(audios, "acodec").alias("acodec"),
        only(videos, "width").alias("width"),
        only(videos, "height").alias("height"),
        only(videos, "fps").alias("fps"),
        F.nullif(total(lambda x: pick(x, "filesize", "filesize_approx")), F.lit(0.0)).cast("bigint").alias("filesize_approx"),
        total(lambda x: pick(x, "tbr", "vbr", "abr")).alias("tbr"),
    )


def select_formats(ranked: DataFrame, spec: str, allow_multi: bool = False) -> DataFrame:
    """Choices per media for a selector, with ``choice`` numbering them in the selector's order."""
    tree = _selector_tree(spec)
    if any(name == "all" or _atom(name)[4] > 1 for name in _atoms(tree)):
        got = _evaluate(attach_group(ranked, KEY, **_flags()), tree, allow_multi)
        return number_rows(describe_choices(got), KEY, ["ord", "format_id"], "choice").drop("ord")
    plan = _Aggregated(ranked, allow_multi)
    choices = plan.node(tree, F.lit(True))
    picked = ranked.groupBy("media_id").agg(*[c.alias(n) for n, c in plan.aggs.items()])
    got = picked.select("media_id", F.posexplode(choices).alias("ord", "parts"))
    return describe_choices(got).withColumn("choice", (F.col("ord") + 1).cast("bigint")).drop("ord")


# ---- identifiers, duplicates, display ------------------------------------------------------------


def unique_format_ids(df: DataFrame) -> DataFrame:
    """Selector characters become ``_``, shared ids get ``-i`` and an id that names an extension an ``f``."""
    clean = F.when(F.coalesce(F.length("format_id"), F.lit(0)) == 0, (F.col("format_idx") - 1).cast("string")).otherwise(
        F.regexp_replace("format_id", r"[\s,/+\[\]()]", "_")
    )
    rows = df.withColumn("_id", clean)
    rows = attach_group(number_rows(rows, ["media_id", "_id"], ["format_idx"], "_i"), ["media_id", "_id"], _n=F.count("*"))
    tagged = F.when(F.col("_n") > 1, F.concat("_id", F.lit("-"), (F.col("_i") - 1).cast("string"))).otherwise(F.col("_id"))
    rows = rows.withColumn("_u", tagged)
    clash = (F.col("_u") != F.col("ext")) & F.col("_u").isin([*AUDIO_EXTS, *VIDEO_EXTS, *STORYBOARD_EXTS])
    final = F.when(F.coalesce(clash, F.lit(False)), F.concat(F.lit("f"), "_u")).otherwise(F.col("_u"))
    return rows.withColumn("format_id", final).select(*df.columns)


def dedup_formats(df: DataFrame) -> DataFrame:
    """First format per URL, or per set of fragment URLs where a format has fragments."""
    fragments = F.col("fragment_urls") if "fragment_urls" in df.columns else F.lit(None).cast("array<string>")
    some = F.size(fragments) > 0
    key = F.when(some, F.array_join(F.array_sort(F.array_distinct(fragments)), "\n")).otherwise(F.col("url"))
    rows = df.withColumns({"_kind": F.coalesce(some, F.lit(False)), "_key": key})
    return first_per_key(rows, ["media_id", "_kind", "_key"], ["format_idx"]).select(*df.columns)


def group_quality(df: DataFrame, group: str = "audio_group_id") -> DataFrame:
    """Quality step of each audio group by its first format in (tbr, width) order; lowest and highest are named.

    ``source_preference`` is the group's place from 0 and applies to audio-only formats.
    """
    ranked = df.filter(_has("vcodec") & F.col(group).isNotNull())
    at = F.struct(F.coalesce("tbr", F.lit(0.0)).alias("t"), F.coalesce("width", F.lit(0)).alias("w"), F.col("format_idx").alias("i"))
    groups = ranked.groupBy("media_id", group).agg(F.min(at).alias("_at"))
    groups = attach_group(number_rows(groups, KEY, ["_at"], "_place"), KEY, _n=F.count("*"))
    label = F.when(F.col("_place") == 1, "low").when(F.col("_place") == F.col("_n"), "high")
    groups = groups.filter(F.col("_n") > 1).select("media_id", group, (F.col("_place") - 1).alias("source_preference"), label.alias("quality_note"))
    rows = df.join(groups, ["media_id", group], "left")
    silent = _has("vcodec")
    return rows.withColumns({c: F.when(~silent, F.col(c)) for c in ("source_preference", "quality_note")})


def format_bytes(n: Column, largest: str = "Yi") -> Column:
    """``1.50KiB`` style size in units up to ``largest``; NULL and negative sizes read N/A."""
    steps = ["", "Ki", "Mi", "Gi", "Ti", "Pi", "Ei", "Zi", "Yi"]
    steps = steps[: steps.index(largest) + 1]
    x = n.cast("double")
    e = F.when(x == 0, 0).otherwise(F.least(F.floor(F.log(1024.0, x) + F.lit(1e-12)), F.lit(len(steps) - 1))).cast("int")
    text = F.format_string("%.2f%sB", x / F.pow(F.lit(1024.0), e), F.element_at(F.array(*[F.lit(s) for s in steps]), e + 1))
    return F.when(x >= 0, text).otherwise("N/A")


def display_fields(df: DataFrame, duration: str = "duration") -> DataFrame:
    """Resolution text, aspect ratio, dynamic range, estimated size and the note of a listing."""
    have = set(df.columns)
    opt = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    w, h = F.col("width"), F.col("height")
    real = lambda c: F.coalesce(c, F.lit(0)) != 0
    resolution = (
        F.when((F.col("vcodec") == "none") & _has("acodec"), "audio only")
        .when(opt("resolution", "string").isNotNull(), opt("resolution", "string"))
        .when(real(w) & real(h), F.format_string("%dx%d", w, h))
        .when(real(h), F.concat(h.cast("string"), F.lit("p")))
        .when(real(w), F.format_string("%dx?", w))
    )
    codec_from_ext = F.when(F.col("ext").isin(AUDIO_CODEC_EXTS), F.col("ext"))
    known_size = F.coalesce(opt("filesize", "bigint"), F.lit(0)) != 0
    approx = F.coalesce(opt("filesize_approx", "bigint"), F.when(~known_size, F.floor(F.col(duration) * F.col("tbr") * 125).cast("bigint")))
    rows = df.withColumns(
        {
            "acodec": F.coalesce("acodec", codec_from_ext),
            "resolution": resolution,
            "aspect_ratio": F.bround(F.try_divide(w.cast("double"), h), 2),
            "dynamic_range": F.coalesce(opt("dynamic_range", "string"), F.when(_has("vcodec"), "SDR")),
            "filesize_approx": approx,
        }
    )
    int_of = lambda c: c.cast("bigint")
    vbr, abr = opt("vbr", "double"), opt("abr", "double")
    v_shown = F.col("vcodec").isNotNull() & (F.col("vcodec") != "none")
    v_lead = F.when(v_shown, F.concat("vcodec", F.when(vbr.isNotNull(), "@").otherwise(""))).when(vbr.isNotNull() & abr.isNotNull(), "video@")
    video = F.when(v_lead.isNotNull() | vbr.isNotNull(), F.concat(F.coalesce(v_lead, F.lit("")), F.coalesce(F.format_string("%4dk", int_of(vbr)), F.lit(""))))
    a_lead = F.when(F.col("acodec") == "none", "video only").when(F.col("acodec").isNotNull(), F.format_string("%-5s", F.col("acodec"))).when(abr.isNotNull(), "audio")
    audio = F.when(a_lead.isNotNull(), F.concat(a_lead, F.coalesce(F.format_string("@%3dk", int_of(abr)), F.lit(""))))
    size = F.when(opt("filesize", "bigint").isNotNull(), format_bytes(opt("filesize", "bigint"))).when(
        F.col("filesize_approx").isNotNull(), F.concat(F.lit("~"), format_bytes(F.col("filesize_approx")))
    )
    lead = F.concat_ws(
        " ",
        F.when(F.col("ext").isin("f4f", "f4m"), "(unsupported)"),
        F.when(opt("language", "string").isNotNull(), F.concat(F.lit("["), opt("language", "string"), F.lit("]"))),
        opt("format_note", "string"),
    )
    rate = F.when(F.col("tbr").isNotNull(), F.format_string("%4dk", int_of(F.col("tbr"))))
    fps = F.when(F.col("fps").isNotNull(), F.concat(F.col("fps").cast("string"), F.lit("fps")))
    return rows.withColumn("note", F.concat_ws(", ", F.nullif(lead, F.lit("")), rate, F.when(video.isNotNull(), video), fps, audio, size))
