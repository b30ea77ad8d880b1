"""Metadata helpers as Spark columns: durations, sizes, counts, dates, codecs, names and URLs."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedframe.functions.filters import AMOUNT, BROKEN_UNITS, CLOCK, DATE_UNITS, TIME_UNITS, size_units
from timedframe.semantics import once, strip


def group(text: Column, pattern: str, n: int) -> Column:
    """n-th group of a pattern, NULL where the pattern or the group does not match."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def _sum(parts: list[tuple[Column, float]]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c.try_cast("double"), F.lit(0.0)) * w for c, w in parts])


# ---- durations, sizes, counts --------------------------------------------------------------------

def _lookup(table: dict[str, float], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for name, n in table.items() for x in (name, float(n))]), key)


def _clock_seconds(s: Column) -> Column:
    """Parts between colons, counted from the right; a last part of three digits or more, or a fifth one, is a fraction of a second."""

    def read(parts: Column) -> Column:
        n, last = F.size(parts), F.element_at(parts, -1)
        split = (n > 1) & ((F.length(last) > 2) & ~F.contains(last, F.lit(".")) | (n > 4))
        whole = F.when(split, F.slice(parts, 1, n - 1)).otherwise(parts)
        weights = F.array(*[F.lit(float(w)) for w in (1, 60, 3600, 86400)])
        total = once(
            F.reverse(whole),
            lambda w: F.when(F.size(w) <= 4, F.aggregate(F.zip_with(w, F.slice(weights, 1, F.size(w)), lambda x, y: x.try_cast("double") * y), F.lit(0.0), lambda t, x: t + x)),
        )
        return total + F.when(split, F.concat(F.lit("0."), last).try_cast("double")).otherwise(0.0)

    plain = F.regexp_like(s, F.lit(f"^{CLOCK}$"))
    return F.when(plain, once(F.split(s, ":"), read))


def _amounts(s: Column, units: list[tuple[list[str], int]]) -> Column:
    """Sum of ``number unit`` pairs that fill the whole text, from large to small units; NULL for anything else.

    Only seconds may have a fraction.
    """
    rest = F.regexp_replace(s, AMOUNT + r",?\s*", "")
    place = {name: i for i, (names, _) in enumerate(units) for name in names}
    weights = F.array(*[F.lit(float(w)) for _, w in units])

    def read(pairs: Column) -> Column:
        ordered = F.forall(F.transform(pairs, lambda p, i: (i == 0) | (p["u"] > F.get(pairs, i - 1)["u"])), lambda x: x)
        known = F.forall(pairs, lambda p: p["u"].isNotNull() & (~F.contains(p["n"], F.lit(".")) | (F.get(weights, p["u"]) == 1)))
        return F.when(known & ordered, F.aggregate(pairs, F.lit(0.0), lambda t, p: t + p["n"].cast("double") * F.get(weights, p["u"])))

    numbers, names = (F.regexp_extract_all(s, F.lit(AMOUNT), F.lit(i)) for i in (1, 2))
    return F.when(rest == "", once(F.zip_with(numbers, names, lambda n, u: F.struct(n.alias("n"), _lookup(place, u).cast("int").alias("u"))), read))


def parse_duration(text: Column) -> Column:
    """Seconds of ``1:02:03.5``, ``P1DT2H``, ``1h 5m`` or ``2.5 hours``; years, months and weeks count nothing."""

    def read(s: Column) -> Column:
        marked = F.regexp_like(s, F.lit(r"t(\d|$)"))  # the letter between date and time
        at = F.length(F.regexp_extract(s, r"^(.*?)t(?:\d|$)", 1))
        date = F.regexp_replace(F.left(s, at), "^p", "")
        spoken = F.when(marked, _amounts(date, DATE_UNITS) + _amounts(F.substring(s, at + 2, F.length(s)), TIME_UNITS)).otherwise(_amounts(s, TIME_UNITS))
        number = F.regexp_extract(s, r"^([\d.]+)", 1)
        loose = number.try_cast("double") * _lookup(BROKEN_UNITS, strip(F.substring(s, F.length(number) + 1, F.length(s))))
        return F.when(F.regexp_like(s, F.lit("[a-z]")), F.coalesce(spoken, loose)).otherwise(_clock_seconds(s))

    return once(F.regexp_replace(F.lower(strip(text)), "z$", ""), read)


NUMBER = r"\d+(?:[.,]\d+)?"


def _scaled(number: Column, unit: Column, units: dict[str, int]) -> Column:
    """Whole count of a decimal number in a unit of the table; a comma is a decimal point."""
    value = F.when(F.regexp_like(number, F.lit(f"^{NUMBER}$")), F.translate(number, ",", ".").try_cast("double"))
    return F.bround(value * _lookup(units, unit)).cast("bigint")


WORD = r"[A-Za-z]++(?![A-Za-z0-9_])|(?<=\s)|$"


def _first_amount(text: Column, lead: str, number: str, unit: str = WORD) -> tuple[Column, Column, Column]:
    """Number, blanks and unit of the amount after a lead; what the number can take it keeps."""
    shape = rf"{lead}((?>{number}))(\s*+)({unit})"
    return tuple(F.regexp_extract(text, shape, i) for i in (1, 2, 3))


def parse_filesize(text: Column) -> Column:
    number, _, unit = _first_amount(text, "^", NUMBER)
    return _scaled(number, unit, size_units())


COUNT_UNITS = {"k": 10**3, "K": 10**3, "m": 10**6, "M": 10**6, "kk": 10**6, "KK": 10**6, "b": 10**9, "B": 10**9}


def parse_count(text: Column) -> Column:
    """``1.2M``, ``1,234 views`` or ``views: 900``; without a unit, commas and points only part thousands."""
    number, gap, unit = _first_amount(strip(text), r"^(?:\D*\s)?", r"[\d,.]+")
    plain = F.translate(number, ",.", "").try_cast("bigint")
    return F.coalesce(_scaled(number, unit, COUNT_UNITS), F.when((unit == "") | (gap != ""), plain))


def parse_bitrate(text: Column) -> Column:
    number, _, _ = _first_amount(text, r"\b", r"\d+", "kbps")
    return number.try_cast("bigint")


def parse_resolution(text: Column) -> Column:
    """``1920x1080``, ``720p60`` or ``4k`` that stand by themselves: width, height and frame rate; a box goes before lines, these before ``k``."""

    def numbers(shape: str, inside: str) -> Column:
        """The numbers of the first word of a shape, NULL where there is none."""
        word = F.regexp_extract(F.lower(text), f"(?<!{inside}){shape}(?!{inside})", 0)
        return F.when(word != "", F.split(word, r"\D+"))

    box, lines, kilo = numbers(r"\d+\s*[x×,]\s*\d+", "[a-z0-9]"), numbers(r"\d+[pi](?:\d{2,3})?", "[a-z0-9]"), numbers(r"[48]k(?:\d{2,3})?", r"\w")
    at = lambda c, i: F.get(c, i).try_cast("int")
    return F.struct(
        at(box, 0).alias("width"),
        F.coalesce(at(box, 1), at(lines, 0), at(kilo, 0) * 540).alias("height"),
        F.when(box.isNull(), at(F.coalesce(lines, kilo), 1)).alias("fps"),
    )


# Codec families by stream
VIDEO_CODECS = ["avc1", "avc2", "avc3", "avc4", "vp9", "vp8", "hev1", "hev2", "h263", "h264", "mp4v", "hvc1", "av1", "theora", "dvh1", "dvhe"]
AUDIO_CODECS = ["flac", "mp4a", "opus", "vorbis", "mp3", "aac", "ac-4", "ac-3", "ec-3", "eac3", "dtsc", "dtse", "dtsh", "dtsl"]
TEXT_CODECS = ["stpp", "wvtt"]


def parse_codecs(text: Column) -> Column:
    """First video, audio and subtitle codec of a list, with the dynamic range the video codec implies."""
    raw = F.filter(F.transform(F.split(text, ","), strip), lambda c: F.length(c) > 0)
    named = F.transform(raw, lambda c: F.concat(F.lower(F.regexp_extract(c, r"^[^.]+", 0)), F.regexp_replace(c, r"^[^.]+", "")))
    head = lambda c: F.regexp_replace(F.get(F.split(c, r"\."), F.lit(0)), r"0+(?=\d)", "")
    first = lambda family: F.get(F.filter(named, lambda c: head(c).isin(family)), F.lit(0))
    v, a, s = first(VIDEO_CODECS), first(AUDIO_CODECS), first(TEXT_CODECS)
    part = lambda i: F.regexp_replace(F.get(F.split(v, r"\."), F.lit(i)), r"^0+(?=\d)", "")
    hdr = F.when(head(v).isin("dvh1", "dvhe"), "DV").when((head(v) == "av1") & (part(3) == "10"), "HDR10").when((head(v) == "vp9") & (part(1) == "2"), "HDR10")
    some = v.isNotNull() | a.isNotNull() | s.isNotNull()
    pair = ~some & (F.size(raw) == 2)
    return F.struct(
        F.when(some, F.coalesce(v, F.lit("none"))).when(pair, F.get(raw, F.lit(0))).alias("vcodec"),
        F.when(some, F.coalesce(a, F.lit("none"))).when(pair, F.get(raw, F.lit(1))).alias("acodec"),
        s.alias("scodec"),
        F.when(some, hdr).alias("dynamic_range"),
    )


# ---- dates ---------------------------------------------------------------------------------------

# Fixed values
ZONES = {"ut": 0, "utc": 0, "gmt": 0, "z": 0, "ast": -4, "adt": -3, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
WEEKDAY_WORDS = [*WEEKDAYS, *[d[:3] for d in WEEKDAYS], "tues", "thurs", "at"]

TIME = r"(\d\d?)[:.](\d\d?)(?::(\d\d?)(?:\.\d+)?)?"
#: Shapes of a date: pattern of the date, then the groups that hold year, month and day.
NAMED_SHAPES = [(r"(\d\d?)(?:st|nd|rd|th)?[ -]([a-z]+)[ -](\d{4})", (3, 2, 1)), (r"([a-z]+) (\d\d?)(?:st|nd|rd|th)? (\d{4})", (3, 1, 2))]
YEAR_FIRST = [(r"(\d{4})[-/. ](\d\d?)[-/. ](\d\d?)\.?", (1, 2, 3))]
COMPACT = r"^(\d{4})(\d\d)(\d\d)(?:(\d\d)(\d\d)(\d\d)?)?$"
SHORT_SHAPE = r"(\d\d?)[-/.](\d\d?)[-/.](\d{4}|\d\d)"


def _month_number(name: Column) -> Column:
    table = {m: i for i, m in enumerate(MONTHS, 1)} | {m[:3]: i for i, m in enumerate(MONTHS, 1)} | {"sept": 9}
    return F.coalesce(_lookup(table, name), name.try_cast("double")).cast("int")


def _moment(s: Column, shape: str, places: tuple[int, int, int]) -> Column:
    """Timestamp of a date of one shape, alone, before a time or after it; NULL where the text is another shape or no such day."""
    parts = shape.replace("(?:", "").count("(")
    after, before = f"^{shape}(?:(?:t| ){TIME})?$", f"^{TIME} {shape}$"

    def build(pattern: str, date: int, time: int) -> Column:
        y, m, d = (group(s, pattern, date + p) for p in places)
        year = y.try_cast("int")
        year = F.when(F.length(y) == 2, F.when(year < 69, year + 2000).otherwise(year + 1900)).otherwise(year)
        h, mi, sec = (F.coalesce(group(s, pattern, time + i).try_cast("int"), F.lit(0)) for i in (1, 2, 3))
        return F.when(s.rlike(pattern), F.try_make_timestamp(year, _month_number(m), d.try_cast("int"), h, mi, sec.cast("decimal(8,6)")))

    return F.coalesce(build(after, 0, parts), build(before, 3, 0))


def _read_date(s: Column, day_first: bool) -> Column:
    compact = [F.coalesce(group(s, COMPACT, i).try_cast("int"), F.lit(0)) for i in range(1, 7)]
    joined = F.when(s.rlike(COMPACT), F.try_make_timestamp(*compact[:5], compact[5].cast("decimal(8,6)")))
    shapes = [*NAMED_SHAPES, *YEAR_FIRST, (SHORT_SHAPE, (3, 2, 1) if day_first else (3, 1, 2))]
    return F.coalesce(joined, *[_moment(s, shape, places) for shape, places in shapes])


def _words(text: Column) -> Column:
    """Lower-case words in single blanks, without weekdays and marks between parts."""
    words = F.split(strip(F.regexp_replace(F.lower(text), "[,|]", " ")), r"\s+")
    return F.array_join(F.filter(words, lambda w: ~w.isin(WEEKDAY_WORDS)), " ")


NUMERIC_ZONE = r"^(.*(?:\d:\d\d(?:\.\d+)?|\d{4})) ?([+-])(\d\d):?(\d\d)$"
LETTER_ZONE = r"^(.*\d:\d\d?(?:\.\d+)?) ?([a-z]+)$"
HALF_OF_DAY = r"^(.*\d) ?(am|pm)(?: [a-z]+)?$"


def _split_zone(s: Column) -> tuple[Column, Column]:
    """Lower-case text without its zone, and the zone's offset in seconds (NULL when there is none that is known)."""
    sign = F.when(group(s, NUMERIC_ZONE, 2) == "-", -1).otherwise(1)
    offset = sign * (group(s, NUMERIC_ZONE, 3).cast("int") * 3600 + group(s, NUMERIC_ZONE, 4).cast("int") * 60)
    numeric, lettered = s.rlike(NUMERIC_ZONE), s.rlike(LETTER_ZONE) & ~s.rlike(HALF_OF_DAY)
    named = F.when(lettered, _lookup(ZONES, group(s, LETTER_ZONE, 2)) * 3600).cast("int")
    bare = F.when(numeric, group(s, NUMERIC_ZONE, 1)).when(lettered, group(s, LETTER_ZONE, 1)).otherwise(s)
    return bare, F.when(numeric, offset).otherwise(named)


def parse_iso8601(text: Column) -> Column:
    """Epoch seconds of an ISO date-time; the offset is taken off, fractions are dropped."""
    bare, offset = _split_zone(F.lower(F.regexp_replace(text, r"\.[0-9]+", "")))
    whole = F.try_to_timestamp(F.upper(bare), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return F.unix_seconds(whole) - F.coalesce(offset, F.lit(0))


def _read_moment(text: Column, day_first: bool) -> Column:
    """Struct of the local time, its zone's offset and whether it is marked as afternoon."""

    def read(s: Column) -> Column:
        bare, offset = _split_zone(s)
        half = once(bare, lambda b: F.when(b.rlike(HALF_OF_DAY), group(b, HALF_OF_DAY, 1)).otherwise(b))
        found = once(half, lambda b: _read_date(strip(b), day_first))
        return F.struct(found.alias("at"), offset.alias("offset"), F.regexp_like(s, F.lit(r"\d ?pm\b")).alias("pm"))

    return once(_words(text), read)


def unified_date(text: Column, day_first: bool = True) -> Column:
    """``YYYYMMDD`` of a free date."""
    return F.date_format(_read_moment(text, day_first)["at"], "yyyyMMdd")


def unified_timestamp(text: Column, day_first: bool = True) -> Column:
    """Epoch seconds of a free date-time; a zone's offset is taken off, ``pm`` adds twelve hours."""
    return once(
        _read_moment(text, day_first),
        lambda m: F.unix_seconds(m["at"]) - F.coalesce(m["offset"], F.lit(0)) + F.when(m["pm"], 12 * 3600).otherwise(0),
    )


def add_months(day: Column, n: int) -> Column:
    """Month arithmetic that clamps to the month's last day."""
    return F.add_months(day, n)


def round_time(ts: Column, precision: str = "day") -> Column:
    """Epoch seconds rounded half up to a day, hour, minute or second."""
    n = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[precision]
    return (F.floor((F.unix_micros(ts) / F.lit(1e6) + n / 2) / n) * n).cast("bigint")


# ---- ratings, languages, coercion ----------------------------------------------------------------

# Fixed values
AGE_RATINGS = {
    "G": 0, "PG": 10, "PG-13": 13, "R": 16, "NC": 18,
    "TV-Y": 0, "TV-Y7": 7, "TV-G": 0, "TV-PG": 0, "TV-14": 14, "TV-MA": 17,
}
# Two-letter and three-letter codes of languages; a repeated three-letter code is an older spelling.
LANGUAGES = dict(
    pair.split(":")
    for pair in """
    aa:aar ab:abk ae:ave af:afr ak:aka am:amh an:arg ar:ara as:asm av:ava ay:aym az:aze ba:bak be:bel bg:bul bh:bih bi:bis bm:bam bn:ben
    bo:bod br:bre bs:bos ca:cat ce:che ch:cha co:cos cr:cre cs:ces cu:chu cv:chv cy:cym da:dan de:deu dv:div dz:dzo ee:ewe el:ell en:eng
    eo:epo es:spa et:est eu:eus fa:fas ff:ful fi:fin fj:fij fo:fao fr:fra fy:fry ga:gle gd:gla gl:glg gn:grn gu:guj gv:glv ha:hau he:heb
    iw:heb hi:hin ho:hmo hr:hrv ht:hat hu:hun hy:hye hz:her ia:ina id:ind in:ind ie:ile ig:ibo ii:iii ik:ipk io:ido is:isl it:ita iu:iku
    ja:jpn jv:jav ka:kat kg:kon ki:kik kj:kua kk:kaz kl:kal km:khm kn:kan ko:kor kr:kau ks:kas ku:kur kv:kom kw:cor ky:kir la:lat lb:ltz
    lg:lug li:lim ln:lin lo:lao lt:lit lu:lub lv:lav mg:mlg mh:mah mi:mri mk:mkd ml:mal mn:mon mr:mar ms:msa mt:mlt my:mya na:nau nb:nob
    nd:nde ne:nep ng:ndo nl:nld nn:nno no:nor nr:nbl nv:nav ny:nya oc:oci oj:oji om:orm or:ori os:oss pa:pan pe:per pi:pli pl:pol ps:pus
    pt:por qu:que rm:roh rn:run ro:ron ru:rus rw:kin sa:san sc:srd sd:snd se:sme sg:sag si:sin sk:slk sl:slv sm:smo sn:sna so:som sq:sqi
    sr:srp ss:ssw st:sot su:sun sv:swe sw:swa ta:tam te:tel tg:tgk th:tha ti:tir tk:tuk tl:tgl tn:tsn to:ton tr:tur ts:tso tt:tat tw:twi
    ty:tah ug:uig uk:ukr ur:urd uz:uzb ve:ven vi:vie vo:vol wa:wln wo:wol xh:xho yi:yid ji:yid yo:yor za:zha zh:zho zu:zul
    """.split()
)


def parse_age(text: Column) -> Column:
    """Least age of a rating's name, or of one or two digits with or without a plus sign; the hyphen after ``TV`` may be left out or low."""
    names = {spelled: age for name, age in AGE_RATINGS.items() for spelled in {name, name.replace("TV-", "TV_"), name.replace("TV-", "TV")}}
    s = F.upper(text)
    bare = F.when(F.endswith(s, F.lit("+")), F.left(s, F.length(s) - 1)).otherwise(s)
    digits = (F.translate(bare, "0123456789", "") == "") & F.length(bare).between(1, 2)
    return F.when(digits, bare.try_cast("int")).otherwise(_lookup(names, s).cast("int"))


def long_language(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.substring(code, 1, 2))


def short_language(code: Column) -> Column:
    first = {v: k for k, v in reversed(LANGUAGES.items())}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), code)


def int_or_none(c: Column, scale: int = 1, invscale: int = 1) -> Column:
    return F.floor(strip(c.cast("string")).try_cast("bigint") * invscale / scale).cast("bigint")


def float_or_none(c: Column, scale: float = 1.0, invscale: float = 1.0) -> Column:
    return strip(c.cast("string")).try_cast("double") * F.lit(float(invscale)) / F.lit(float(scale))


def str_to_int(c: Column) -> Column:
    return F.regexp_replace(c, r"[,.+]|\s", "").try_cast("bigint")


def bool_or_none(c: Column) -> Column:
    return F.when(F.lower(c) == "true", True).when(F.lower(c) == "false", False)


def strip_or_none(c: Column) -> Column:
    return strip(c)


def decimal_suffix(n: Column, largest: str = "Y") -> Column:
    """``1k``, ``2M`` … in steps of 1000 up to ``largest``, whole numbers."""
    steps = ["", "k", "M", "G", "T", "P", "E", "Z", "Y"]
    steps = steps[: steps.index(largest) + 1]
    x = n.cast("double")
    e = F.when(x == 0, 0).otherwise(F.least(F.floor(F.log(1000.0, x) + F.lit(1e-12)), F.lit(len(steps) - 1))).cast("int")
    return F.when(x >= 0, F.concat(F.floor(x / F.pow(F.lit(1000.0), e)).cast("string"), F.element_at(F.array(*[F.lit(s) for s in steps]), e + 1)))


def clock_text(seconds: Column) -> Column:
    """``h:mm:ss``, ``m:ss`` or ``s``."""
    t = F.floor(seconds).cast("bigint")
    h, m, s = F.floor(t / 3600), F.floor(t / 60) % 60, t % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).when(m > 0, F.format_string("%d:%02d", m, s)).otherwise(F.format_string("%d", s))


def hms_seconds(text: Column) -> Column:
    """Seconds of ``SS``, ``MM:SS`` or ``HH:MM:SS``; NULL for anything else."""
    ok = text.rlike(r"^\d+(?::\d+){0,2}(?:\.\d+)?$")
    return F.when(ok, F.aggregate(F.split(text, ":"), F.lit(0.0), lambda a, p: a * 60 + p.cast("double")))


def trim_error(start: Column, end: Column) -> Column:
    a, b = hms_seconds(start), hms_seconds(end)
    return F.when(a.isNull() | b.isNull(), "invalid time").when(b <= a, "end must come after start")


def availability(private: Column, premium: Column, subscription: Column, auth: Column, unlisted: Column) -> Column:
    every = reduce(lambda x, y: x & y, [c.isNotNull() for c in (private, premium, subscription, auth, unlisted)])
    return F.when(private, "private").when(premium, "premium_only").when(subscription, "subscriber_only").when(auth, "needs_auth").when(unlisted, "unlisted").when(every, "public")


# ---- subtitle clocks -----------------------------------------------------------------------------


def _pad(c: Column, n: int) -> Column:
    text = c.cast("bigint").cast("string")
    return F.when(F.length(text) >= n, text).otherwise(F.lpad(text, n, "0"))


def srt_time(seconds: Column, sep: str = ",") -> Column:
    """``HH:MM:SS,mmm``."""
    ms = F.bround(seconds * 1000).cast("bigint")
    return F.concat(
        _pad(F.floor(ms / 3600000), 2), F.lit(":"), _pad(F.floor(ms / 60000) % 60, 2), F.lit(":"), _pad(F.floor(ms / 1000) % 60, 2), F.lit(sep), _pad(ms % 1000, 3)
    )


def ass_time(seconds: Column) -> Column:
    """``H:MM:SS.cc``."""
    cs = F.bround(seconds * 100).cast("bigint")
    return F.concat(F.floor(cs / 360000).cast("string"), F.lit(":"), _pad(F.floor(cs / 6000) % 60, 2), F.lit(":"), _pad(F.floor(cs / 100) % 60, 2), F.lit("."), _pad(cs % 100, 2))


def srt_seconds(text: Column) -> Column:
    p = r"^(\d+):(\d{2}):(\d{2})[,.](\d{3})$"
    return _sum([(group(text, p, 1), 3600), (group(text, p, 2), 60), (group(text, p, 3), 1), (group(text, p, 4), 0.001)])


def dfxp_seconds(text: Column) -> Column:
    """``12.5s`` or ``HH:MM:SS[.fff|:ff]``; NULL otherwise."""
    plain, clock = r"^(\d+(?:\.\d+)?)s?$", r"^(\d+):(\d\d):(\d\d(?:(?:\.|:)\d+)?)$"
    secs = F.regexp_replace(group(text, clock, 3), ":", ".")
    return F.when(text.rlike(plain), group(text, plain, 1).try_cast("double")).when(
        text.rlike(clock), _sum([(group(text, clock, 1), 3600), (group(text, clock, 2), 60), (secs, 1)])
    )


# ---- names and texts -----------------------------------------------------------------------------


def _accents() -> tuple[str, str]:
    """Letters that decompose to one ASCII character, and those characters; found by rule."""
    pairs = []
    for cp in range(0xA0, 0x2100):
        flat = unicodedata.normalize("NFKD", chr(cp)).encode("ascii", "ignore").decode()
        if len(flat) == 1:
            pairs.append((chr(cp), flat))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_ascii(text: Column) -> Column:
    """Accented letters to their base, other non-ASCII characters removed."""
    a, b = _accents()
    return F.regexp_replace(F.translate(text, a, b), r"[^\x00-\x7F]", "")


def slugify(text: Column, size: int = 60) -> Column:
    slug = F.regexp_replace(F.lower(fold_ascii(text)), "[^a-z0-9]+", "-")
    return F.nullif(F.substring(F.regexp_replace(slug, "^-+|-+$", ""), 1, size), F.lit(""))


def clean_name(text: Column, size: int = 60) -> Column:
    """File-safe name: no slashes or control characters, white space to ``_``."""
    s = F.regexp_replace(strip(text), r"[/\\\x00-\x1f]", "")
    return F.nullif(F.substring(F.regexp_replace(s, r"(?U)\s+", "_"), 1, size), F.lit(""))


def sanitize_filename(text: Column) -> Column:
    """Unsafe characters become their full-width forms, control characters go, times use ``_``."""
    s = F.regexp_replace(text, r"(?<=[0-9]):(?=[0-9])", "_")
    s = F.regexp_replace(s, "\n", " ")
    s = F.translate(s, '"*:<>?|/\\', "＂＊：＜＞？｜⧸⧹")
    s = F.regexp_replace(s, r"[\x00-\x1f\x7f]", "")
    return F.when(F.length(text) == 0, "").otherwise(F.coalesce(F.nullif(s, F.lit("")), F.lit("_")))


def truncate(text: Column, left: int, right: int = 0) -> Column:
    """Head and tail of a long text around an ellipsis."""
    if right == 0:
        return F.when(F.length(text) > left, F.concat(F.substring(text, 1, left - 3), F.lit("..."))).otherwise(text)
    return F.when(F.length(text) > left + right, F.concat(F.substring(text, 1, left - 3), F.lit("..."), F.right(text, F.lit(right)))).otherwise(text)


def join_nonempty(*cols: Column, sep: str = "-") -> Column:
    return F.concat_ws(sep, *[F.nullif(c.cast("string"), F.lit("")) for c in cols])


def strip_jsonp(text: Column) -> Column:
    """The argument of a callback call such as ``cb && cb({...}); // note``; other texts stay as they are."""
    call = F.regexp_replace(F.regexp_replace(text, r"(\s*//[^\n]*)+\s*$", ""), r"\s*;?\s*$", "")
    opened = F.instr(call, "(")
    name = F.left(call, opened - 1)
    inside = F.ltrim(F.regexp_replace(F.substring(call, opened + 1, F.length(call) - opened - 1), r"^\s+", ""))
    return F.when((opened > 0) & F.endswith(call, F.lit(")")) & name.rlike(r"^[A-Za-z0-9_.$&\s]*$"), inside).otherwise(text)


# ---- URLs ----------------------------------------------------------------------------------------


def url_basename(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.element_at(F.split(F.regexp_replace(path, "^/+|/+$", ""), "/"), -1)


def sanitize_url(url: Column, scheme: str = "http") -> Column:
    s = F.when(url.startswith("//"), F.concat(F.lit(scheme + ":"), url)).otherwise(url)
    return F.regexp_replace(F.regexp_replace(s, "^httpss://", "https://"), "^rmtp([es]?)://", "rtmp$1://")


def update_query(url: Column, key: str, value: Column) -> Column:
    """URL with one query parameter set; the other parameters keep their order."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    frag = F.regexp_extract(url, r"(#.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (F.length(p) > 0) & ~p.startswith(key + "="))
    return F.concat(base, F.lit("?"), F.array_join(F.concat(kept, F.array(F.concat(F.lit(key + "="), F.url_encode(value)))), "&"), frag)


def urljoin(base: Column, path: Column) -> Column:
    """Path resolved against an http base (absolute, root-relative or in the same folder)."""
    root = F.regexp_extract(base, r"^((?:https?:)?//[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^((?:https?:)?//[^?#]*/)", 1)
    usable = base.rlike("^(?:https?:)?//")
    return (
        F.when(F.coalesce(F.length(path), F.lit(0)) == 0, None)
        .when(path.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+-.]*:)?//"), path)
        .when(usable & path.startswith("/"), F.concat(root, path))
        .when(usable, F.concat(F.when(F.length(folder) > F.length(root) + 1, folder).otherwise(F.concat(root, F.lit("/"))), path))
    )


# Trackers that stand before a podcast's own address; those of the first list may be followed by an account's name
TRACKERS_WITH_ACCOUNT = ["chtbl.com/track", "media.blubrry.com", "play.podtrac.com", "chrt.fm/track", "mgln.ai/e"]
TRACKERS = ["flex.acast.com", "pdcn.co/e", "pdst.fm/e", "pscrb.fm/rss/p", *[f"{i}.gum.fm" for i in range(10)]]
REDIRECTS = [f"{host}/{folder}redirect." for host in ("dts.podtrac.com", "www.podtrac.com") for folder in ("", "pts/")]


def clean_podcast_url(url: Column) -> Column:
    """The address without the trackers on the way to it."""
    any_of = lambda names: "(?:" + "|".join(re.escape(n) for n in names) + ")"
    hops = [any_of(TRACKERS_WITH_ACCOUNT) + "(?:/[^/.]+)?/", any_of(REDIRECTS) + "[0-9a-z]{3,4}/", any_of(TRACKERS) + "/"]
    bare = F.regexp_replace(url, "|".join(hops), "")
    return F.regexp_replace(bare, r"^\w+://(?=\w+://)", "")


def normalize_video_url(url: Column) -> Column:
    """A page that shows a video in an overlay (``modal_id``) is rewritten to the video's own address."""
    s = strip(url)
    host = F.lower(F.regexp_extract(s, r"^[A-Za-z]+://([^/?#:]*)", 1))
    modal = group(s, r"[?&]modal_id=(\d+)(?:[&#]|$)", 1)
    ours = (host == "douyin.com") | host.endswith(".douyin.com")
    return F.when(ours & modal.isNotNull(), F.concat(F.lit("https://www.douyin.com/video/"), modal)).otherwise(s)


# ---- media records -------------------------------------------------------------------------------

NUMERIC_FIELDS = ["timestamp", "release_timestamp", "duration", "view_count", "like_count", "age_limit", "release_year", "season_number", "episode_number", "chapter_number"]
DATED = [("timestamp", "upload_date"), ("release_timestamp", "release_date"), ("modified_timestamp", "modified_date")]


def coerce_fields(df: DataFrame) -> DataFrame:
    """Known numeric fields held as text become integers, section bounds give the duration, negatives are dropped."""
    out = df
    for c in NUMERIC_FIELDS:
        if c in out.columns and dict(out.dtypes)[c] == "string":
            out = out.withColumn(c, int_or_none(F.col(c)))
    if {"section_start", "section_end"} <= set(out.columns):
        own = F.when((F.col("section_end") != 0) & F.col("section_start").isNotNull(), F.bround(F.col("section_end") - F.col("section_start"), 3))
        out = out.withColumn("duration", F.coalesce(own, F.col("duration").cast("double")))
    if "duration" in out.columns:
        out = out.withColumn("duration", F.when(F.col("duration") > 0, F.col("duration")))
    return out


def fill_common_fields(df: DataFrame) -> DataFrame:
    """Dates from timestamps, release year, live status and its flags, numbered titles, list and comma text."""
    out, have = df, set(df.columns)
    if "title" in have and {"extractor", "id"} <= have:
        generic = F.concat(F.replace("extractor", F.lit(":"), F.lit("-")), F.lit(" video #"), F.col("id").cast("string"))
        out = out.withColumns({"fulltitle": F.col("title"), "title": F.coalesce(F.nullif("title", F.lit("")), generic)})
    if "duration" in have:
        out = out.withColumn("duration_string", clock_text(F.col("duration")))
    for ts, day in DATED:
        if ts in have:
            from_ts = F.date_format(F.timestamp_seconds(F.col(ts)), "yyyyMMdd")
            out = out.withColumn(day, F.coalesce(F.col(day), from_ts) if day in have else from_ts)
    if "release_date" in out.columns:
        year = F.substring("release_date", 1, 4).try_cast("int")
        out = out.withColumn("release_year", F.coalesce(F.nullif(F.col("release_year").cast("int"), F.lit(0)), year) if "release_year" in have else year)
    if {"is_live", "was_live", "live_status"} <= have:
        live, was = F.col("is_live"), F.col("was_live")
        status = F.coalesce(
            "live_status",
            F.when(live, "is_live").when((live == False) & was, "was_live").when((live == False) & (was == False), "not_live"),  # noqa: E712
        )
        out = out.withColumn("live_status", status)
        ended = F.col("live_status") == "post_live"
        out = out.withColumns(
            {
                "is_live": F.coalesce(live, F.col("live_status") == "is_live"),
                "was_live": F.when(ended, True).otherwise(F.coalesce(was, F.col("live_status") == "was_live")),
            }
        )
    for f in ("chapter", "season", "episode"):
        if f"{f}_number" in have and f in have:
            named = F.when(F.col(f"{f}_number").isNotNull(), F.concat(F.lit(f.capitalize() + " "), F.col(f"{f}_number").cast("string")))
            out = out.withColumn(f, F.coalesce(F.nullif(f, F.lit("")), named))
    for old, new in (("artist", "artists"), ("creator", "creators"), ("genre", "genres")):
        if old in have and new in have:
            as_list = F.split(F.nullif(old, F.lit("")), ", ")
            as_text = F.array_join(F.transform(new, lambda v: F.replace(v, F.lit(","), F.lit("，"))), ", ")
            out = out.withColumns({new: F.coalesce(new, as_list), old: F.coalesce(F.nullif(old, F.lit("")), F.when(F.size(new) > 0, as_text))})
    return out


def normalize_media(df: DataFrame) -> DataFrame:
    """The media-record job: coercion, then common fields, all as column expressions in one projection chain."""
    return fill_common_fields(coerce_fields(df))
