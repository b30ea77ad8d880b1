"""Format sort specs turned into Spark sort columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedframe.functions.filters import size_literal

# The fields of the default order, and for ordered fields their values from best to worst
DEFAULT_ORDER = [
    "hidden", "aud_or_vid", "hasvid", "ie_pref", "lang", "quality", "res", "fps", "hdr:12", "vcodec", "channels",
    "acodec", "size", "br", "asr", "proto", "ext", "hasaud", "source", "id",
]
FORCED = ["hidden", "aud_or_vid"]
PRIORITY = ["hasvid", "ie_pref"]
ORDERED = {
    "vcodec": ("vcodec", True, ["av0?1", r"vp0?9\.0?2", "vp0?9", "[hx]265|he?vc?", "[hx]264|avc", "vp0?8", "mp4v|h263", "theora", "", None, "none"]),
    "acodec": ("acodec", True, ["[af]lac", "wav|aiff", "opus", "vorbis|ogg", "aac", "mp?4a?", "mp3", "ac-?4", "e-?a?c-?3", "ac-?3", "dts", "", None, "none"]),
    "hdr": ("dynamic_range", True, ["dv", "(hdr)?12", r"(hdr)?10\+", "(hdr)?10", "hlg", "", "sdr", None]),
    "proto": ("protocol", True, ["(ht|f)tps", "(ht|f)tp$", "m3u8.*", ".*dash", "websocket_frag", "rtmpe?", "", "ws|websocket", "f4"]),
    "vext": ("video_ext", False, ["mp4", "mov", "webm", "flv", "", "none"]),
    "aext": ("audio_ext", True, ["m4a", "aac", "mp3", "ogg", "opus", "web[am]", "", "none"]),
}
FREE_FIRST = {
    "vext": ["webm", "mp4", "mov", "flv", "", "none"],
    "aext": ["ogg", "opus", "web[am]", "mp3", "m4a", "aac", "", "none"],
}
NUMBERS = {
    "lang": ("language_preference", -1.0), "quality": ("quality", -1.0), "source": ("source_preference", -1.0),
    "filesize": ("filesize", None), "fs_approx": ("filesize_approx", None), "height": ("height", None), "width": ("width", None),
    "fps": ("fps", None), "channels": ("audio_channels", None), "tbr": ("tbr", None), "vbr": ("vbr", None), "abr": ("abr", None), "asr": ("asr", None),
}
COMBINED = {"codec": ["vcodec", "acodec"], "ext": ["vext", "aext"]}
ALIASES = {
    "format_id": "id", "preference": "ie_pref", "language_preference": "lang", "source_preference": "source", "protocol": "proto",
    "filesize_approx": "fs_approx", "audio_channels": "channels", "dimension": "res", "resolution": "res", "extension": "ext",
    "bitrate": "br", "total_bitrate": "tbr", "video_bitrate": "vbr", "audio_bitrate": "abr", "framerate": "fps",
    "filesize_estimate": "size", "samplerate": "asr", "video_ext": "vext", "audio_ext": "aext", "video_codec": "vcodec",
    "audio_codec": "acodec", "video": "hasvid", "has_video": "hasvid", "audio": "hasaud", "has_audio": "hasaud",
    "extractor": "ie_pref", "extractor_preference": "ie_pref",
}
SIZES = {"filesize", "fs_approx", "size"}


def order_rank(value: Column, values: Sequence[str | None], regex: bool) -> Column:
    """Place of a value in a best-to-worst list, higher is better; unknown ones rank where ``''`` stands."""
    n = len(values)
    blank = values.index("") if "" in values else n + 1
    rank = F.lit(n - blank)
    for i, v in reversed(list(enumerate(values))):
        if v:
            hit = value.rlike("^(?:" + v + ")") if regex else value == v
            rank = F.when(hit, n - i).otherwise(rank)
    return F.when(value.isNull(), n - (values.index(None) if None in values else blank)).otherwise(rank)


def parse_spec(user: Sequence[str], source: Sequence[str] = (), force: bool = False, defaults: bool = True) -> list[tuple[str, bool, bool, str | None]]:
    """(field, reverse, closest, limit) in effective order; the first mention of a field wins.  Without ``defaults`` no field of the default order follows."""
    out: dict[str, tuple[str, bool, bool, str | None]] = {}
    for item in [*FORCED, *([] if force else PRIORITY), *user, *source, *(DEFAULT_ORDER if defaults else [])]:
        m = re.fullmatch(r" *(?:(?P<rev>\+)?(?P<field>[a-zA-Z0-9_]+)(?:(?P<sep>[~:])(?P<limit>.*?))?)? *", item)
        if not m:
            raise ValueError(f"invalid sort item {item!r}")
        if not m["field"]:
            continue
        field = ALIASES.get(m["field"].lower(), m["field"].lower())
        fields = COMBINED.get(field, [field])
        limits = m["limit"].split(":") if m["limit"] is not None and len(fields) > 1 else [m["limit"]]
        for i, f in enumerate(fields):
            limit = limits[i] if i < len(limits) else None
            out.setdefault(f, (f, m["rev"] is not None, m["sep"] == "~", limit))
    return list(out.values())


def _truthy(c: Column) -> Column:
    return F.when(c != 0, c)


def _value(df: DataFrame, field: str, free_first: bool) -> tuple[Column | None, bool]:
    """Value column of a field and whether it is text; None when the table cannot tell rows apart by it."""
    have = set(df.columns)
    num = lambda c: F.col(c).cast("double") if c in have else F.lit(None).cast("double")
    if field in ("hidden", "ie_pref"):
        if "preference" not in have:
            return None, False
        p = num("preference")
        return (F.when(p < -1000, p) if field == "hidden" else p), False
    if field == "aud_or_vid":
        return F.when(F.coalesce(F.col("vcodec") != "none", F.lit(True)) | F.coalesce(F.col("acodec") != "none", F.lit(True)), 1.0).otherwise(0.0), False
    if field in ("hasvid", "hasaud"):
        c = F.col("vcodec" if field == "hasvid" else "acodec")
        return F.when(c == "none", -1.0).otherwise(0.0), False
    if field in ORDERED:
        name, regex, values = ORDERED[field]
        if name not in have:
            return None, False
        values = FREE_FIRST.get(field, values) if free_first else values
        return order_rank(F.col(name), values, regex).cast("double"), False
    if field == "res":
        return F.coalesce(F.least(_truthy(num("height")), _truthy(num("width"))), F.lit(0.0)), False
    if field == "br":
        return F.coalesce(_truthy(num("tbr")), _truthy(num("vbr")), _truthy(num("abr"))), False
    if field == "size":
        return F.coalesce(_truthy(num("filesize")), _truthy(num("filesize_approx"))), False
    if field == "id":
        return F.col("format_id"), True
    if field in NUMBERS:
        name, default = NUMBERS[field]
        if name not in have:
            return None, False
        return (F.coalesce(num(name), F.lit(default)) if default is not None else num(name)), False
    if field not in have:
        return None, False
    text = dict(df.dtypes)[field] == "string"
    return (F.col(field) if text else num(field)), text


def _limit(field: str, text: str | None, free_first: bool) -> float | None:
    if text is None:
        return None
    if field in ORDERED:
        _, regex, values = ORDERED[field]
        values = FREE_FIRST.get(field, values) if free_first else values
        n = len(values)
        for i, v in enumerate(values):
            if v and (re.match(v, text) if regex else v == text):
                return float(n - i)
        return float(n - (values.index("") if "" in values else n + 1))
    if field in SIZES:
        size = size_literal(text)
        return float(size if size is not None else text)
    return float(text)


def sort_columns(df: DataFrame, user: Sequence[str] = (), source: Sequence[str] = (), force: bool = False, free_first: bool = False, defaults: bool = True) -> list[Column]:
    """Ascending sort keys (best is last).  Each field gives (class, value, tie): unknown values come first,
    values past a limit after those within reach of it, and ``~`` measures the distance to the limit."""
    keys: list[Column] = []
    for field, reverse, closest, limit_text in parse_spec(user, source, force, defaults):
        value, is_text = _value(df, field, free_first)
        if value is None:
            continue
        if field in ("hidden", "ie_pref"):
            value = F.coalesce(value, F.lit(-1.0))
        if is_text:
            keys += [value.isNotNull(), value]
            continue
        limit = _limit(field, limit_text, free_first)
        if limit is None:
            keys += [value.isNotNull(), -value if reverse else value]
        elif closest:
            keys += [value.isNotNull(), -F.abs(value - limit), value - limit if reverse else limit - value]
        else:
            plain = (value <= limit) if not reverse else F.lit(False)
            flipped = (value > limit) | ((value == limit) if reverse else F.lit(False))
            keys += [F.when(value.isNull(), -10).when(plain | flipped, 0).otherwise(-1), F.when(plain, value).when(flipped, -value).otherwise(value)]
    return keys
