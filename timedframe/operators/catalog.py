"""Catalog entries: screening, playlists, archives, subtitles, names and record merging."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedframe.functions.filters import date_bound, match_column, playlist_slices
from timedframe.operators.ordered import attach_group, first_per_key, last_per_key, number_rows, run_sum, scan, top_n
from timedframe.semantics import known


# ---- filters -------------------------------------------------------------------------------------


def match_filter(df: DataFrame, expr: str | Callable[[DataFrame], Column], incomplete: Sequence[str] | bool = ()) -> DataFrame:
    """Rows that pass a filter string, or a user's own function from table to column."""
    return df.filter(expr(df) if callable(expr) else match_column(df, expr, incomplete))


def any_column(df: DataFrame, exprs: Sequence[str], incomplete: Sequence[str] | bool = ()) -> Column:
    return reduce(lambda a, b: a | b, [match_column(df, e, incomplete) for e in exprs]) if exprs else F.lit(True)


def take_until(df: DataFrame, keys: Sequence[str], order: Sequence[str], cond: Column) -> DataFrame:
    """Rows of a list before its first hit.  One aggregate finds the hit per key; no window is needed."""
    rows = attach_group(df.withColumn("_hit", known(cond)), keys, _stop=F.min(F.when(F.col("_hit"), F.struct(*order))))
    return rows.filter(F.col("_stop").isNull() | (F.struct(*order) < F.col("_stop"))).select(*df.columns)


def match_any(df: DataFrame, exprs: Sequence[str], break_exprs: Sequence[str] = (), keys: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Rows that pass any filter; a row failing all breaking filters ends its list."""
    if break_exprs:
        df = take_until(df, keys, order, ~known(any_column(df, break_exprs)))
    return df.filter(any_column(df, exprs))


def skip_after_failures(df: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column, n: int) -> DataFrame:
    """Rows up to and including the n-th failure of a list."""
    nth = top_n(df.filter(known(failed)), keys, [F.col(o).asc() for o in order], n).filter(F.col("_rn") == n)
    last = nth.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.struct(*order).alias("_last"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(last, on, "left").filter(F.col("_last").isNull() | (F.struct(*order) <= F.col("_last"))).select(*df.columns)


def in_date_range(df: DataFrame, col: str, start: str | None, end: str | None, today: str) -> DataFrame:
    return df.filter(_within(F.col(col), start, end, today))


def _within(day: Column, start: str | None, end: str | None, today: str) -> Column:
    ok = F.lit(True)
    if start:
        ok = ok & (day >= date_bound(start, today))
    if end:
        ok = ok & (day <= date_bound(end, today))
    return known(ok)


def age_ok(limit: Column, allowed: int | None) -> Column:
    return F.lit(True) if allowed is None else limit.isNull() | (limit <= allowed)


def age_allowed(df: DataFrame, allowed: int | None, col: str = "age_limit") -> DataFrame:
    return df.filter(age_ok(F.col(col), allowed))


def size_between(df: DataFrame, lo: int | None, hi: int | None, col: str = "filesize") -> DataFrame:
    """Rejects known sizes outside the bounds; unknown sizes pass."""
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (F.col(col) >= lo)
    if hi is not None:
        ok = ok & (F.col(col) <= hi)
    return df.filter(known(ok, True))


@dataclass
class Rules:
    archive: DataFrame | None = None
    extractor: str = ""
    match_title: str | None = None
    reject_title: str | None = None
    date_after: str | None = None
    date_before: str | None = None
    today: str = "1970-01-01"
    min_views: int | None = None
    max_views: int | None = None
    age_limit: int | None = None
    filters: Sequence[str] = field(default_factory=tuple)
    incomplete: Sequence[str] | bool = ()


def screen_entries(df: DataFrame, rules: Rules) -> DataFrame:
    """Adds ``reject_reason``: the first rule an entry fails, NULL when it passes."""
    rows, tests = df, []
    if rules.archive is not None:
        have = archived_ids(df, rules.archive, rules.extractor).withColumn("_old", F.lit(True))
        rows = rows.join(have, "id", "left")
        tests.append((known(F.col("_old")), "archived"))
    if rules.match_title:
        tests.append((known(~F.col("title").rlike("(?i)" + rules.match_title)), "title not matched"))
    if rules.reject_title:
        tests.append((known(F.col("title").rlike("(?i)" + rules.reject_title)), "title rejected"))
    if rules.date_after or rules.date_before:
        day = F.col("upload_date")
        tests.append((day.isNotNull() & ~_within(day, rules.date_after, rules.date_before, rules.today), "date out of range"))
    if rules.min_views is not None:
        tests.append((known(F.col("view_count") < rules.min_views), "too few views"))
    if rules.max_views is not None:
        tests.append((known(F.col("view_count") > rules.max_views), "too many views"))
    if rules.age_limit is not None:
        tests.append((~age_ok(F.col("age_limit"), rules.age_limit), "age restricted"))
    if rules.filters:
        tests.append((~known(any_column(df, rules.filters, rules.incomplete)), "filter not passed"))
    reason = F.lit(None).cast("string")
    for test, name in reversed(tests):
        reason = F.when(test, name).otherwise(reason)
    return rows.select(*df.columns, reason.alias("reject_reason"))


# ---- archive -------------------------------------------------------------------------------------


def archived_ids(entries: DataFrame, archive: DataFrame, extractor: str) -> DataFrame:
    """Ids of entries whose id or any old id is recorded."""
    tag = lambda c: F.concat(F.lit(extractor.lower() + " "), c.cast("string"))
    known_ids = archive.select("archive_id")
    if "old_ids" not in entries.columns:
        return entries.select("id", tag(F.col("id")).alias("archive_id")).join(known_ids, "archive_id", "left_semi").select("id").distinct()
    every = F.concat(F.array(F.col("id").cast("string")), F.coalesce(F.col("old_ids").cast("array<string>"), F.array().cast("array<string>")))
    each = entries.select("id", F.explode(F.array_distinct(every)).alias("_any"))
    return each.withColumn("archive_id", tag(F.col("_any"))).join(known_ids, "archive_id", "left_semi").select("id").distinct()


def not_archived(entries: DataFrame, archive: DataFrame, extractor: str) -> DataFrame:
    return entries.join(archived_ids(entries, archive, extractor), "id", "left_anti").select(*entries.columns)


# ---- playlists -----------------------------------------------------------------------------------


def playlist_items(entries: DataFrame, spec: str, key: str = "playlist_id", index: str = "playlist_index") -> DataFrame:
    """Entries a spec such as ``1,3:7:2,-1`` names, with ``position`` in the order of the spec.

    Every part is a predicate on the index and the list's length; an entry named twice keeps its first place.
    """
    parts = playlist_slices(spec)
    rows = entries
    relative = any((a or 0) < 0 or (b or 0) < 0 or (a is None and s < 0) for a, b, s in parts)
    rows = attach_group(rows, [key], _n=F.max(index)) if relative else rows.withColumn("_n", F.lit(None).cast("bigint"))
    i, n = F.col(index) - 1, F.col("_n")
    seats = []
    for k, (a, b, step) in enumerate(parts):
        first = (F.lit(0) if step > 0 else n - 1) if a is None else (F.lit(a - 1) if a >= 0 else n + a)
        if b is None:
            stop = None if step > 0 else F.lit(-1)
        else:
            stop = None if b == math.inf else (F.lit(int(b) - 1) if b >= 0 else n + int(b)) + (1 if step > 0 else -1)
        if step > 0:
            hit = (i >= first) & ((i - first) % step == 0)
            hit = hit & (i < stop) if stop is not None else hit
        else:
            hit = (i <= first) & ((first - i) % -step == 0)
            hit = hit & (i > stop) if stop is not None else hit & F.lit(False)
        seats.append(F.when(known(hit), F.struct(F.lit(k).alias("part"), (i if step > 0 else -i).cast("bigint").alias("at"))))
    rows = rows.withColumn("_seat", F.array_min(F.filter(F.array(*seats), lambda s: s.isNotNull()))).filter(F.col("_seat").isNotNull())
    rows = rows.withColumns({"_part": F.col("_seat.part"), "_at": F.col("_seat.at")})
    return number_rows(rows, [key], ["_part", "_at"], "position").select(*entries.columns, "position")


def reorder(entries: DataFrame, how: str, seed: int = 0, key: str = "playlist_id", index: str = "playlist_index") -> DataFrame:
    """``position`` for a reversed or a seeded random order; the random rank is a hash, so a rerun repeats it."""
    if how == "reverse":
        return number_rows(entries, [key], [F.col(index).desc()], "position")
    if how != "random":
        raise ValueError(f"unknown order {how!r}")
    rows = entries.withColumn("_r", F.xxhash64(F.lit(seed), F.col(key), F.col(index)))
    return number_rows(rows, [key], ["_r", index], "position").drop("_r")


def max_items(entries: DataFrame, n: int, key: str = "playlist_id", index: str = "playlist_index") -> DataFrame:
    return top_n(entries, [key], [F.col(index).asc()], n).drop("_rn")


def add_playlist_fields(entries: DataFrame, playlists: DataFrame) -> DataFrame:
    """Entries with their playlist's fields, number of entries and last index."""
    p = playlists.select("playlist_id", *[F.col(c).alias(c if c.startswith("playlist_") else f"playlist_{c}") for c in playlists.columns if c != "playlist_id"])
    rows = attach_group(entries, ["playlist_id"], n_entries=F.count("*"), last_playlist_index=F.max("playlist_index"))
    return rows.join(p, "playlist_id", "left")


def autonumber(entries: DataFrame, keys: Sequence[str], order: Sequence[str], start: int = 1, size: int = 5) -> DataFrame:
    """Sequence numbers, padded to ``size``, and the index padded to the width of the list's largest."""
    rows = number_rows(entries, keys, order, "autonumber")
    rows = attach_group(rows, keys, _last=F.max("playlist_index"))
    number = F.col("autonumber") + (start - 1)
    padded = lambda c, w: F.when(F.length(c) >= w, c).otherwise(F.lpad(c, w, F.lit("0")))
    return rows.withColumns(
        {
            "autonumber": number,
            "autonumber_text": padded(number.cast("string"), F.lit(size)),
            "index_text": padded(F.col("playlist_index").cast("string"), F.length(F.col("_last").cast("string"))),
        }
    ).drop("_last")


# ---- names and sets ------------------------------------------------------------------------------


def unique_names(df: DataFrame, parent: str = "parent", name: str = "name", order: str = "ord") -> DataFrame:
    """First come keeps ``x``; later ones take ``x-2``, ``x-3`` … past every suffix already in use.

    Within a base, the k-th newcomer takes the k-th suffix that no literal name occupies.  Taken numbers
    are few rows (names that already look like ``x-n``), so each candidate number is shifted by the
    taken ones at or below it, found by one equi-join on (parent, base).
    """
    rows = number_rows(df, [parent, name], [order], "_k")
    base = F.regexp_extract(name, r"^(.*)-([0-9]+)$", 1)
    no = F.regexp_extract(name, r"^(.*)-([0-9]+)$", 2).try_cast("bigint")
    taken = (
        df.select(F.col(parent).alias("_p"), base.alias("_b"), no.alias("_no"), F.col(name).alias("_full"))
        .filter((F.col("_no") >= 2) & (F.col("_full") == F.concat("_b", F.lit("-"), F.col("_no").cast("string"))))
        .select("_p", "_b", "_no")
        .distinct()
    )
    # offset j of the sorted taken numbers: candidate c lands past it when no_j <= c + j
    holes = number_rows(taken, ["_p", "_b"], ["_no"], "_j").select("_p", "_b", (F.col("_no") - F.col("_j") + 1).alias("_gap"))
    late = rows.filter(F.col("_k") > 1)
    steps = late.select(parent, name, F.col("_k").alias("_c"), F.lit(1).alias("_kind")).unionByName(
        holes.select(F.col("_p").alias(parent), F.col("_b").alias(name), F.col("_gap").alias("_c"), F.lit(0).alias("_kind"))
    )
    shifted = scan(steps, [parent, name], ["_c", "_kind"], {"_skip": run_sum(F.when(F.col("_kind") == 0, 1).otherwise(0))})
    shifted = shifted.filter(F.col("_kind") == 1).select(parent, name, F.col("_c").alias("_k"), "_skip")
    out = rows.join(shifted, [parent, name, "_k"], "left")
    unique = F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat(name, F.lit("-"), (F.col("_k") + F.col("_skip")).cast("string")))
    return out.select(*df.columns, unique.alias("unique_name"))


def ordered_distinct(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key in order, by a map-side combined aggregate."""
    return first_per_key(df, keys, order)


def resolve_options(options: Sequence[str], universe: DataFrame, aliases: dict[str, Sequence[str]] | None = None, use_regex: bool = True) -> DataFrame:
    """Values of ``universe(value, ord)`` that an option list keeps, in the list's order.

    ``-x`` discards, ``all`` and aliases expand; a value's fate is that of the last rule matching it and
    its place is given by the first inclusion after its last discard.
    """
    flat: list[str] = []

    def expand(option: str, minus: bool, depth: int = 0) -> None:
        option, neg = (option[1:], True) if option.startswith("-") else (option, False)
        minus = minus != neg
        if option != "all" and aliases and option in aliases and depth < 50:
            for o in aliases[option]:
                expand(o, minus, depth + 1)
        else:
            flat.append(("-" if minus else "") + option)

    for o in options:
        expand(o, False)
    value = F.col("value")
    hits, drops = [], []
    for k, o in enumerate(flat):
        minus, pattern = (True, o[1:]) if o.startswith("-") else (False, o)
        hit = F.lit(True) if pattern == "all" else value.rlike(f"(?i)^(?:{pattern})$") if use_regex else value == pattern
        (drops if minus else hits).append(F.when(hit, k))
    nothing = F.lit(-1)
    last_drop = F.greatest(nothing, *[F.coalesce(d, nothing) for d in drops]) if drops else nothing
    rows = universe.withColumn("_drop", last_drop)
    place = F.array_min(F.filter(F.array(*hits), lambda h: h > F.col("_drop"))) if hits else F.lit(None).cast("int")
    rows = rows.withColumn("rule", place).filter(F.col("rule").isNotNull())
    return rows.drop("_drop")


def merge_records(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First non-null value wins; an empty string gives way to the later record's string.  Of several records of one key in a table the last by value counts."""
    a, b = last_per_key(a, keys), last_per_key(b, keys)
    cols = [c for c in dict.fromkeys([*a.columns, *b.columns]) if c not in keys]
    right = b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in b.columns if c not in keys])
    joined = a.join(right, list(keys), "full")
    kinds = dict([*b.dtypes, *a.dtypes])

    def pick(c: str) -> Column:
        x = F.col(c) if c in a.columns else F.lit(None).cast(kinds[c])
        y = F.col(f"_b_{c}") if c in b.columns else F.lit(None).cast(kinds[c])
        if kinds[c] == "string":
            return F.when(x == "", F.coalesce(y, x)).otherwise(F.coalesce(x, y))
        return F.coalesce(x, y)

    return joined.select(*keys, *[pick(c).alias(c) for c in cols])


# ---- thumbnails and subtitles --------------------------------------------------------------------


def rank_thumbnails(df: DataFrame, key: str = "media_id") -> DataFrame:
    """Ascending rank (best is last) by preference, width, height, id and url."""
    low = lambda c: F.coalesce(F.col(c), F.lit(-1))
    rows = df.withColumns({"_p": low("preference"), "_w": low("width"), "_h": low("height"), "_i": F.coalesce("id", F.lit(""))})
    return number_rows(rows, [key], ["_p", "_w", "_h", "_i", "url", "thumb_idx"], "rank").select(*df.columns, "rank")


def available_subtitles(subs: DataFrame) -> DataFrame:
    """Rows of each language, where a manual language hides its automatic captions."""
    rows = attach_group(subs, ["media_id", "lang"], _auto=F.min("automatic"))
    return rows.filter(F.col("automatic") == F.col("_auto")).drop("_auto")


def select_subtitles(subs: DataFrame, langs: Sequence[str] | None = None) -> DataFrame:
    """Languages to take per media: those a rule list keeps, or one default (en, then en*, then the first)."""
    have = available_subtitles(subs).groupBy("media_id", "lang").agg(F.min("idx").alias("idx"), F.min("automatic").alias("automatic"))
    if langs:
        picked = resolve_options(langs, have.withColumn("value", F.col("lang")).withColumn("ord", F.col("idx")))
        return picked.select("media_id", "lang", "automatic")
    tier = (
        F.when(~F.col("automatic") & (F.col("lang") == "en"), 0)
        .when(~F.col("automatic") & F.col("lang").startswith("en"), 1)
        .when(F.col("lang") == "en", 2)
        .when(F.col("lang").startswith("en"), 3)
        .when(~F.col("automatic"), 4)
        .otherwise(5)
    )
    return first_per_key(have.withColumn("tier", tier), ["media_id"], ["tier", "idx", "lang"]).select("media_id", "lang", "automatic")


def pick_sub_format(subs: DataFrame, pref: str = "best") -> DataFrame:
    """One format per (media, language): the first preferred extension there, the last row of it; else the last."""
    wanted = pref.split("/") if pref else []
    rank = F.lit(len(wanted))
    for k, ext in reversed(list(enumerate(wanted))):
        rank = F.lit(k) if ext == "best" else F.when(F.col("ext") == ext, k).otherwise(rank)
    rows = subs.withColumns({"_rank": rank, "_back": -F.col("idx")})
    return first_per_key(rows, ["media_id", "lang"], ["_rank", "_back"]).select(*subs.columns)


def merge_subtitles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both lists; the second adds only (url, data) pairs its language does not have yet."""
    keys = ["media_id", "lang", "url", "data"]
    seen = a.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    fresh = first_per_key(b, keys, ["idx"]).join(seen, on, "left_anti")
    return a.withColumn("origin", F.lit(1)).unionByName(fresh.select(*a.columns).withColumn("origin", F.lit(2)))


# ---- music library -------------------------------------------------------------------------------


def project_counts(projects: DataFrame, tracks: DataFrame) -> DataFrame:
    """Tracks per project; files at the root fall in ``_ungrouped`` and empty projects show 0."""
    have = tracks.groupBy(F.coalesce("project", F.lit("_ungrouped")).alias("project")).agg(F.count("*").alias("tracks"))
    return projects.select("project").distinct().join(have, "project", "full").select("project", F.coalesce("tracks", F.lit(0)).alias("tracks"))


def valid_default(pointers: DataFrame, tracks: DataFrame) -> DataFrame:
    return pointers.join(tracks.select("project", "track").distinct(), ["project", "track"], "left_semi")


# ---- rules over URLs -----------------------------------------------------------------------------


def classify_urls(df: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """Name of the first rule whose pattern matches from the start of the URL; rules are a fixed list."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(F.col(url).rlike("^(?:" + pattern + ")"), name).otherwise(out)
    return df.withColumn("extractor", out)


def domain_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def match_domain_rule(df: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Limits of the first rule (by ``ord``) whose domain equals the URL's or is a dotted suffix of it.

    A domain expands to its few suffixes, which meet the rules by equality instead of a cross product.
    """
    rows = df.withColumn("domain", domain_of(F.col(url)))
    parts = F.split("domain", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    domains = rows.select("domain").distinct()
    hits = domains.select("domain", F.explode(tails).alias("rule_domain")).join(rules.withColumnRenamed("domain", "rule_domain"), "rule_domain")
    best = first_per_key(hits, ["domain"], ["ord"])
    return rows.join(best, "domain", "left")
