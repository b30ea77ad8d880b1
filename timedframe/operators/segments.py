"""Timed segments: timelines, placement, splitting, merging, batching and cue generation.

Segment tables carry ``media_id, seg_id, start, end, text`` and optional ``text_original, speaker, words``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedframe.operators.ordered import (
    attach_group,
    fits,
    group_limit,
    lag_lead,
    largest_group,
    materialize,
    number_rows,
    run_count,
    run_max,
    run_sum,
    scan,
    shared_out,
    small_as_a_whole,
)
from timedframe.semantics import r2, strip

# Fixed values
CHARS_PER_SECOND = 14.0
MIN_SECONDS = 1.0
MIN_SLOT = 0.05
STRETCH_TRIGGER = 1.1
STRETCH_MAX = 1.4
IMPLAUSIBLE_CHARS_PER_SECOND = 5.0
IMPLAUSIBLE_FLOOR = 6.0
FORCED_CUT_SECONDS = 18.5
MERGE_CHAIN = 3
MERGE_GAP = 1.5
MERGE_SECONDS = 45.0
SENTENCE_TERMINATORS = "。！？….!?"
TRAILING_QUOTES = "”’\"'）】》」』)"
SENTENCE_BREAK = r"(?U)(?<=[.!?…])\s+"
CLAUSE_BREAK = r"(?U)(?<=[,;])\s+"
LINE_CHARS = 42
CUE_CHARS = 400
CUE_SECONDS = 25.0
TEXT_CAP = 6000
CJK = "[一-鿿㐀-䶿]"
CJK_SHARE = 0.3
DIACRITIC_MIN_CHARS = 12
LAUGHTER = r"(?i)^(?:[\s.,!?~…]*(?:ha|he|hi|ho))+[\s.,!?~…]*$"
VIETNAMESE_LETTERS = (
    "đĐăĂâÂêÊôÔơƠưƯ"
    "àáảãạằắẳẵặầấẩẫậèéẻẽẹềếểễệìíỉĩịòóỏõọồốổỗộờớởỡợùúủũụừứửữựỳýỷỹỵ"
    "ÀÁẢÃẠẰẮẲẴẶẦẤẨẪẬÈÉẺẼẸỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌỒỐỔỖỘỜỚỞỠỢÙÚỦŨỤỪỨỬỮỰỲÝỶỸỴ"
)
VIETNAMESE_TARGETS = ["việt", "vietnamese"]
NARRATOR = "narrator"
OCR_MIN_CHARS = 20

ORDER = ["seg_id"]
KEY = ["media_id"]


# ---- timelines -----------------------------------------------------------------------------------


def estimate_timeline(paragraphs: DataFrame, cps: float = CHARS_PER_SECOND, bounded: bool | None = None, tasks: int | None = None) -> DataFrame:
    """Reading-time timeline: each paragraph lasts ``max(1, chars / cps)``; the carry stays unrounded.

    ``tasks`` deals the paragraphs by media after their durations are known: who reads only times moves no text.
    """
    timed = paragraphs.withColumn("_dur", F.greatest(F.lit(MIN_SECONDS), F.length("text") / F.lit(cps)))
    if tasks:
        timed = timed.repartition(tasks, *KEY)
    timed = scan(timed, KEY, ORDER, {"_until": run_sum(F.col("_dur"))}, bounded)
    return timed.select(
        *paragraphs.columns,
        r2(F.col("_until") - F.col("_dur")).alias("start"),
        r2("_until").alias("end"),
    )


def flag_implausible(df: DataFrame, dur: str = "dur") -> DataFrame:
    """Audio far too long for its text."""
    ceiling = F.greatest(F.lit(IMPLAUSIBLE_FLOOR), F.length("text") / F.lit(IMPLAUSIBLE_CHARS_PER_SECOND))
    return df.withColumn("implausible", F.col(dur) > ceiling)


def stretch_plan(df: DataFrame, dur: str = "dur") -> DataFrame:
    """Compression ratio (at most 1.4) for audio that overruns its slot by more than a tenth."""
    raw, slot = r2(dur), r2(F.col("end") - F.col("start"))
    overruns = (slot > MIN_SLOT) & (raw / F.when(slot > MIN_SLOT, slot) > STRETCH_TRIGGER)
    ratio = F.when(overruns, F.least(raw / F.when(slot > MIN_SLOT, slot), F.lit(STRETCH_MAX))).otherwise(F.lit(1.0))
    return df.select("*", ratio.alias("stretch_ratio"), (F.col(dur) / ratio).alias("fitted_dur"))


def cascade(segments: DataFrame, dur: str = "dur", rate: int = 24000, skip: Column | None = None, bounded: bool | None = None) -> DataFrame:
    """Place each segment at ``max(own start, previous end)``, in whole samples.

    With lengths ``L`` and natural starts ``N``, the end of row i is ``S_i + max_{j<=i}(N_j - S_{j-1})``
    where S is the running sum of L: two running windows, no row-by-row cursor.  Skipped rows keep
    their own window and do not move the cursor.
    """
    bounded = fits(segments, KEY) if bounded is None else bounded
    skipped = F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(False)
    rows = segments.select(
        "*",
        skipped.alias("skipped"),
        F.bround(F.col("start") * rate).cast("bigint").alias("_nat"),
        F.bround(F.col(dur) * rate).cast("bigint").alias("_len"),
    )
    placed_len = F.when(F.col("skipped"), F.lit(0).cast("bigint")).otherwise(F.col("_len"))
    rows = scan(rows, KEY, ORDER, {"_sum": run_sum(placed_len)}, bounded)
    lead = F.when(~F.col("skipped"), F.col("_nat") - (F.col("_sum") - F.col("_len")))
    rows = scan(rows, KEY, ORDER, {"_lead": run_max(lead)}, bounded)
    end = F.col("_sum") + F.greatest(F.col("_lead"), F.lit(0))
    start = end - F.col("_len")
    slot = r2(F.col("end") - F.col("start"))
    audio = r2(F.col("_len") / rate)
    live = ~F.col("skipped")
    return rows.select(
        *segments.columns,
        "skipped",
        F.when(live, F.bround(start / rate, 3)).otherwise(F.col("start")).alias("placed_start"),
        F.when(live, F.bround(end / rate, 3)).otherwise(F.col("end")).alias("placed_end"),
        F.when(live, r2((start - F.col("_nat")) / rate)).alias("drift_s"),
        F.when(live, r2(F.greatest(F.lit(0.0), audio - slot))).alias("overrun_s"),
        F.when(live, end).alias("end_sample"),
    )


def drift_summary(placed: DataFrame, rate: int = 24000) -> DataFrame:
    return placed.groupBy("media_id").agg(
        F.count("*").alias("segments"),
        F.count_if(F.col("drift_s") > 0).alias("drifted_segments"),
        F.greatest(F.coalesce(F.max("drift_s"), F.lit(0.0)), F.lit(0.0)).alias("max_drift_s"),
        r2(F.coalesce(F.max("end_sample"), F.lit(0)) / rate).alias("audio_duration_s"),
    )


def concat_documents(segments: DataFrame, group: str, doc_order: str, small_docs: bool | None = None, tasks: int | None = None) -> DataFrame:
    """Chain the documents of a group: shift each by the end of those before it and number segments from 1.

    Only one row per document enters the ordered scan; the rows themselves join back by document.  Where they are
    dealt by document over ``tasks`` already, the documents follow them, and the rows stay where they are.
    """
    docs = segments.groupBy(group, doc_order).agg(F.max("end").alias("_last"), F.count("*").alias("_n"))
    bounded = None
    if not small_as_a_whole(docs):
        docs = materialize(docs)  # measured, counted, sampled and sorted below: the texts are read once for it
        bounded = largest_group(docs, [group]) <= group_limit(docs.sparkSession)
    docs = scan(
        docs,
        [group],
        [doc_order],
        {"_shift": run_sum(F.col("_last").cast("decimal(28,2)"), False), "_before": run_sum(F.col("_n"), False)},
        bounded,
    ).select(group, doc_order, "_shift", "_before")
    inner = number_rows(segments, [group, doc_order], ORDER, "_pos", small_docs)
    shift = F.coalesce(F.col("_shift"), F.lit(0)).cast("double")
    if tasks:
        docs = docs.withColumnRenamed(group, "_group").repartition(tasks, doc_order)
        # Groups are compared as a range: with a second equal key Spark deals both sides anew by the two.
        rows = inner.join(docs, doc_order).filter(F.col(group).between(F.col("_group"), F.col("_group")))
    else:
        rows = inner.join(docs, [group, doc_order])
    return rows.select(
        *[c for c in segments.columns if c not in ("start", "end", "seg_id")],
        (F.coalesce(F.col("_before"), F.lit(0)) + F.col("_pos")).alias("seg_id"),
        r2(F.col("start") + shift).alias("start"),
        r2(F.col("end") + shift).alias("end"),
    )


def split_ranges(df: DataFrame, max_s: float = 15.0, start: str = "start", end: str = "end") -> DataFrame:
    """Cut ranges longer than ``max_s`` into ``ceil(d / max_s)`` equal parts."""
    span = F.col(end) - F.col(start)
    parts = F.greatest(F.lit(1), F.ceil(span / max_s)).cast("int")
    cut = df.withColumn("_n", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    step = span / F.col("_n")
    whole = F.col("_n") == 1
    return cut.select(
        *[c for c in df.columns if c not in (start, end)],
        "part",
        (F.col(start) + F.col("part") * step).alias(start),
        F.when(whole, F.col(end)).otherwise(F.col(start) + (F.col("part") + 1) * step).alias(end),
    )


# ---- sentences -----------------------------------------------------------------------------------


def _weighed(parts: Column | str) -> Column:
    """Each part ``t`` with the characters ``before`` it, those of all parts in ``total`` and their number ``n``."""
    # One fold per row; ``parts`` is evaluated once.
    seed = F.struct(
        F.array().cast("array<struct<t:string,before:int>>").alias("out"), F.lit(0).alias("at")
    )
    return F.aggregate(
        parts,
        seed,
        lambda a, x: F.struct(
            F.concat(a["out"], F.array(F.struct(x.alias("t"), a["at"].alias("before")))).alias("out"),
            (a["at"] + F.length(x)).alias("at"),
        ),
        lambda a: F.transform(
            a["out"],
            lambda p: F.struct(p["t"].alias("t"), p["before"].alias("before"), a["at"].alias("total"), F.size(a["out"]).alias("n")),
        ),
    )


def _shared_out(rows: DataFrame, weighed: Column, keep: list[str], pos: str, out: str, chars: str | None = None) -> DataFrame:
    """Explode ``weighed`` parts and give each its share of [start, end] by characters; the last ends at ``end``."""
    # Not an inner one: Spark would compute the parts twice, once to drop rows without any.
    flat = rows.select(*keep, "start", "end", F.posexplode_outer(weighed).alias("_i", "_p")).filter(F.col("_i").isNotNull())
    span = F.col("end") - F.col("start")
    upto = lambda chars: F.least(F.col("end"), F.col("start") + span * chars / F.greatest(F.col("_p.total"), F.lit(1)))
    before, after = F.col("_p.before"), F.col("_p.before") + F.length("_p.t")
    return flat.select(
        *keep,
        (F.col("_i") + 1).alias(pos),
        F.when(F.col("_i") == 0, F.col("start")).otherwise(upto(before)).alias("start"),
        F.when(F.col("_i") == F.col("_p.n") - 1, F.col("end")).otherwise(upto(after)).alias("end"),
        F.col("_p.t").alias(out),
        *([F.length("_p.t").alias(chars)] if chars else []),
    )


def sentences(text: Column) -> Column:
    """Trimmed sentences of a text; a text of one sentence stays as it is."""
    parts = F.filter(F.transform(F.split(strip(text), SENTENCE_BREAK), strip), lambda s: F.length(s) > 0)
    return F.coalesce(F.get(F.filter(F.array(parts), lambda a: F.size(a) > 1), F.lit(0)), F.array(text))


def split_sentences(segments: DataFrame, renumber: bool = True, bounded: bool | None = None, chars: str | None = None) -> DataFrame:
    """One row per sentence with time in proportion to characters; ids count from 1 per media.

    ``chars`` names a column for each sentence's characters: who needs no more of a text than that moves none.
    """
    keep = [c for c in segments.columns if c not in ("start", "end", "text")]
    rows = segments.withColumn("_s", sentences(F.col("text")))
    if renumber and bounded is None and not small_as_a_whole(rows):
        out = _numbered(rows, keep, chars)
    else:
        out = _shared_out(rows, _weighed("_s"), keep, "sentence", "text", chars)
        if not renumber:
            return out
        out = number_rows(out, KEY, ["seg_id", "sentence"], "_id", bounded)
    last = [chars] if chars else []
    return out.select(*[F.col("_id").alias("seg_id") if c == "seg_id" else F.col(c) for c in keep], "start", "end", "text", *last)


def _numbered(rows: DataFrame, keep: list[str], chars: str | None) -> DataFrame:
    """Sentences (``_s``) of a large table with their number ``_id`` in a media.

    Texts are split and written once.  Where a media doesn't fit a task, only the number of sentences of each segment is
    sorted and summed; the sum before a segment meets its sentences by a row number of the written copy.
    """
    held = materialize(rows.select(*keep, "start", "end", _weighed("_s").alias("_parts"), F.monotonically_increasing_id().alias("_row")))
    out = _shared_out(held, F.col("_parts"), [*keep, "_row"], "sentence", "text", chars)
    counts = held.select(*KEY, *ORDER, "_row", F.get(F.col("_parts.n"), F.lit(0)).cast("bigint").alias("_n"))
    places = counts.groupBy(*KEY, *ORDER).agg(F.sum("_n").alias("_n"), F.count("*").alias("_c"))
    media = places.groupBy(*KEY).agg(F.sum("_n").alias("_n"), F.sum("_c").alias("_rows"), F.max("_c").alias("_c"))
    most = media.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("_n", "_rows", "_c")]).first()
    limit = group_limit(held.sparkSession)
    if most["_n"] <= limit or most["_c"] > 1:  # sentences of segments with the same id take turns
        return number_rows(out, KEY, ["seg_id", "sentence"], "_id", most["_n"] <= limit)
    begun = scan(counts, KEY, ORDER, {"_before": run_sum(F.col("_n"), False)}, most["_rows"] <= limit)
    begun = materialize(begun.select("_row", F.coalesce("_before", F.lit(0)).alias("_before")))
    return shared_out(out, held, "_row").join(begun, "_row").withColumn("_id", F.col("_before") + F.col("sentence"))


def ends_sentence(text: Column) -> Column:
    bare = F.regexp_replace(text, r"(?U)\s+$", "")
    bare = F.regexp_replace(bare, "[" + TRAILING_QUOTES + "]+$", "")
    return F.coalesce(bare.rlike("[" + SENTENCE_TERMINATORS + "]$"), F.lit(False))


MERGE_BLOCK = 4096


def merge_dangling(segments: DataFrame, bounded: bool | None = None) -> DataFrame:
    """Join segments cut in mid sentence to the next one (gap, duration and chain limits).

    A row's place in its chain (1, 2 or 3) follows from its predecessor's place and two flags, so each
    block of rows is a map from three entry states to states.  Blocks are folded independently, their
    maps are chained per media, and rows with place 1 start the merged segments.
    """
    bounded = fits(segments, KEY) if bounded is None else bounded
    words = "words" in segments.columns
    dangling = (~ends_sentence(F.col("text"))) | (F.col("end") - F.col("start") >= FORCED_CUT_SECONDS)
    rows = lag_lead(
        segments,
        KEY,
        ORDER,
        lags={"_prev": F.struct(F.col("start").alias("s"), F.col("end").alias("e"), dangling.alias("d"))},
        bounded=bounded,
    )
    rows = lag_lead(rows, KEY, ORDER, lags={"_prev2": F.col("_prev.s")}, bounded=bounded)
    rows = number_rows(rows, KEY, ORDER, "_rn", bounded)
    linked = F.coalesce(F.col("_prev.d") & (F.col("start") - F.col("_prev.e") <= MERGE_GAP), F.lit(False))
    rows = rows.select(
        *segments.columns,
        "_rn",
        (linked & (F.col("end") - F.col("_prev.s") <= MERGE_SECONDS)).alias("_to2"),
        (linked & F.coalesce(F.col("end") - F.col("_prev2") <= MERGE_SECONDS, F.lit(False))).alias("_to3"),
    )
    block = F.floor((F.col("_rn") - 1) / MERGE_BLOCK)
    flags = rows.groupBy("media_id", block.alias("_b")).agg(
        F.array_sort(F.collect_list(F.struct("_rn", "_to2", "_to3"))).alias("f")
    )

    def step(state: Column, f: Column) -> Column:
        return F.when((state == "1") & f["_to2"], "2").when((state == "2") & f["_to3"], "3").otherwise("1")

    def walk(entry: str) -> Column:
        # one character per row: the place of that row when the row before the block is in place ``entry``
        return F.aggregate(
            "f", F.struct(F.lit(entry).alias("s"), F.lit("").alias("t")),
            lambda a, f: F.struct(step(a["s"], f).alias("s"), F.concat(a["t"], step(a["s"], f)).alias("t")),
        )["t"]

    walks = flags.select("media_id", "_b", F.array(walk("1"), walk("2"), walk("3")).alias("w"))
    lasts = F.transform("w", lambda t: F.right(t, F.lit(1)))
    chained = walks.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("_b", lasts.alias("m")))).alias("m"))
    entries = chained.select(
        "media_id",
        F.aggregate(
            "m", F.struct(F.lit("1").alias("s"), F.lit("").alias("t")),
            lambda a, m: F.struct(F.element_at(m["m"], a["s"].cast("int")).alias("s"), F.concat(a["t"], a["s"]).alias("t")),
        )["t"].alias("e"),
    )
    states = (
        walks.join(entries, "media_id")
        .select("media_id", "_b", F.element_at("w", F.substring("e", F.col("_b").cast("int") + 1, 1).cast("int")).alias("t"))
        .select("media_id", "_b", F.posexplode(F.split("t", "")).alias("_i", "_place"))
        .filter(F.col("_place") != "")
        .select("media_id", (F.col("_b") * MERGE_BLOCK + F.col("_i") + 1).alias("_rn"), F.col("_place").cast("int").alias("_place"))
    )
    # A chain's first row is at most two rows back, so its number is the group key: no further scan.
    rows = rows.join(states, ["media_id", "_rn"]).withColumn("_head", F.col("_rn") - F.col("_place") + 1)
    firsts = [c for c in segments.columns if c not in ("media_id", "end", "text", "words")]
    ordered = F.array_sort(F.collect_list(F.struct("_rn", F.col("text").alias("t"), *([F.col("words").alias("w")] if words else []))))
    merged = rows.groupBy("media_id", "_head").agg(
        *[F.min_by(c, "_rn").alias(c) for c in firsts],
        F.max_by("end", "_rn").alias("end"),
        ordered.alias("_o"),
    )
    out = {c: F.col(c) for c in segments.columns}
    out["text"] = F.array_join(F.transform("_o", lambda x: x["t"]), "")
    if words:
        out["words"] = F.flatten(F.filter(F.transform("_o", lambda x: x["w"]), lambda w: w.isNotNull()))
    return merged.select(*[v.alias(c) for c, v in out.items()])


# ---- batches and text ----------------------------------------------------------------------------


def batch(segments: DataFrame, n: int = 20) -> DataFrame:
    numbered = number_rows(segments, KEY, ORDER, "_rn")
    return numbered.withColumn("batch", F.floor((F.col("_rn") - 1) / n)).drop("_rn")


def chunk_with_context(segments: DataFrame, size: int = 60, overlap: int = 10) -> DataFrame:
    """Chunks of ``size`` rows; the ``overlap`` rows before a chunk appear in it flagged as context."""
    if not 0 <= overlap <= size:
        raise ValueError("overlap must lie between 0 and size")
    rows = attach_group(number_rows(segments, KEY, ORDER, "_rn"), KEY, _n=F.count("*"))
    i = F.col("_rn") - 1
    own = F.floor(i / size)
    tail = (i % size >= size - overlap) & ((own + 1) * size < F.col("_n"))
    seats = F.array(F.struct(own.alias("chunk"), F.lit(False).alias("is_context")))
    extra = F.array(F.struct((own + 1).alias("chunk"), F.lit(True).alias("is_context")))
    rows = rows.withColumn("_seat", F.explode(F.when(tail, F.concat(seats, extra)).otherwise(seats)))
    return rows.select(*segments.columns, "_seat.chunk", "_seat.is_context")


def media_text(segments: DataFrame, cap: int = TEXT_CAP, sep: str = " ") -> DataFrame:
    """First ``cap`` characters of the joined text.  Only rows that start before the cap are collected."""
    rows = segments.filter(F.length("text") > 0) if sep == "" else segments
    rows = scan(rows, KEY, ORDER, {"_at": run_sum(F.length("text") + len(sep), False)})
    rows = rows.filter(F.coalesce(F.col("_at"), F.lit(0)) - len(sep) < cap)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_id", "text"))), lambda s: s["text"]), sep)
    return rows.groupBy("media_id").agg(F.substring(joined, 1, cap).alias("text"))


def book_lines(segments: DataFrame) -> DataFrame:
    """Readable lines: narrator bare, other speakers as ``[name] text``."""
    who = F.coalesce(F.nullif(F.col("speaker"), F.lit("")), F.lit(NARRATOR))
    text = F.coalesce(F.col("text"), F.lit(""))
    line = F.when(who == NARRATOR, text).otherwise(F.concat(F.lit("["), who, F.lit("] "), text))
    return segments.withColumn("line", line)


def book_text(segments: DataFrame, preview: int = TEXT_CAP, chars: str | None = None) -> DataFrame:
    """Characters of each book and, when they fit the preview, its text; longer books are never collected.

    ``chars`` names a column that holds the characters of ``text``, so that lengths are summed without the texts.
    """
    lines = book_lines(segments)
    size = F.length("line")
    if chars:
        who = F.coalesce(F.nullif(F.col("speaker"), F.lit("")), F.lit(NARRATOR))
        size = F.coalesce(chars, F.lit(0)) + F.when(who == NARRATOR, 0).otherwise(F.length(who) + len("[] "))
    totals = lines.groupBy("media_id").agg((F.sum(size + 1) - 1).alias("n_chars"))
    fitting = totals.filter(F.col("n_chars") <= preview).select(F.col("media_id").alias("_fits"))
    if not small_as_a_whole(segments):
        lines = lines.filter(_may_be_of(F.col("media_id"), fitting, "_fits"))
    short = (
        lines.join(fitting, lines["media_id"].eqNullSafe(F.col("_fits")), "left_semi")
        .groupBy("media_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_id", "line"))), lambda s: s["line"]), "\n").alias("preview"))
    )
    return totals.join(short, "media_id", "left")


#: Bits of the one bitmap that Spark's aggregate makes.
BITMAP_BITS = 32768


def _may_be_of(value: Column, side: DataFrame, name: str) -> Column:
    """Whether the hash of ``value`` is among those of ``side``: one bitmap of 4 KB, which any number of rows goes into.

    A filter by it goes down to the table, so that rows without a partner are not dealt out for the join that follows.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP_BITS))
    bits = side.agg(F.bitmap_construct_agg(place(F.col(name)))).scalar()
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place(value) / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.bit_get(byte.cast("int"), (place(value) % 8).cast("int")) == 1


# ---- cues ----------------------------------------------------------------------------------------

BREAK = "\x01"


def _pack(parts: Column, max_chars: int) -> Column:
    """Greedy fill of pieces into lines, as text with a control character between the lines."""
    start = F.struct(F.lit("").alias("done"), F.lit(None).cast("string").alias("cur"))

    def add(a: Column, p: Column) -> Column:
        joined = F.concat(a["cur"], F.lit(" "), p)
        fits = F.length(joined) <= max_chars
        return F.struct(
            F.when(a["cur"].isNull() | fits, a["done"]).otherwise(F.concat(a["done"], a["cur"], F.lit(BREAK))).alias("done"),
            F.when(a["cur"].isNull(), p).when(fits, joined).otherwise(p).alias("cur"),
        )

    return F.aggregate(parts, start, add, lambda a: F.concat(a["done"], F.coalesce(a["cur"], F.lit(""))))


def wrap_lines(text: Column, max_chars: int = LINE_CHARS) -> Column:
    """Lines of a segment: clauses packed up to ``max_chars``, longer ones packed again by words."""
    whole = strip(text)
    clauses = F.filter(F.transform(F.split(whole, CLAUSE_BREAK), strip), lambda c: F.length(c) > 0)
    lines = F.split(_pack(clauses, max_chars), BREAK)
    words = lambda l: F.filter(F.split(l, r"(?U)\s+"), lambda w: F.length(w) > 0)
    fine = F.flatten(
        F.transform(lines, lambda l: F.when(F.length(l) <= max_chars, F.array(l)).otherwise(F.split(_pack(words(l), max_chars), BREAK)))
    )
    nothing = F.array().cast("array<string>")
    return F.when(F.length(whole) == 0, nothing).when(F.length(whole) <= max_chars, F.array(whole)).otherwise(fine)


def cue_lines(segments: DataFrame, max_chars: int = LINE_CHARS) -> DataFrame:
    """Adds ``lines``, the wrapped lines of each segment."""
    return segments.withColumn("lines", F.coalesce(wrap_lines(F.col("text"), max_chars), F.array().cast("array<string>")))


def cue_times(lines: DataFrame) -> DataFrame:
    """One row per cue, with time in proportion to the line's characters."""
    keep = [c for c in lines.columns if c not in ("start", "end", "text", "lines")]
    return _shared_out(lines, _weighed("lines"), keep, "cue", "line")


def cue_summary(segments: DataFrame, cues: DataFrame) -> DataFrame:
    over = (F.length("text") > CUE_CHARS) | (F.col("end") - F.col("start") > CUE_SECONDS)
    a = segments.groupBy("media_id").agg(F.count("*").alias("segments"), F.count_if(over).alias("oversized_segments"))
    b = cues.groupBy("media_id").agg(F.count("*").alias("cues"))
    return a.join(b, "media_id", "left").na.fill(0, ["cues"]).select("media_id", "segments", "cues", "oversized_segments")


# ---- text gates and routing ----------------------------------------------------------------------


def char_class(letters: str) -> str:
    """Regex class of letters as code ranges; a long list of single letters matches many times slower."""
    codes, spans = sorted(map(ord, set(letters))), []
    for c in codes:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans) + "]"


def is_vietnamese(target: str) -> bool:
    return any(name in target.lower() for name in VIETNAMESE_TARGETS)


def looks_untranslated(text: Column, target: str = "tiếng Việt") -> Column:
    """Empty, mostly CJK, or (Vietnamese target) long enough without one Vietnamese letter."""
    share = F.regexp_count(text, F.lit(CJK)) / F.length(text)
    out = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, True).when(share > CJK_SHARE, True).when(text.rlike(LAUGHTER), False)
    if is_vietnamese(target):
        bare = ~text.rlike(char_class(VIETNAMESE_LETTERS))
        out = out.when((F.length(text) >= DIACRITIC_MIN_CHARS) & bare, True)
    return out.otherwise(False)


def flag_untranslated(df: DataFrame, col: str = "text", target: str = "tiếng Việt") -> DataFrame:
    return df.withColumn("untranslated", looks_untranslated(F.col(col), target))


def route_pages(df: DataFrame, col: str = "text") -> DataFrame:
    short = F.length(strip(F.coalesce(F.col(col), F.lit("")))) < OCR_MIN_CHARS
    return df.withColumn("route", F.when(short, "ocr").otherwise("text_layer"))


def route_engine(df: DataFrame, col: str = "language") -> DataFrame:
    return df.withColumn("engine", F.when(F.col(col) == "zh", "paraformer").otherwise("whisper"))


def filter_words(words: Column, start: Column) -> Column:
    """Words without a start are dropped; a missing end becomes the segment's start; two decimals."""
    return F.transform(
        F.filter(words, lambda w: w["start"].isNotNull()),
        lambda w: F.struct(
            w["word"].alias("word"),
            F.bround(w["start"], 2).alias("start"),
            F.bround(F.coalesce(w["end"], start), 2).alias("end"),
        ),
    )


# ---- recognised pages ----------------------------------------------------------------------------

SAME_LINE_PIXELS = 10
HELD_BOXES = 64


def reading_order(boxes: DataFrame) -> DataFrame:
    """Adds ``reading_pos`` to boxes (``page_id, line_idx, x, y``): by (y, x), then each box moves left past
    neighbours less than 10 px apart in y that stand to its right.

    No later box moves past one that stands 10 px or more above it, so boxes stream in sorted order and only those
    within 10 px are held.  A gap of 10 px or more in sorted y stops every move, so pages too large for a task
    are cut at gaps into bands that are arranged apart.
    """
    order = ["y", "x", "line_idx"]
    kinds = dict(boxes.dtypes)
    rows = boxes.select("page_id", *[F.col(c).cast("double").alias(c) for c in ("y", "x")], F.col("line_idx").cast("bigint").alias("line_idx"))
    if fits(boxes, ["page_id"]):
        part = ["page_id"]
        rows = rows.withColumns({"_band": F.lit(None).cast("bigint"), "_pos": F.lit(None).cast("bigint")})
    else:
        part = ["page_id", "_band"]
        rows = lag_lead(rows, ["page_id"], order, lags={"_py": F.col("y")}, bounded=False)
        fresh = F.when(F.col("_py").isNull() | (F.col("y") - F.col("_py") >= SAME_LINE_PIXELS), 1).otherwise(0)
        rows = scan(rows, ["page_id"], order, {"_band": run_sum(fresh), "_pos": run_count()}, False)
    rows = rows.select("page_id", "_band", "_pos", "y", "x", "line_idx").repartition(*part).sortWithinPartitions("page_id", "_band", *order)

    names = ["page_id", "line_idx", "x", "y", "reading_pos"]

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, placed, at, room, kind, out = None, [], 0, HELD_BOXES, None, []

        def settle(n: int):
            """The first ``n`` held boxes are final."""
            nonlocal at, placed
            out.extend((group[0], i, x, y, at + k) for k, (y, x, i) in enumerate(placed[:n], 1))
            at, placed = at + n, placed[n:]

        def settled() -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.float64(), pa.float64(), pa.int64()]
            cols = zip(*out) if out else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(cols, types)], names)

        for batch in batches:
            kind, out = batch.schema.field("page_id").type, []
            pages, bands, starts, ids = (batch.column(c).to_pylist() for c in ("page_id", "_band", "_pos", "line_idx"))
            ys, xs = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("y", "x"))
            for page, band, start, box in zip(pages, bands, starts, zip(ys, xs, ids)):
                if (page, band) != group:
                    settle(len(placed))
                    group, at, room = (page, band), (start or 1) - 1, HELD_BOXES
                y, x, _ = box
                if len(placed) >= room:
                    settle(next((k for k in range(len(placed), 0, -1) if not abs(y - placed[k - 1][0]) < SAME_LINE_PIXELS), 0))
                    room = max(HELD_BOXES, 2 * len(placed))
                to = len(placed)
                while to and abs(y - placed[to - 1][0]) < SAME_LINE_PIXELS and x < placed[to - 1][1]:
                    to -= 1
                placed.insert(to, box)
            yield settled()
        if placed:
            out = []
            settle(len(placed))
            yield settled()

    return rows.mapInArrow(arrange, f"page_id {kinds['page_id']}, line_idx bigint, x double, y double, reading_pos bigint")


def page_text(lines: DataFrame, cap: int | None = None) -> DataFrame:
    """Non-blank recognised lines of a page joined by a space; ``cap`` bounds the characters kept."""
    kept = lines.filter(F.length(strip(F.col("text"))) > 0)
    if cap is not None:
        kept = scan(kept, ["page_id"], ["line_idx"], {"_at": run_sum(F.length("text") + 1, False)})
        kept = kept.filter(F.coalesce(F.col("_at"), F.lit(0)) - 1 < cap)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda s: s["text"]), " ")
    out = strip(joined) if cap is None else F.substring(strip(joined), 1, cap)
    return kept.groupBy("page_id").agg(out.alias("text"))
