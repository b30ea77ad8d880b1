"""Lookups between segment tables and side tables: windows, glossaries, revisions, speakers, voices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timedframe.functions.grams import GRAM, bloom, candidates, filter_bits, kind_of
from timedframe.operators.ordered import last_per_key, materialize, number_rows, run_sum, scan, shared_out, top_n
from timedframe.operators.segments import KEY, NARRATOR, ORDER, looks_untranslated
from timedframe.semantics import blank, strip

SEG = ["media_id", "seg_id"]
#: Characters of text that are searched together.
CHUNK_CHARS = 4096
NAME_CAP = 30


def apply_windows(segments: DataFrame, windows: DataFrame, order: str | None = None) -> DataFrame:
    """Segment times replaced by the window's where one exists; windows without a segment are ignored.

    Of several windows of a segment the last by ``order`` counts, without one the latest.
    """
    w = _last(windows, "start", "end", order=order).select(*SEG, F.col("start").alias("_ws"), F.col("end").alias("_we"))
    out = segments.join(w, SEG, "left")
    swap = {"start": F.coalesce("_ws", "start"), "end": F.coalesce("_we", "end")}
    return out.select(*[swap[c].alias(c) if c in swap else F.col(c) for c in segments.columns])


def _last(side: DataFrame, *values: str, order: str | None) -> DataFrame:
    """One row per segment of a side table."""
    return last_per_key(side.select(*SEG, *values, *([order] if order else [])), SEG, [order] if order else [])


def choose_windows(segments: DataFrame, windows: DataFrame) -> DataFrame:
    """Per media: its windows when it has any, else its transcript segments."""
    cols = [*SEG, "start", "end"]
    covered = windows.select("media_id").distinct()
    rest = segments.select(*cols).join(covered, "media_id", "left_anti")
    return windows.select(*cols, F.lit("window").alias("origin")).unionByName(rest.withColumn("origin", F.lit("segment")))


# ---- glossary ------------------------------------------------------------------------------------


def text_chunks(segments: DataFrame, overlap: int, width: int = CHUNK_CHARS) -> DataFrame:
    """Each media's text, joined without separator, as chunks of ``width`` characters plus ``overlap``.

    Any stretch of up to ``overlap + 1`` characters lies whole in some chunk, and no cell outgrows a chunk.
    """
    rows = segments.filter(F.length("text") > 0).select("media_id", "seg_id", "text")
    rows = scan(rows, KEY, ORDER, {"_end": run_sum(F.length("text").cast("bigint"))})
    at = F.col("_end") - F.length("text")
    first = F.greatest(F.lit(0), F.floor((at - width - overlap) / width) + 1)
    rows = rows.select("*", at.alias("_at"), F.explode(F.sequence(first, F.floor((F.col("_end") - 1) / width))).alias("_c"))
    lo, hi = F.col("_c") * width, F.col("_c") * width + width + overlap
    begin = F.greatest(F.col("_at"), lo)
    piece = F.substring(F.col("text"), (begin - F.col("_at") + 1).cast("int"), (F.least(F.col("_end"), hi) - begin).cast("int"))
    rows = rows.select("media_id", "_c", "_at", piece.alias("_p")).filter(F.length("_p") > 0)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_p"))), lambda s: s["_p"]), "")
    return rows.groupBy("media_id", "_c").agg(joined.alias("chunk"))


def anchored(terms: DataFrame) -> DataFrame:
    """Each term (``source, target``) with its kind ``_k`` and its anchor: of its grams the one ``_g``, at ``_o``, which the fewest sources
    of its kind hold, so that terms with a beginning in common are looked up apart."""
    sources = terms.select("source", kind_of(F.length("source")).alias("_k")).distinct().withColumn("_q", F.least("_k", F.lit(GRAM)))
    grams = sources.select("source", "_k", F.explode(F.sequence(F.lit(0), F.length("source") - F.col("_q"))).alias("_o"), "_q")
    grams = grams.select("source", "_k", "_o", F.substring(F.col("source"), F.col("_o") + 1, F.col("_q")).alias("_g"))
    rare = grams.join(grams.groupBy("_k", "_g").agg(F.count("*").alias("_n")), ["_k", "_g"])
    best = rare.groupBy("source", "_k").agg(F.min(F.struct("_n", "_o", "_g")).alias("_a"))
    return terms.join(best.select("source", "_k", "_a._o", "_a._g"), "source")


def match_glossary(segments: DataFrame, glossary: DataFrame) -> DataFrame:
    """Glossary rows (``source, target``) whose source occurs in a media's joined text.

    Every term has one gram as its anchor.  A Bloom filter of all anchors, of bounded size, picks the places of the texts where an
    anchor may stand; only these become rows, each with the text about it, and meet the terms by equal anchors.  The whole term is compared there.
    """
    wanted = glossary.filter(F.length("source") > 0).select("source", "target").distinct()
    terms = materialize(anchored(wanted))
    kinds = terms.groupBy("_k").agg(F.max(F.length("source")).alias("most"), F.count_distinct("source").alias("n")).collect()  # one row per short length or power of two
    if not kinds:
        return segments.limit(0).select("media_id", *[F.lit(None).cast(wanted.schema[c].dataType).alias(c) for c in wanted.columns])
    reach = {r["_k"]: int(r.most) for r in kinds}
    longest = max(reach.values())
    marks = bloom(terms.select("_k", "_g").distinct(), filter_bits(sum(r.n for r in kinds)))
    chunks = text_chunks(segments, longest - 1, max(CHUNK_CHARS, 4 * longest))
    met = candidates(chunks, marks, reach).join(terms, ["_k", "_g"])
    whole = F.substring(F.col("_w"), F.col("_i") - F.col("_o") + 1, F.length("source")) == F.col("source")
    found = met.filter((F.col("_i") >= F.col("_o")) & whole).select("media_id", "source", "target")
    return shared_out(found, segments, "media_id", "source").distinct()


def match_pairs(segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Notes of ``A-B`` pairs whose two names both occur in a media's text."""
    two = pairs.withColumn("_n", F.split("pair", "-")).filter(F.size("_n") == 2)
    names = two.select("pair", "note", F.explode(F.array_distinct("_n")).alias("source"), F.size(F.array_distinct("_n")).alias("_need")).distinct()
    found = match_glossary(segments, names.select("source", F.lit("").alias("target")).distinct())
    halves = shared_out(found.join(names, "source"), segments, "media_id", "pair")  # each name of a pair once
    both = halves.groupBy("media_id", "pair", "note", "_need").agg(F.count("*").alias("_got"))
    return both.filter(F.col("_got") == F.col("_need")).select("media_id", "pair", "note")


def unknown_names(names: DataFrame, glossary: DataFrame, cap: int = NAME_CAP) -> DataFrame:
    """Of the first ``cap`` non-blank names of a media (by ``pos``), those the glossary does not hold."""
    clean = names.select("media_id", "pos", strip("name").alias("name")).filter(F.length("name") > 0)
    kept = top_n(clean, KEY, [F.col("pos").asc()], cap).drop("_rn")
    return kept.join(glossary.select(F.col("source").alias("name")).distinct(), "name", "left_anti").select("media_id", "pos", "name")


# ---- revisions and speakers ----------------------------------------------------------------------


def apply_revisions(segments: DataFrame, revisions: DataFrame, target: str = "tiếng Việt", order: str | None = None) -> DataFrame:
    """Revised text where one exists, is not blank, differs and looks translated; ``review`` tells which.

    Of several revisions of a segment the last by ``order`` counts, blank or not.
    """
    rev = _last(revisions, "text", order=order).select(*SEG, strip("text").alias("_new")).filter(F.length("_new") > 0)
    out = segments.join(rev, SEG, "left")
    differs = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("text"))
    poor = looks_untranslated(F.col("_new"), target)
    review = F.when(differs & poor, "rejected").when(differs, "accepted")
    out = out.withColumn("review", review)
    text = F.when(F.col("review") == "accepted", F.col("_new")).otherwise(F.col("text"))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in segments.columns], "review")


def revision_audit(reviewed: DataFrame) -> DataFrame:
    return reviewed.groupBy("media_id").agg(
        F.count_if(F.col("review") == "accepted").alias("accepted"), F.count_if(F.col("review") == "rejected").alias("rejected")
    )


def apply_speaker_tags(segments: DataFrame, tags: DataFrame, order: str | None = None) -> DataFrame:
    """Speaker is the stripped non-blank tag, else the one already there, else the narrator.

    Of several non-blank tags of a segment the last by ``order`` counts.
    """
    t = _last(tags.filter(~blank("speaker")), "speaker", order=order).select(*SEG, strip("speaker").alias("_tag"))
    have = F.col("speaker") if "speaker" in segments.columns else F.lit(None).cast("string")
    cols = [c for c in segments.columns if c != "speaker"]
    return segments.join(t, SEG, "left").select(*cols, F.coalesce(F.col("_tag"), have, F.lit(NARRATOR)).alias("speaker"))


def assign_voices(segments: DataFrame, voices: Sequence[str], default: str | None = None, bounded: bool | None = None) -> DataFrame:
    """Voice per (media, speaker): the narrator's is the default, others take turns by first appearance.

    ``bounded`` says whether the speakers of every media fit a task; left open, they are measured.
    """
    narrator = default or (voices[0] if voices else "")
    pool = [v for v in voices if v != narrator] or list(voices) or [narrator]
    who = F.coalesce(F.nullif("speaker", F.lit("")), F.lit(NARRATOR))
    first = segments.groupBy("media_id", who.alias("speaker")).agg(F.min("seg_id").alias("first_seg"))
    others = number_rows(first.filter(F.col("speaker") != NARRATOR), KEY, ["first_seg", "speaker"], "_rn", bounded)
    pick = F.element_at(F.array(*[F.lit(v) for v in pool]), ((F.col("_rn") - 1) % len(pool) + 1).cast("int"))
    told = segments.select("media_id").distinct().select("media_id", F.lit(NARRATOR).alias("speaker"), F.lit(narrator).alias("voice"))
    return others.select("media_id", "speaker", pick.alias("voice")).unionByName(told)


def resolve_voice(requests: DataFrame, voices: DataFrame) -> DataFrame:
    """Voice id by label or id; no request takes the first voice; unknown ones report what is available."""
    by = voices.select("voice_idx", F.explode(F.array_distinct(F.array("label", "id"))).alias("_ask"), F.col("id").alias("_vid"))
    by = by.groupBy("_ask").agg(F.min_by("_vid", "voice_idx").alias("_vid"))
    ask = requests.withColumn("_want", F.nullif(F.col("voice"), F.lit("")))
    lead = voices.agg(
        F.min_by("id", "voice_idx").alias("_first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("voice_idx", "label"))), lambda v: v["label"]), ", ").alias("_have"),
    )
    out = ask.join(by, ask["_want"] == by["_ask"], "left").crossJoin(F.broadcast(lead))  # ``lead`` is one row
    missing = F.col("_want").isNotNull() & F.col("_vid").isNull()
    return out.select(
        *requests.columns,
        F.when(F.col("_want").isNull(), F.col("_first")).otherwise(F.col("_vid")).alias("voice_id"),
        F.when(missing, F.concat(F.lit("unknown voice; available: "), F.col("_have"))).alias("error"),
    )
