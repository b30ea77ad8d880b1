"""Compositions over media, segments and catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedframe.functions.scalars import coerce_fields
from timedframe.operators import catalog as ct
from timedframe.operators import corpus as cp
from timedframe.operators import formats as fm
from timedframe.operators import intervals as iv
from timedframe.operators import jobs as jb
from timedframe.operators import lookups as lk
from timedframe.operators import segments as sg
from timedframe.operators.ordered import fits, materialize, shared_out, small_as_a_whole, task_count
from timedframe.semantics import strip
from timedframe.sources.transcripts import parse_corpus


def transcript_to_cues(
    paragraphs: DataFrame, dur: Column | None = None, skip: Column | None = None, windows: DataFrame | None = None, bounded: bool | None = None
) -> DataFrame:
    """Paragraphs to timed cue lines: timeline, sentences, placement of the spoken audio, wrapped lines.

    The placement is carried in the row itself; only windows from elsewhere are joined.
    """
    timed = sg.estimate_timeline(paragraphs, bounded=bounded)
    said = sg.split_sentences(timed, bounded=bounded)
    said = said.withColumn("dur", dur if dur is not None else F.length("text") / F.lit(11.0))
    placed = sg.cascade(said, skip=skip, bounded=bounded)
    placed = placed.withColumns({"start": F.col("placed_start"), "end": F.col("placed_end")}).drop("placed_start", "placed_end", "end_sample", "overrun_s", "skipped", "dur")
    if windows is not None:
        placed = lk.apply_windows(placed, windows)
    return sg.cue_times(sg.cue_lines(placed))


def cue_report(paragraphs: DataFrame, bounded: bool | None = None) -> DataFrame:
    """Segments, cues and oversized segments per media."""
    said = sg.split_sentences(sg.estimate_timeline(paragraphs, bounded=bounded), bounded=bounded)
    lined = sg.cue_lines(said)
    # cues are counted from the array sizes: no explode, one aggregate
    over = (F.length("text") > sg.CUE_CHARS) | (F.col("end") - F.col("start") > sg.CUE_SECONDS)
    return lined.groupBy("media_id").agg(F.count("*").alias("segments"), F.sum(F.size("lines")).alias("cues"), F.count_if(over).alias("oversized_segments"))


def screen_playlist(entries: DataFrame, playlists: DataFrame, spec: str, rules: ct.Rules, break_on: Column | None = None) -> DataFrame:
    """Items of each playlist that survive screening, numbered: cheap predicates and the archive come first."""
    picked = ct.playlist_items(entries, spec)
    if break_on is not None:
        picked = ct.take_until(picked, ["playlist_id"], ["position"], break_on)
    kept = ct.screen_entries(picked, rules).filter(F.col("reject_reason").isNull()).drop("reject_reason")
    kept = ct.add_playlist_fields(kept, playlists)
    return ct.autonumber(kept, ["playlist_id"], ["position"])


def choose_formats(formats: DataFrame, sort_spec: Sequence[str], selector: str, filters: Sequence[str] = (), allow_multi: bool = False, defaults: bool = True) -> DataFrame:
    """Playable formats of each media, ranked, filtered and selected."""
    rows = fm.fill_sort_fields(coerce_fields(formats).filter(F.coalesce(F.col("has_drm"), F.lit("maybe")) == "maybe").filter(F.length("url") > 0))
    for f in filters:
        rows = fm.filter_formats(rows, f)
    return fm.select_formats(fm.rank_formats(rows, sort_spec, defaults=defaults), selector, allow_multi)


def chapter_surgery(
    chapters: DataFrame, sponsors: DataFrame, media: DataFrame, patterns: Sequence[str] = (), categories: Sequence[str] = (), ranges: Sequence[tuple[float, float]] = ()
) -> tuple[DataFrame, DataFrame]:
    """(chapters after the cuts, kept ranges of the file).

    The marked intervals feed three results, so they are written once to the shared folder.
    """
    chapters, sponsors = (shared_out(df, df, "media_id") for df in (chapters, sponsors))
    full = iv.fill_chapters(chapters, media).select("media_id", F.lit("chapter").alias("kind"), "start_time", "end_time", "title", F.lit(None).cast("string").alias("category"))
    clean = iv.clean_sponsor_segments(sponsors).select("media_id", F.lit("sponsor").alias("kind"), "start_time", "end_time", "title", "category")
    marked = materialize(iv.mark_cuts(full.unionByName(clean), patterns, categories, ranges))
    return iv.fold_tiny(iv.overlay_intervals(marked)), iv.keep_ranges(marked.filter("remove"), media)


def operations_monitor(events: DataFrame, today: str, now: str, service: Column) -> DataFrame:
    """One row: queue depth, finished counts, tokens, total elapsed seconds over the stages of all jobs, and live workers."""
    state = jb.job_state(events)
    depth = state.withColumn("service", service).agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "started").alias("processing"), F.count("*").alias("jobs"))
    done = jb.finished_since(state, today).select(*[F.col(c).alias(f"finished_{c}") for c in ("today", "this_week", "this_month")])
    spent = jb.token_stats(events, today).select(*[F.col(c).alias(f"tokens_{c}") for c in ("today", "this_week", "this_month")])
    alive = jb.liveness(events.withColumn("worker", service), now).agg(F.count_if("alive").alias("alive_services"))
    # A decimal sum, so that the order of adding can't show.
    elapsed = jb.stage_elapsed(jb.stage_progress(events)).agg(F.sum(F.col("total_elapsed_s").cast("decimal(20,1)")).cast("double").alias("elapsed_s"))
    out = depth
    for one_row in (done, spent, elapsed, alive):
        out = out.crossJoin(F.broadcast(one_row))  # each side is a single aggregate row
    return out


def assemble_book(pages: DataFrame, tags: DataFrame, voices: Sequence[str], default: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tagged sentences of each book, voice per speaker, length and text of each book) from page texts ``book, doc, text``."""
    tasks = task_count(pages)
    paras = cp.paragraphs(pages).withColumnsRenamed({"doc": "media_id", "para": "seg_id"})
    timed = sg.estimate_timeline(paras, bounded=True, tasks=tasks)
    book = sg.concat_documents(timed, "book", "media_id", small_docs=True, tasks=tasks).drop("media_id").withColumnRenamed("book", "media_id")
    if small_as_a_whole(book):
        book = materialize(book)  # read by all results; sentences of a larger one are written as they are split
    said = lk.apply_speaker_tags(sg.split_sentences(book, chars="chars"), tags)
    told = said.drop("chars")
    few = fits(tags.select("media_id", strip("speaker")).distinct(), ["media_id"])  # all speakers are from there: no sentence is read for it
    return told, lk.assign_voices(told, voices, default, few), sg.book_text(said, chars="chars")


def build_speech_corpus(
    lines: DataFrame, audio: DataFrame, tokens: Column, limit: int, seed: int, max_len: int = cp.MAX_TOKENS, pad: int = 0, start: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(training rows, filter report) from corpus lines (``value``) and the audio files there are (``filename, duration``, one row each).

    Lines hold the codes; a line whose file is missing counts in the report as such.
    """
    clips = parse_corpus(lines).join(audio.withColumn("present", F.lit(True)), "filename", "left")
    # Not written for both: codes are most of a corpus, and the report reads none of them.
    marked = cp.filter_corpus(clips)
    kept = cp.sample_n(marked.filter(F.col("reason").isNull()), limit, seed, "filename")
    kept = cp.valid_codes(kept).filter("codes_ok").select("filename", tokens.alias("ids"))
    return cp.pack_training_rows(kept, max_len, pad, start), cp.corpus_report(marked)


def review_translation(
    segments: DataFrame, revisions: DataFrame, glossary: DataFrame, calls: DataFrame, batch_rows: int = 20, target: str = "tiếng Việt"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reviewed segments, glossary rows of each media, tokens of each media).

    Segments are repaired, batched, flagged where they are untranslated, and take the accepted revisions; glossary terms are looked up
    in the repaired text.  ``calls`` hold ``media_id, model, prompt_tokens, completion_tokens``, one row for each request.
    """
    whole = materialize(sg.merge_dangling(segments))
    gated = sg.flag_untranslated(sg.batch(whole, batch_rows), "text", target)
    return lk.apply_revisions(gated, revisions, target), lk.match_glossary(whole, glossary), jb.usage_summary(calls, "media_id")
