"""Speech-corpus preparation: clip filters, text chunks, pauses and training rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timedframe.operators.ordered import attach_group, lag_lead, last_per_key
from timedframe.operators.segments import BREAK
from timedframe.semantics import strip

# Fixed values
MIN_CLIP_S, MAX_CLIP_S = 3.0, 15.0
ACRONYM = r"(?:[a-zA-Z]\.){2,}"
ACRONYM_BARE = r"(?:[A-Z]){2,}"
CODE_LIMIT = 65536
IGNORE_INDEX = -100
MAX_TOKENS = 2048
CHUNK_CHARS = 256
MIN_CHUNK_CHARS = 10
#: Characters of text whose chunks a Python task holds at once.
FLUSH_CHARS = 1 << 20
GAP_SECONDS = {"para": 0.35, "sentence": 0.18, "minor": 0.04}
SENTENCE_END = r"(?U)(?<=[.!?…])\s+"
MINOR_BREAK = r"(?U)(?<=[,;:\-–—])\s+"
KEPT_TOKEN = r"(?is)<en>.*?</en>|\S+"
EMOTIONS = {1: ["chuckle", "cười", "cuoi"], 2: ["sigh", "thở dài", "tho dai"], 3: ["clear throat", "hắng giọng", "hang giong"]}


# ---- clips ---------------------------------------------------------------------------------------


def text_ok(text: Column) -> Column:
    bad = (F.length(text) == 0) | text.rlike(r"(?U)\d") | text.rlike(ACRONYM) | text.rlike(ACRONYM_BARE) | ~text.rlike(r"[.,?!]\z")
    return F.coalesce(~bad, F.lit(False))


def filter_corpus(df: DataFrame) -> DataFrame:
    """Adds ``reason``, the first rule a clip fails (``filename, text, duration, present``); NULL keeps it."""
    d = F.col("duration")
    reason = (
        F.when(~F.coalesce(F.col("present"), F.lit(False)), "audio_not_found")
        .when(d.isNull(), "audio_error")
        .when(~d.between(MIN_CLIP_S, MAX_CLIP_S), "duration_out_of_range")
        .when(~text_ok(F.col("text")), "text_invalid")
    )
    return df.withColumn("reason", reason)


def corpus_report(filtered: DataFrame) -> DataFrame:
    """Clips per reason (``valid`` for those kept) and their share of all."""
    counts = filtered.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("clips"))
    return attach_group(counts, [], _all=F.sum("clips")).select("reason", "clips", (F.col("clips") / F.col("_all")).alias("share"))


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Up to ``n`` rows in a seeded random order; the order is a hash of the key, so a rerun repeats it."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def valid_codes(df: DataFrame, col: str = "codes") -> DataFrame:
    ok = (F.size(col) > 0) & F.forall(col, lambda c: F.coalesce((c >= 0) & (c < CODE_LIMIT), F.lit(False)))
    return df.withColumn("codes_ok", F.coalesce(ok, F.lit(False)))


def speech_ids(df: DataFrame, col: str = "text") -> DataFrame:
    ids = F.regexp_extract_all(F.col(col), F.lit(r"<\|speech_([0-9]+)\|>"), 1)
    return df.withColumn("speech_ids", ids.cast("array<int>"))


def pack_training_rows(df: DataFrame, max_len: int = MAX_TOKENS, pad: int = 0, start: int = 1, ids: str = "ids") -> DataFrame:
    """``input_ids`` padded or cut to ``max_len``, ``labels`` from the first start token on, ``attention_mask``."""
    short = F.greatest(F.lit(max_len) - F.size(ids), F.lit(0))
    rows = df.withColumn("input_ids", F.concat(F.slice(ids, 1, max_len), F.array_repeat(F.lit(pad), short)))
    # Whole slices instead of a function per token, where no null forbids it: those are interpreted.
    at, x = F.array_position("input_ids", start), F.col("input_ids")
    ignored = lambda n: F.array_repeat(F.lit(IGNORE_INDEX), n.cast("int"))
    labels = F.when(F.col("_at") > 0, F.concat(ignored(F.col("_at") - 1), F.slice(x, F.col("_at").cast("int"), max_len))).when(x.isNotNull(), ignored(F.size(x)))
    mask = F.transform(x, lambda x: F.when(x != pad, 1).otherwise(0))
    if pad == 0:
        mask = F.when(F.size(F.array_compact(x)) == F.size(x), x.cast("array<boolean>").cast("array<int>")).otherwise(mask)
    return rows.withColumn("_at", at).withColumns({"labels": labels, "attention_mask": mask}).drop("_at")


def upsert_presets(presets: DataFrame, new: DataFrame, default: str | None = None) -> DataFrame:
    """Voice presets by name, where a new one replaces the old; ``is_default`` marks the pointer.  Of several of one name the last by value counts."""
    fields = [c for c in presets.columns if c not in ("name", "is_default")]
    right = last_per_key(new.select("name", *fields), ["name"]).select("name", F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in fields])
    out = last_per_key(presets, ["name"]).join(right, "name", "full")
    cols = [F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in fields]
    old = F.coalesce("is_default", F.lit(False)) if "is_default" in presets.columns else F.lit(False)
    return out.select("name", *cols, (F.col("name") == default if default is not None else old).alias("is_default"))


# ---- text clean-up -------------------------------------------------------------------------------


def emotion_tokens(text: Column) -> Column:
    out = text
    for k, words in EMOTIONS.items():
        out = F.regexp_replace(out, r"(?iU)\[\s*(?:" + "|".join(words) + r")\s*\]", f"<|emotion_{k}|>")
    return out


def clean_punctuation(text: Column) -> Column:
    """Every cluster of marks with an end mark becomes its strongest (``!``, ``?``, ``.``), and so does a single one with the cluster after blanks.

    A comma or semicolon that stands alone is a blank, and spaces count once.
    """
    spaced = F.regexp_replace(text, r"(?U)\s+[,;]\s+| {2,}", " ")
    single, cluster = r"[.,;:]*[.!?][.,;:]*", r"[.,;:!?]*[.!?][.,;:!?]*"
    tokens = F.regexp_extract_all(spaced, F.lit(rf"(?U)({single}\s+{cluster}|[.,;:!?]+|[^.,;:!?]+)"), 1)
    strongest = lambda t: F.when(F.contains(t, F.lit("!")), "!").when(F.contains(t, F.lit("?")), "?").when(F.contains(t, F.lit(".")), ".").otherwise(t)
    return strip(F.array_join(F.transform(tokens, strongest), ""))


def paragraphs(df: DataFrame, col: str = "text") -> DataFrame:
    """One row per paragraph (blank-line separated); ``para`` counts from 1."""
    parts = F.filter(F.transform(F.split(col, r"(?U)\n\s*\n"), strip), lambda p: F.length(p) > 0)
    keep = [c for c in df.columns if c != col]
    # Not an inner one: Spark would split twice, once to drop texts without a paragraph.
    rows = df.select(*keep, F.posexplode_outer(parts).alias("_i", "text")).filter(F.col("_i").isNotNull())
    return rows.select(*keep, (F.col("_i") + 1).alias("para"), "text")


# ---- chunks --------------------------------------------------------------------------------------


def _pieces(para: Column, max_chars: int) -> Column:
    """Smallest pieces of a paragraph in order, each with whether it must open a new chunk.

    Sentences stay whole when they fit; longer ones fall into clauses, and clauses that still do not fit
    into words, where a tagged span counts as one word.
    """
    split = lambda t, p: F.filter(F.transform(F.split(t, p), strip), lambda x: F.length(x) > 0)
    item = lambda t, fresh: F.struct(t.alias("t"), fresh.alias("fresh"))
    words = lambda p: F.regexp_extract_all(p, F.lit(f"({KEPT_TOKEN})"), 1)

    def clause(p: Column, i: Column) -> Column:
        fits = F.array(item(p, i == 0))
        return F.when(F.length(p) <= max_chars, fits).otherwise(F.transform(words(p), lambda w, j: item(w, j == 0)))

    def sentence(s: Column) -> Column:
        fits = F.array(item(s, F.lit(False)))
        # the clause after a word-split one opens no chunk: it may join the last words
        return F.when(F.length(s) <= max_chars, fits).otherwise(F.flatten(F.transform(split(s, MINOR_BREAK), clause)))

    return F.flatten(F.transform(split(para, SENTENCE_END), sentence))


def _filled(pieces: Column, max_chars: int) -> Column:
    zero = F.struct(F.lit("").alias("done"), F.lit("").alias("cur"))

    def add(a: Column, p: Column) -> Column:
        full = (F.length(a["cur"]) > 0) & (p["fresh"] | (F.length(a["cur"]) + 1 + F.length(p["t"]) > max_chars))
        return F.struct(
            F.when(full, F.concat(a["done"], a["cur"], F.lit(BREAK))).otherwise(a["done"]).alias("done"),
            F.when(full | (F.length(a["cur"]) == 0), p["t"]).otherwise(F.concat(a["cur"], F.lit(" "), p["t"])).alias("cur"),
        )

    return F.split(F.aggregate(pieces, zero, add, lambda a: F.concat(a["done"], a["cur"])), BREAK)


def chunk_text(df: DataFrame, max_chars: int = CHUNK_CHARS, col: str = "text") -> DataFrame:
    """Chunks of up to ``max_chars``, packed within paragraphs: (…, para, chunk_no, chunk)."""
    keep = [c for c in df.columns if c != col]
    rows = df.select(*keep, F.posexplode(F.split(strip(F.col(col)), r"[\r\n]+")).alias("para", "_p")).withColumn("_p", strip("_p"))
    rows = rows.filter(F.length("_p") > 0)
    rows = rows.select(*keep, "para", F.posexplode(_filled(_pieces(F.col("_p"), max_chars), max_chars)).alias("chunk_no", "chunk"))
    return rows.withColumn("chunk", strip("chunk")).filter(F.length("chunk") > 0)


def chunk_gaps(chunks: DataFrame, key: str, bounded: bool | None = None) -> DataFrame:
    """Boundary kind and pause after each chunk; the last chunk of a text has none."""
    rows = lag_lead(chunks, [key], ["para", "chunk_no"], leads={"_next": F.struct(F.col("para").alias("p"))}, bounded=bounded)
    kind = (
        F.when(F.col("_next").isNull(), None)
        .when(F.col("_next.p") != F.col("para"), "para")
        .when(F.col("chunk").rlike(r"[.!?]\s*\z"), "sentence")
        .otherwise("minor")
    )
    pause = F.create_map(*[F.lit(x) for kv in GAP_SECONDS.items() for x in kv])
    return rows.withColumn("gap", kind).withColumn("pause_s", F.try_element_at(pause, F.col("gap"))).drop("_next")


def _cuts(body: str, most: int) -> Iterator[str]:
    """A long sentence from left to right, each time cut at the comma, else the space, that is nearest to half of ``most``."""
    end = len(body)
    at = 0
    while at < end:
        if body[at].isspace():
            at += 1
            continue
        if end - at <= most:
            yield body[at:]
            return
        middle, stop = at + most // 2, at + most
        for mark in ", ":
            near = [i for i in (body.rfind(mark, at, middle + 1), body.find(mark, middle, stop)) if i >= 0]
            if near:
                cut = min(near, key=lambda i: (abs(i - middle), i))
                piece, at = body[at:cut], cut + 1
                break
        else:
            piece, at = body[at:stop], stop
        if piece := piece.strip():
            yield piece


def balanced_chunks(text: str, most: int, least: int) -> list[tuple[str, bool]]:
    """(chunk, ends a sentence) for one cleaned text: long sentences are cut, and a chunk under ``least`` takes the next one in if both fit."""
    out: list[tuple[str, bool]] = []

    def add(chunk: str, ends: bool, short: bool) -> None:
        """Appends a chunk, or joins it to the last one where one of them is short."""
        both = f"{out[-1][0].rstrip('.!?').rstrip()} {chunk}" if out and short else None
        if both is not None and len(both) <= most:
            out[-1] = (both, ends)
        else:
            out.append((chunk, ends))

    for found in re.finditer(r"[^.!?\r\n]+[.!?]*|[.!?]+", text):
        sentence = found.group().strip()
        mark = sentence[-1:] if sentence[-1:] in (".", "!", "?") else ""
        body = sentence.removesuffix(mark).rstrip()
        cut = list(_cuts(body, most)) if len(sentence) > most else [body] if body else []
        for k, piece in enumerate(cut, 1):
            ends = k == len(cut)
            add(piece + (mark or "." if ends else "."), ends, bool(out) and len(out[-1][0]) < least)
    if len(out) > 1 and len(out[-1][0]) < least:
        add(*out.pop(), True)
    return out


def chunk_balanced(df: DataFrame, key: str, max_chars: int = CHUNK_CHARS, min_chars: int = MIN_CHUNK_CHARS, col: str = "text") -> DataFrame:
    """Balanced chunks per text with the pause after each: (key, chunk_no, chunk, is_sentence_end, pause_s)."""
    kind = dict(df.dtypes)[key]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [key, "chunk_no", "chunk", "is_sentence_end", "pause_s"]
        for pdf in batches:
            rows, held = [], 0
            # Chunks leave every million characters: what is held doesn't grow with a batch.
            for k, t in zip(pdf[key], pdf["_t"]):
                if not t:
                    continue
                rows += [(k, i, c, e, (0.4 if c.strip()[-1] in "!?" else 0.3) if e else 0.0) for i, (c, e) in enumerate(balanced_chunks(t, max_chars, min_chars))]
                held += len(t)
                if held >= FLUSH_CHARS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    cleaned = df.select(key, clean_punctuation(F.col(col)).alias("_t"))
    return cleaned.mapInPandas(cut, f"{key} {kind}, chunk_no int, chunk string, is_sentence_end boolean, pause_s double")
