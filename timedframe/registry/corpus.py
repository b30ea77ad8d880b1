"""Checked queries over corpus preparation."""

from pyspark.sql import functions as F

from timedframe import fixtures as fx
from timedframe.fixtures import oracle, sql_strip
from timedframe.operators import corpus as cp
from timedframe.registry.core import query
from timedframe.semantics import r4

CLIPS_SQL = """clips AS (SELECT media_id, seg_id, text, CASE WHEN (media_id + seg_id) % 13 <> 0 THEN length(text) / 14.0::DOUBLE END AS duration, (media_id + seg_id) % 17 <> 0 AS present FROM doc_lines),
reasons AS (SELECT *, CASE WHEN NOT present THEN 'audio_not_found' WHEN duration IS NULL THEN 'audio_error' WHEN duration NOT BETWEEN 3 AND 15 THEN 'duration_out_of_range'
  WHEN length(text) = 0 OR regexp_matches(text, '\\d') OR regexp_matches(text, '([a-zA-Z]\\.){2,}') OR regexp_matches(text, '[A-Z]{2,}') OR NOT regexp_matches(text, '[.,?!]$') THEN 'text_invalid' END AS reason FROM clips)"""


def clips(spark, sf):
    n = F.col("media_id") + F.col("seg_id")
    return fx.doc_lines(spark, sf).select(
        "media_id", "seg_id", F.concat(F.col("media_id").cast("string"), F.lit("_"), F.col("seg_id").cast("string"), F.lit(".wav")).alias("filename"), "text",
        F.when(n % 13 != 0, F.length("text") / F.lit(14.0)).alias("duration"), (n % 17 != 0).alias("present"),
    )


@query("fl11_text_ok", oracle("doc_lines", ", " + CLIPS_SQL.replace("\\\\", "\\") + r" SELECT media_id, seg_id, NOT (regexp_matches(text, '\d') OR regexp_matches(text, '([a-zA-Z]\.){2,}') OR regexp_matches(text, '[A-Z]{2,}') OR NOT regexp_matches(text, '[.,?!]$')) AS ok FROM clips"))
def _(spark, sf):
    return fx.doc_lines(spark, sf).select("media_id", "seg_id", cp.text_ok(F.col("text")).alias("ok"))


@query("cr1_filter_corpus", oracle("doc_lines", ", " + CLIPS_SQL.replace("\\\\", "\\") + " SELECT media_id, seg_id, reason FROM reasons"))
def _(spark, sf):
    return cp.filter_corpus(clips(spark, sf)).select("media_id", "seg_id", "reason")


@query("ag10_corpus_report", oracle("doc_lines", ", " + CLIPS_SQL.replace("\\\\", "\\") + " SELECT coalesce(reason, 'valid') AS reason, count(*) AS clips, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM reasons GROUP BY 1"))
def _(spark, sf):
    return cp.corpus_report(cp.filter_corpus(clips(spark, sf))).select("reason", "clips", r4("share").alias("share"))


@query("sr12_sample_n")
def _(spark, sf):
    return cp.sample_n(fx.text_table(spark, sf, "documents", "doc_id").select("doc_id", "lang"), 100, 42, "doc_id")


def codes(spark, sf):
    first = F.col("doc_id") * 31
    c = F.transform(F.sequence(first, first + F.col("n").cast("bigint") * 7919, F.lit(7919).cast("bigint")), lambda x: x % 66000 - 3)
    d = fx.text_table(spark, sf, "documents", "doc_id").select("doc_id", F.length("text").alias("n"))
    return d.select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.array().cast("array<bigint>")).otherwise(c).alias("codes"))


CODES_SQL = "c AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN []::BIGINT[] ELSE list_transform(range(0, length(text) + 1), lambda i: (i * 7919 + doc_id * 31) % 66000 - 3) END AS codes FROM documents)"


@query("cr2_valid_codes", f"WITH {CODES_SQL} SELECT doc_id, len(codes) > 0 AND len(list_filter(codes, lambda x: x < 0 OR x >= 65536)) = 0 AS codes_ok FROM c")
def _(spark, sf):
    return cp.valid_codes(codes(spark, sf)).select("doc_id", "codes_ok")


@query("cr3_speech_ids", f"WITH {CODES_SQL} SELECT doc_id, array_to_string(list_filter(codes, lambda x: x >= 0), ',') AS ids FROM c")
def _(spark, sf):
    marks = F.concat(F.lit("<|speech_"), F.array_join(F.col("codes").cast("array<string>"), "|> x<|speech_"), F.lit("|> "))
    text = F.when(F.size("codes") > 0, marks).when(F.col("codes").isNotNull(), "")
    out = cp.speech_ids(codes(spark, sf).withColumn("text", text))
    return out.select("doc_id", F.array_join(F.col("speech_ids").cast("array<string>"), ",").alias("ids"))


@query(
    "cr4_pack_training_rows",
    f"""WITH {CODES_SQL}, t AS (SELECT doc_id, list_concat([5, 6], CASE WHEN doc_id % 4 <> 0 THEN [1] ELSE [] END, list_transform(codes, lambda x: abs(x) + 10)) AS ids FROM c),
p AS (SELECT doc_id, list_concat(ids[1:2048], list_transform(range(0, greatest(2048 - len(ids), 0)), lambda i: 0)) AS x FROM t), q AS (SELECT *, coalesce(list_position(x, 1), 0) AS at FROM p)
SELECT doc_id, array_to_string(x, ',') AS input_ids, array_to_string(list_transform(range(1, 2049), lambda i: CASE WHEN at > 0 AND i >= at THEN x[i] ELSE -100 END), ',') AS labels, list_sum(list_transform(x, lambda v: (v <> 0)::INT))::BIGINT AS attended FROM q""".replace(" AS at FROM p", " AS pos FROM p").replace("WHEN at > 0 AND i >= at", "WHEN pos > 0 AND i >= pos"),
)
def _(spark, sf):
    lead = F.when(F.col("doc_id") % 4 != 0, F.array(F.lit(5), F.lit(6), F.lit(1))).otherwise(F.array(F.lit(5), F.lit(6)))
    ids = F.concat(lead, F.transform("codes", lambda x: (F.abs(x) + 10).cast("int")))
    out = cp.pack_training_rows(codes(spark, sf).select("doc_id", ids.alias("ids")), 2048, 0, 1)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("doc_id", text("input_ids"), text("labels"), F.size(F.array_remove("attention_mask", 0)).cast("bigint").alias("attended"))


@query("cr5_chunk_text")
def _(spark, sf):
    return cp.chunk_text(fx.text_table(spark, sf, "documents", "doc_id").select("doc_id", "text"))


@query(
    "cr6_chunk_gaps",
    oracle("doc_lines", """, ch AS (SELECT media_id, seg_id AS para, i AS chunk_no, c AS chunk FROM (SELECT media_id, seg_id, unnest(list_filter(string_split(text, ', '), lambda x: x <> '')) AS c, unnest(range(0, len(list_filter(string_split(text, ', '), lambda x: x <> '')))) AS i FROM doc_lines)),
n AS (SELECT *, lead(para) OVER (PARTITION BY media_id ORDER BY para, chunk_no) AS np FROM ch), g AS (SELECT *, CASE WHEN np IS NULL THEN NULL WHEN np <> para THEN 'para' WHEN regexp_matches(chunk, '[.!?]\\s*$') THEN 'sentence' ELSE 'minor' END AS gap FROM n)
SELECT media_id, para, chunk_no, gap, CASE gap WHEN 'para' THEN 0.35 WHEN 'sentence' THEN 0.18 WHEN 'minor' THEN 0.04 END::DOUBLE AS pause_s FROM g"""),
)
def _(spark, sf):
    parts = F.filter(F.split("text", ", "), lambda x: F.length(x) > 0)
    ch = fx.doc_lines(spark, sf).select("media_id", F.col("seg_id").alias("para"), F.posexplode(parts).alias("chunk_no", "chunk"))
    return cp.chunk_gaps(ch, "media_id", bounded=True).select("media_id", "para", "chunk_no", "gap", "pause_s")


@query("cr7_chunk_balanced")
def _(spark, sf):
    return cp.chunk_balanced(fx.text_table(spark, sf, "documents", "doc_id"), "doc_id")


@query(
    "cr8_paragraphs",
    f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '\\n{fx.WS}*\\n', chr(1), 'g'), chr(1)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS ps FROM documents)
SELECT doc_id, unnest(range(1, len(ps) + 1)) AS para, unnest(ps) AS text FROM p""",
)
def _(spark, sf):
    d = fx.text_table(spark, sf, "documents", "doc_id").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return cp.paragraphs(d)


@query(
    "cr9_upsert_presets",
    """WITH a AS (SELECT 'v' || p_partkey AS name, p_name AS text FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT 'v' || p_partkey AS name, p_type AS text FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(b.name, a.name) AS name, CASE WHEN b.name IS NOT NULL THEN b.text ELSE a.text END AS text, coalesce(b.name, a.name) = 'v6' AS is_default FROM a FULL JOIN b ON a.name = b.name""",
)
def _(spark, sf):
    k, p = F.col("p_partkey"), fx.table(spark, sf, "part")
    name = F.concat(F.lit("v"), k.cast("string")).alias("name")
    return cp.upsert_presets(p.filter(k % 3 != 0).select(name, F.col("p_name").alias("text")), p.filter(k % 2 == 0).select(name, F.col("p_type").alias("text")), "v6")


@query(
    "sc32_emotion_tokens",
    oracle("doc_lines", """SELECT media_id, seg_id, CASE seg_id % 3 WHEN 0 THEN '<|emotion_1|> ' WHEN 1 THEN '[wave] ' ELSE '<|emotion_3|> ' END || text || ' <|emotion_2|>.' AS text FROM doc_lines"""),
)
def _(spark, sf):
    lead = F.when(F.col("seg_id") % 3 == 0, "[ Chuckle ] ").when(F.col("seg_id") % 3 == 1, "[wave] ").otherwise("[hắng giọng] ")
    d = fx.doc_lines(spark, sf)
    return d.select("media_id", "seg_id", cp.emotion_tokens(F.concat(lead, F.col("text"), F.lit(" [THỞ DÀI]."))).alias("text"))


BLANK = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
MARKS_SQL = f"""SELECT media_id, seg_id, regexp_replace(regexp_replace(array_to_string(list_transform(
    regexp_extract_all(s, '[.!?]{BLANK}*[.!?]+|[.!?]|[^.!?]+'),
    lambda t: CASE WHEN NOT regexp_full_match(t, '[.!?]{BLANK}*[.!?]+') THEN t WHEN contains(t, '!') THEN '!' WHEN contains(t, '?') THEN '?' ELSE '.' END), ''), '^{BLANK}+', ''), '{BLANK}+$', '') AS text
  FROM (SELECT media_id, seg_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    text || CASE seg_id % 3 WHEN 0 THEN ';.. ?!' WHEN 1 THEN '., ..?.' ELSE '.;,,.' END,
    '([.!?])[.,;:]+', '\\1', 'g'), '[.,;:]+([.!?])', '\\1', 'g'), '{BLANK}+[,;]{BLANK}+', ' ', 'g'), ' {{2,}}', ' ', 'g') AS s FROM doc_lines)"""


@query("sc33_clean_punctuation", oracle("doc_lines", MARKS_SQL))
def _(spark, sf):
    tail = F.when(F.col("seg_id") % 3 == 0, ";.. ?!").when(F.col("seg_id") % 3 == 1, "., ..?.").otherwise(".;,,.")
    return fx.doc_lines(spark, sf).select("media_id", "seg_id", cp.clean_punctuation(F.concat("text", tail)).alias("text"))
